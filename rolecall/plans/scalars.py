"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions import text, urls
from rolecall.operators.dedupe import first_by_key
from rolecall.operators.discovery import company_name, legacy_company_name
from rolecall.operators.extract import classify_details, location_text, original_url
from rolecall.operators.joins import drop_known
from rolecall.plans.inputs import LATIN_LETTERS, load
from rolecall.plans.registry import query

NETLOC_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


@query("p1_url_hash", f"SELECT page_id, md5(url) AS url_hash, {NETLOC_SQL} AS netloc FROM pages")
def url_hashes(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf, "pages").select("page_id", urls.url_hash(url).alias("url_hash"), urls.netloc(url).alias("netloc"))


@query(
    "p2_new_pages_per_host",
    f"""SELECT {NETLOC_SQL} AS host, count(*) AS pages FROM (SELECT DISTINCT url FROM pages) p
    WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE s.url LIKE '%/en/%' AND md5(s.url) = md5(p.url)) GROUP BY 1""",
)
def new_pages_per_host(spark: SparkSession, sf: str) -> DataFrame:
    """Normalise, hash, keep the first of each URL, drop the stored ones, count per host."""
    pages = load(spark, sf, "pages").select("page_id", urls.normalise_url(F.col("url")).alias("url"))
    hashed = pages.withColumn("url_hash", urls.url_hash(F.col("url")))
    stored = load(spark, sf, "pages").where(F.col("url").contains("/en/")).select(
        urls.url_hash(F.col("url")).alias("url_hash")
    )
    fresh = drop_known(first_by_key(hashed, ["url_hash"], "page_id"), stored, "url_hash")
    return fresh.groupBy(urls.netloc(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(
    "v3_normalise_url",
    """SELECT page_id, url AS plain, url || '%20%C3%A9' AS encoded, url AS dotted, CAST(NULL AS VARCHAR) AS rejected
    FROM pages""",
)
def normalised_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The same URLs in shouted, spaced, detoured and unsupported spellings."""
    url = F.col("url")
    scheme, host = F.regexp_extract(url, "^([a-z]+)://", 1), urls.netloc(url)
    rest = F.regexp_extract(url, "^[a-z]+://[^/?#]*(.*)$", 1)
    port = F.when(scheme == "https", ":443").otherwise(":80")
    loud = F.concat(F.lit("  "), F.upper(scheme), F.lit("://"), F.upper(host), port, rest)
    detour = F.concat(scheme, F.lit("://"), host, F.lit("/x/./y/../.."), rest)
    return load(spark, sf, "pages").select(
        "page_id",
        urls.normalise_url(loud).alias("plain"),
        urls.normalise_url(F.concat(url, F.lit(" é"))).alias("encoded"),
        urls.normalise_url(detour).alias("dotted"),
        urls.normalise_url(F.concat(F.lit("ftp://"), host, rest)).alias("rejected"),
    )




@query(
    "p3_p6_job_texts",
    """SELECT doc_id, md5('description:' || chr(10) || text || chr(10) || chr(10) || 'requirements:' || chr(10) || lang)
     AS storage,
    md5(trim('T ' || source || chr(10) || chr(10) || 'description: ' || text || chr(10) || 'requirements: ' || lang,
     ' ' || chr(10))) AS embed,
    md5(trim(text || chr(10) || chr(10) || lang, ' ' || chr(10))) AS matching,
    md5(trim('T ' || source || chr(10) || chr(10) || text, ' ' || chr(10))) AS plain_embed,
    md5('T ' || source || ' ' || text || ' ' || lang || ' ' || source) AS screening FROM documents""",
)
def job_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The four texts of a posting: stored, embedded, matched and screened."""
    none = F.lit(None).cast("string")
    entries = F.create_map(
        F.lit("description"), F.col("text"), F.lit("requirements"), F.col("lang"), F.lit("benefits"), F.lit("")
    )
    title, body = F.concat(F.lit("T "), F.col("source")), F.col("text")
    no_map = F.lit(None).cast("map<string,string>")
    return load(spark, sf, "documents").select(
        "doc_id",
        F.md5(text.storage_description(entries, none)).alias("storage"),
        F.md5(text.embedding_text(title, entries, none)).alias("embed"),
        F.md5(text.matching_text(entries)).alias("matching"),
        F.md5(text.embedding_text(title, no_map, body)).alias("plain_embed"),
        F.md5(text.screening_text(title, no_map, body, F.col("lang"), F.col("source"))).alias("screening"),
    )


@query(
    "p7_company_name",
    r"""SELECT p_partkey, nullif(trim(regexp_replace(trim(replace(replace(t, 'Jobs at ', ''), ' - Comeet', '')),
     '[-|:\s\x{00B7}]+$', '')), '') AS company FROM (SELECT p_partkey, CASE p_type
     WHEN 'ECONOMY' THEN 'Jobs at ' || p_name || ' - Comeet' WHEN 'STANDARD' THEN 'Jobs at ' || p_name || ' -| : -'
     WHEN 'PROMO' THEN ' -|: ' WHEN 'SMALL' THEN 'Jobs at ' || p_brand || ' - Careers - Comeet ·' ELSE p_name || ' |'
     END AS t FROM part)""",
)
def company_names(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr(
        """CASE p_type WHEN 'ECONOMY' THEN 'Jobs at ' || p_name || ' - Comeet'
        WHEN 'STANDARD' THEN 'Jobs at ' || p_name || ' -| : -' WHEN 'PROMO' THEN ' -|: '
        WHEN 'SMALL' THEN 'Jobs at ' || p_brand || ' - Careers - Comeet ·' ELSE p_name || ' |' END"""
    )
    return load(spark, sf, "part").select("p_partkey", company_name(title, F.lit("comeet.com")).alias("company"))


@query(
    "p8_company_name_legacy",
    """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_name || ' |' WHEN 'LARGE' THEN p_brand ELSE p_name END AS company
    FROM part""",
)
def legacy_company_names(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr(
        """CASE p_type WHEN 'ECONOMY' THEN 'Jobs at ' || p_name || ' - comeet.com'
        WHEN 'STANDARD' THEN 'Careers at ' || p_name || ' Jobs' WHEN 'PROMO' THEN p_name || ' Jobs in town'
        WHEN 'SMALL' THEN 'Work at ' || p_name || ' | Careers' WHEN 'LARGE' THEN p_brand || ' | ' || p_name
        ELSE 'Jobs at ' || p_name || ' Careers | comeet.com' END"""
    )
    return load(spark, sf, "part").select(
        "p_partkey", legacy_company_name(title, F.lit("comeet.com")).alias("company")
    )


@query(
    "p9_clean_url",
    """SELECT page_id, 'https://www.comeet.com/jobs/' || h || '/' || page_id || '?q=1' AS cleaned,
    'https://lever.co' AS lever, 'https://jobs.lever.co/' || h AS lever_fixed, url AS other FROM
    (SELECT page_id, url, """ + NETLOC_SQL + """ AS h FROM pages)""",
)
def cleaned_urls(spark: SparkSession, sf: str) -> DataFrame:
    host = urls.netloc(F.col("url"))
    comeet = F.concat(F.lit("https://www.comeet.com/jobs/"), host, F.lit("/"), F.col("page_id"), F.lit("?q=1/dev/3B.01B"))
    lever = F.concat(F.lit("https://lever.co/jobs/"), host)
    hosted = F.concat(F.lit("https://jobs.lever.co/"), host, F.lit("/dev"))
    return load(spark, sf, "pages").select(
        "page_id",
        urls.clean_company_page_url(comeet).alias("cleaned"),
        urls.clean_company_page_url(lever).alias("lever"),
        urls.clean_company_page_url(hosted, fix_lever=True).alias("lever_fixed"),
        urls.clean_company_page_url(F.col("url")).alias("other"),
    )


@query(
    "p14_location_head",
    """SELECT doc_id, md5(trim(string_split(text, ',')[1], ' ' || chr(10) || chr(9) || chr(13))) AS head
    FROM documents""",
)
def location_heads(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(text.location_head(F.col("text"))).alias("head"))


@query(
    "p16_json",
    "SELECT conv_id, turn, role, text, CAST(length(text) AS BIGINT) AS chars FROM conversations",
)
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Encode each turn as a JSON message and decode it again."""
    turns = load(spark, sf, "conversations")
    message = F.to_json(F.struct("conv_id", "turn", "role", "text", F.length("text").alias("chars")))
    decoded = turns.select(
        F.from_json(message, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, chars BIGINT").alias("m")
    )
    return decoded.select("m.*")


@query(
    "p17_drop_blank_fields",
    """SELECT doc_id, '{"source":"' || source || '"' || CASE WHEN lang = 'en' THEN '' ELSE ',"lang":"' || lang || '"' END
    || CASE WHEN n_chars > 1000 THEN ',"tags":["long"]' ELSE '' END
    || CASE WHEN n_chars > 2000 THEN ',"notes":{"size":"big"}' ELSE '' END || '}' AS record FROM documents""",
)
def sanitised_records(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    tags = F.when(F.col("n_chars") > 1000, F.array(F.lit("long"))).otherwise(F.array().cast("array<string>"))
    note = F.when(F.col("n_chars") > 2000, F.lit("big")).otherwise(F.lit(""))
    fields = {
        "source": F.col("source"),
        "lang": text.non_empty(lang, "text"),
        "tags": text.non_empty(tags, "list"),
        "notes": text.non_empty(F.create_map(F.lit("size"), note), "map"),
    }
    return load(spark, sf, "documents").select("doc_id", text.drop_blank_fields(fields).alias("record"))


@query("p18_stable_job_id", "SELECT page_id, md5('acme' || chr(1) || '' || chr(1) || url) AS job_id FROM pages")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select(
        "page_id", text.stable_job_id(F.lit("acme"), F.lit(None).cast("string"), F.col("url")).alias("job_id")
    )


@query(
    "x5_detail_fold",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand END AS location,
    CASE WHEN p_type = 'ECONOMY' THEN 'Senior person for ECONOMY' WHEN p_size > 25 THEN p_name ELSE p_brand END
     AS experience_level,
    CASE WHEN p_type = 'STANDARD' THEN 'Full-Time' WHEN p_size <= 25 THEN p_name WHEN p_type = 'ECONOMY' THEN NULL
     ELSE p_type END AS employment_type FROM part""",
)
def folded_details(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda value, marker: F.struct(value.alias("text"), marker.alias("has_marker"))
    last = F.expr(
        "CASE p_type WHEN 'ECONOMY' THEN 'Senior person for ECONOMY' WHEN 'STANDARD' THEN 'Full-Time' ELSE p_type END"
    )
    no = F.lit(False)
    items = F.array(
        item(F.col("p_brand"), F.col("p_size") > 25), item(F.col("p_name"), no),
        item(F.lit("a line of four"), no), item(last, no),
    )
    folded = load(spark, sf, "part").select("p_partkey", classify_details(items).alias("d"))
    return folded.select(
        "p_partkey", F.col("d.location").alias("location"), F.col("d.experience").alias("experience_level"),
        F.col("d.employment").alias("employment_type"),
    )


@query(
    "x8_location_text",
    """SELECT c_custkey, CASE WHEN p <> '' THEN p WHEN c_custkey IS NULL THEN 'Not specified' ELSE c_name END AS location
    FROM (SELECT c_custkey, c_name, concat_ws(', ', CASE WHEN c_mktsegment = 'BUILDING' THEN 'Haifa' END,
    CASE WHEN n_regionkey = 0 THEN 'ISRAEL' WHEN n_regionkey = 1 THEN 'FR' END,
    CASE WHEN c_acctbal < 0 THEN '(Remote)' END) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def location_texts(spark: SparkSession, sf: str) -> DataFrame:
    joined = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.struct(
        F.col("c_name").alias("name"),
        F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN 'Haifa' ELSE '' END").alias("city"),
        F.expr("CASE n_regionkey WHEN 0 THEN 'IL' WHEN 1 THEN 'FR' END").alias("country"),
        (F.col("c_acctbal") < 0).alias("is_remote"),
    )
    return joined.select("c_custkey", place.alias("place")).select(
        "c_custkey", location_text(F.col("place")).alias("location")
    )


@query(
    "x11_original_url",
    """SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN NULL WHEN url LIKE '%/en/%' THEN 'https://own.example.com/' || page_id
    WHEN url LIKE '%/de/%' THEN url || '/seen' END AS original FROM pages""",
)
def original_urls(spark: SparkSession, sf: str) -> DataFrame:
    active = F.expr(
        """CASE WHEN url LIKE '%/fr/%' THEN url WHEN url LIKE '%/en/%' THEN 'https://own.example.com/' || page_id
        ELSE '' END"""
    )
    detected = F.expr("CASE WHEN url LIKE '%/de/%' THEN url || '/seen' END")
    return load(spark, sf, "pages").select("page_id", original_url(F.col("url"), active, detected).alias("original"))


@query(
    "x13_clean_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned,
    CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT) AS chars FROM documents""",
)
def cleaned_texts(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = load(spark, sf, "documents").select("doc_id", text.squeeze(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.md5("t").alias("cleaned"), F.length("t").cast("long").alias("chars"))


@query(
    "f2_script_share",
    r"""SELECT doc_id, round(share, 6) AS share, coalesce(share > 0.1, false) AS flagged FROM (SELECT doc_id,
    length(regexp_replace(text, '[^\x{00C0}-\x{00FF}]', '', 'g'))::DOUBLE
    / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0) AS share FROM documents)""",
)
def script_shares(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        F.round(text.script_share(body, LATIN_LETTERS), 6).alias("share"),
        text.mostly_script(body, LATIN_LETTERS).alias("flagged"),
    )
