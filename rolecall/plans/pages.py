"""Extraction, validation and screening over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions.html import html_text
from rolecall.operators import screening, validate
from rolecall.operators.extract import extract_jobs, run_counters, run_errors, site_report
from rolecall.operators.joins import spread_splits
from rolecall.plans.inputs import LATIN_LETTERS, POSTINGS_SQL, load, postings
from rolecall.plans.registry import query
from rolecall.sources.readers import read_pages


def json_page() -> Column:
    """A careers page with two embedded positions made from one part."""
    detail = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    markup = F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p><ul><li>"), F.col("p_type"), F.lit(" &amp; co</ul>"))
    key = F.col("p_partkey").cast("string")
    own = F.concat(F.lit("https://own.example.com/"), key)
    first = F.struct(
        F.col("p_name").alias("name"), F.col("p_brand").alias("department"), F.col("p_type").alias("employment_type"),
        key.alias("uid"), F.concat(F.lit("https://jobs.example.com/"), key).alias("url_comeet_hosted_page"),
        F.when(F.col("p_size") > 20, own).alias("url_active_page"),
        F.struct(F.lit("Haifa").alias("city"), F.lit("IL").alias("country")).alias("location"),
        F.struct(
            F.array(detail("Description", markup), detail("Requirements", F.lit("old")),
                    detail("REQUIREMENTS", F.col("p_brand"))).alias("details")
        ).alias("custom_fields"),
    )
    # a number, an object and a text without a name beside them
    odd = F.concat(F.lit('{"name":"description","value":'), F.col("p_size"), F.lit('},{"name":"requirements","value":{"a":1}},'
                   '{"value":"'), F.col("p_type"), F.lit('"}]}'))
    first = F.replace(F.to_json(first), F.lit("]}"), F.concat(F.lit(","), odd))
    second = F.struct(F.concat(F.lit("Second "), F.col("p_name")).alias("name"))
    positions = F.concat(F.lit("["), first, F.lit(","), F.to_json(second), F.lit("]"))
    return F.concat(F.lit("<html><script>var COMPANY_POSITIONS_DATA =\n "), positions, F.lit(";</script></html>"))


def anchor_page() -> Column:
    """A careers page with two titled anchors and one without a title."""
    return F.concat(
        F.lit('<div><a class="link positionItem" href="/p/'), F.col("p_partkey"),
        F.lit('"><span class="positionLink"> '), F.col("p_name"),
        F.lit(' </span><ul class="positionDetails"><li><i class="fa fa-map-marker"></i> Haifa </li><li>'),
        F.col("p_type"), F.lit("</li><li>Part-time</li></ul></a>"
                               '<a class="positionItem" ng-href="/q"><span class="positionLink">'),
        F.col("p_brand"), F.lit('</span></a><a class="positionItem" href="/none"></a></div>'),
    )


def card_page() -> Column:
    """A careers page with one titled card and one without a title."""
    return F.concat(
        F.lit('<div class="wide job-card"><h3>Other</h3><h2>'), F.col("p_name"), F.lit(' <b>'), F.col("p_brand"),
        F.lit('</b></h2><p class="team">'), F.col("p_type"),
        F.lit('</p><i class="job-location">Holon</i><a>no link</a><a href="/c/'), F.col("p_partkey"),
        F.lit('">go</a></div><div class="job-item"><p>untitled</p></div>'),
    )


def mixed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per part; its size decides how the page lists its jobs."""
    html = (
        F.when(F.col("p_size") <= 15, json_page())
        .when(F.col("p_size") <= 30, anchor_page())
        .when(F.col("p_size") <= 45, card_page())
        .when(F.col("p_size") <= 48, F.lit("<p>no jobs</p>"))
    )
    return spread_splits(load(spark, sf, "part")).select(
        F.col("p_partkey").alias("page_key"), F.col("p_brand").alias("site"), html.alias("html")
    )


def _part_pages(spark: SparkSession, sf: str, html: Column) -> DataFrame:
    return spread_splits(load(spark, sf, "part")).select(F.col("p_partkey").alias("page_key"), html.alias("html"))


_EMBEDDED_SQL = """SELECT p_partkey AS page_key, 0::BIGINT AS job_pos, p_name AS title, p_brand AS department,
 'Haifa, ISRAEL' AS location, p_type AS employment_type, 'https://jobs.example.com/' || p_partkey AS url,
 CASE WHEN p_size > 20 THEN 'https://own.example.com/' || p_partkey END AS original,
 p_name || chr(10) || p_type || ' & co' AS description, p_brand AS requirements, p_type AS nameless, 0::BIGINT AS type_errors FROM part
UNION ALL SELECT p_partkey, 1, 'Second ' || p_name, NULL, 'Not specified', NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM part"""


@query("x2_embedded_json", _EMBEDDED_SQL)
def embedded_json(spark: SparkSession, sf: str) -> DataFrame:
    return extract_jobs(_part_pages(spark, sf, json_page())).select(
        "page_key", F.col("job_pos").cast("long").alias("job_pos"), "title", "department", "location",
        "employment_type", "url", F.col("original_website_job_url").alias("original"),
        F.try_element_at("description_map", F.lit("description")).alias("description"),
        F.try_element_at("description_map", F.lit("requirements")).alias("requirements"),
        F.try_element_at("description_map", F.lit("")).alias("nameless"),
        F.size("type_errors").cast("long").alias("type_errors"),
    )


_ANCHOR_SQL = """SELECT p_partkey AS page_key, 0::BIGINT AS job_pos, p_name AS title, CAST(NULL AS VARCHAR) AS department,
 'Haifa' AS location, p_type AS experience_level, 'Part-time' AS employment_type, '/p/' || p_partkey AS url FROM part
UNION ALL SELECT p_partkey, 1, p_brand, NULL, NULL, NULL, NULL, '/q' FROM part"""
_CARD_SQL = """SELECT p_partkey AS page_key, 0::BIGINT AS job_pos, p_name || p_brand AS title, p_type AS department,
 'Holon' AS location, CAST(NULL AS VARCHAR) AS experience_level,
 CAST(NULL AS VARCHAR) AS employment_type, '/c/' || p_partkey AS url FROM part"""


def _listed(pages: DataFrame) -> DataFrame:
    return extract_jobs(pages).select(
        "page_key", F.col("job_pos").cast("long").alias("job_pos"), "title", "department", "location",
        "experience_level", "employment_type", "url",
    )


@query("x3_html_anchors", _ANCHOR_SQL)
def html_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(_part_pages(spark, sf, anchor_page()))


@query("x4_html_cards", _CARD_SQL)
def html_cards(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(_part_pages(spark, sf, card_page()))


@query(
    "x1_cascade",
    """SELECT p_partkey AS page_key, CASE WHEN p_size <= 15 THEN 'Haifa, ISRAEL' WHEN p_size <= 30 THEN 'Haifa'
     ELSE 'Holon' END AS location, CASE WHEN p_size BETWEEN 31 AND 45 THEN p_name || p_brand ELSE p_name END AS title
    FROM part WHERE p_size <= 45
    UNION ALL SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'Not specified' END,
    CASE WHEN p_size <= 15 THEN 'Second ' || p_name ELSE p_brand END FROM part WHERE p_size <= 30""",
)
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    return extract_jobs(mixed_pages(spark, sf)).select("page_key", "location", "title")


_REPORT_SQL = """SELECT p_partkey AS page_key, p_brand AS site, p_size <= 48 AS success, CAST(CASE WHEN p_size <= 30 THEN 2
 WHEN p_size <= 45 THEN 1 ELSE 0 END AS BIGINT) AS jobs, CASE WHEN p_size > 48 THEN 'No HTML' END AS error FROM part"""


@query("x12_site_report", _REPORT_SQL)
def site_reports(spark: SparkSession, sf: str) -> DataFrame:
    return site_report(mixed_pages(spark, sf))


@query("x12_real_pages", "SELECT page_id, url, true AS success, 0::BIGINT AS jobs, CAST(NULL AS VARCHAR) AS error FROM pages")
def real_page_report(spark: SparkSession, sf: str) -> DataFrame:
    return site_report(spread_splits(load(spark, sf, "pages")))


@query("s12_page_source", "SELECT url, md5(html) AS html FROM pages")
def page_source(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet").select("url", F.md5("html").alias("html"))


@query(
    "a10_run_counters",
    f"""SELECT count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) AS total,
    CAST(sum(jobs) AS BIGINT) AS jobs FROM ({_REPORT_SQL})""",
)
def scrape_counters(spark: SparkSession, sf: str) -> DataFrame:
    return run_counters(site_report(mixed_pages(spark, sf)))


@query("a11_run_errors", f"SELECT site, error, count(*) AS pages FROM ({_REPORT_SQL}) WHERE error IS NOT NULL GROUP BY 1, 2")
def scrape_errors(spark: SparkSession, sf: str) -> DataFrame:
    return run_errors(site_report(mixed_pages(spark, sf))).groupBy("site", "error").agg(F.count("*").alias("pages"))


@query(
    "x10_html_text",
    r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script>.*?</script>',
     '<x>', 'g'), '(?is)<style>.*?</style>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g') AS h FROM pages),
    pieces AS (SELECT page_id, list_filter(string_split_regex(h, '<[^>]*>'), lambda s: s <> '') AS p FROM bare),
    shown AS (SELECT page_id, list_transform(p, lambda s: CASE WHEN trim(s, ' ' || chr(10)) <> '' THEN s
     WHEN contains(s, chr(10)) THEN chr(10) ELSE ' ' END) AS p FROM pieces),
    joined AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(p, chr(10)),
     '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), ' ' || chr(10)) AS t FROM shown)
    SELECT page_id, md5(t) AS text, CAST(length(t) AS BIGINT) AS chars FROM joined""",
)
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts = spread_splits(load(spark, sf, "pages")).select("page_id", html_text(F.col("html")).alias("t"))
    return texts.select("page_id", F.md5("t").alias("text"), F.length("t").cast("long").alias("chars"))


_RAW_TITLE = "CASE lang WHEN 'es' THEN ' ' || chr(9) || ' ' WHEN 'de' THEN NULL ELSE '  ' || source || ' ' END"
_RAW_URL = """CASE source WHEN 'src0' THEN 'ftp://a.example.com/x' WHEN 'src1' THEN '' WHEN 'src2' THEN NULL
 WHEN 'src3' THEN '/jobs/1' WHEN 'src4' THEN 'https://a.example.com/b c/' || doc_id
 ELSE 'HTTPS://Jobs.Example.com:443/' || doc_id END"""
_CHECKED_SQL = f"""checked AS (SELECT *, concat_ws('; ', CASE WHEN t IS NULL THEN 'title: field required'
 WHEN trim(t, ' ' || chr(9)) = '' THEN 'title cannot be empty or whitespace' END, CASE WHEN coalesce(u, '') = ''
 THEN 'url cannot be empty' WHEN source IN ('src0', 'src3') THEN 'url: invalid http(s) URL' END) AS error
 FROM (SELECT *, {_RAW_TITLE} AS t, {_RAW_URL} AS u FROM documents))"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").selectExpr(
        "doc_id", f"{_RAW_TITLE} AS title", f"{_RAW_URL} AS url",
        "' ' || source || chr(10) AS company_name", "CASE WHEN lang = 'fr' THEN '   ' ELSE lang END AS department",
        "CAST(NULL AS STRING) AS location", "text AS description_text", "n_chars AS undeclared",
    ).drop("undeclared")


@query(
    "v1_valid_jobs",
    f"""WITH {_CHECKED_SQL} SELECT doc_id, trim(t) AS title, CASE WHEN source = 'src4'
     THEN 'https://a.example.com/b%20c/' || doc_id ELSE 'https://jobs.example.com/' || doc_id END AS url,
    source AS company_name, CASE WHEN lang <> 'fr' THEN lang END AS department, CAST(NULL AS VARCHAR) AS location,
    md5(text) AS description FROM checked WHERE error = ''""",
)
def valid(spark: SparkSession, sf: str) -> DataFrame:
    jobs = validate.valid_jobs(validate.check_jobs(_raw(spark, sf)))
    return jobs.select(
        "doc_id", "title", "url", "company_name", "department", "location", F.md5("description_text").alias("description")
    )


@query(
    "v1_invalid_jobs",
    f"WITH {_CHECKED_SQL} SELECT doc_id, t AS raw_title, u AS raw_url, error FROM checked WHERE error <> ''",
)
def invalid(spark: SparkSession, sf: str) -> DataFrame:
    rows = validate.invalid_jobs(validate.check_jobs(_raw(spark, sf)))
    return rows.select("doc_id", F.col("job.title").alias("raw_title"), F.col("job.url").alias("raw_url"), "error")


@query(
    "a14_validation_summary",
    f"WITH {_CHECKED_SQL} SELECT count(*) FILTER (error <> '') AS invalid, count(*) AS total FROM checked",
)
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validation_summary(validate.check_jobs(_raw(spark, sf)))


@query(
    "v7_text_guard",
    "SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND trim(text, ' ' || chr(10)) <> ''",
)
def text_guard(spark: SparkSession, sf: str) -> DataFrame:
    """System turns are blanked, then the guard drops them."""
    turns = load(spark, sf, "conversations").withColumn(
        "body", F.when(F.col("role") == "system", F.lit(" \n ")).otherwise(F.col("text"))
    )
    return validate.with_text(turns, "body").select("conv_id", "turn")


@query(
    "v8_state_check",
    """SELECT event_id, status FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click'
    THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN NULL ELSE 'unknown' END AS status FROM events)
    WHERE status IS NULL OR status <> 'unknown'""",
)
def state_check(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr(
        """CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed'
        WHEN 'signup' THEN NULL ELSE 'unknown' END"""
    )
    return validate.valid_states(load(spark, sf, "events").select("event_id", status.alias("status")))


_REASON_SQL = f"""WITH {POSTINGS_SQL}, shares AS (SELECT *, title || ' ' || description_text || coalesce(' ' || location, '')
 || ' ' || company_name AS body FROM postings), screened AS (SELECT pos, CASE
 WHEN NOT coalesce(contains(location, 'ISRAEL'), false) THEN 'job_not_in_israel'
 WHEN length(regexp_replace(body, '[^\\x{{00C0}}-\\x{{00FF}}]', '', 'g'))::DOUBLE
  / nullif(length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')), 0) > 0.1 THEN 'hebrew'
 WHEN lower(trim(department)) = 'general' THEN 'general_department' END AS reject_reason FROM shares)"""


@query("f4_reject_reasons", f"{_REASON_SQL} SELECT pos, reject_reason FROM screened")
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return screening.screen(postings(spark, sf), block=LATIN_LETTERS).select("pos", "reject_reason")


@query(
    "a5_reject_counts",
    f"""{_REASON_SQL} SELECT count(*) FILTER (reject_reason = 'hebrew') AS hebrew,
    count(*) FILTER (reject_reason = 'general_department') AS general_department,
    count(*) FILTER (reject_reason = 'job_not_in_israel') AS job_not_in_israel,
    count(*) FILTER (reject_reason IS NULL) AS valid FROM screened""",
)
def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    return screening.reject_counts(screening.screen(postings(spark, sf), block=LATIN_LETTERS))


@query(
    "f1_f3_country_and_department",
    f"""WITH {POSTINGS_SQL} SELECT pos, coalesce(contains(location, 'ISRAEL'), false) AS in_country,
    coalesce(lower(trim(department)) = 'general', false) AS general FROM postings""",
)
def country_and_department(spark: SparkSession, sf: str) -> DataFrame:
    return postings(spark, sf).select(
        "pos",
        screening.in_country(F.col("location")).alias("in_country"),
        screening.is_general(F.col("department")).alias("general"),
    )


@query(
    "d1_hard_filter",
    f"""WITH {POSTINGS_SQL} SELECT pos, department, location FROM postings WHERE (contains(location, 'TEL AVIV')
     OR contains(location, 'Berlin')) AND department IN ('Sales', 'engineering')
    AND coalesce(experience_level <> 'Intern', true) AND workplace_type <> 'Remote'""",
)
def hard_filtered(spark: SparkSession, sf: str) -> DataFrame:
    kept = screening.hard_filter(
        postings(spark, sf), ["TEL AVIV", "Berlin"], ["Sales", "engineering"],
        exclude_internships=True, exclude_remote=True,
    )
    return kept.select("pos", "department", "location")
