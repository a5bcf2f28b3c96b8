"""Dedupe, numbering and table maintenance over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.urls import url_hash
from rolecall.operators import dedupe, tables
from rolecall.operators.extract import details_to_map
from rolecall.operators.numbering import number_rows
from rolecall.operators.screening import kept_jobs, screen
from rolecall.operators.validate import check_jobs, valid_jobs
from rolecall.plans.inputs import (
    COMPANIES_SQL,
    LATIN_LETTERS,
    NORMALISED_SQL,
    companies,
    dimensions,
    load,
    moment,
    postings,
    shown,
    shown_sql,
)
from rolecall.plans.registry import query
from rolecall.schemas import COMPANY, JOB

NOW = "2024-02-01 08:00:00"


@query(
    "w1_unique_companies",
    """SELECT min(doc_id) AS doc_id, md5(text) AS company_page_url FROM documents WHERE lang <> 'es' GROUP BY 2""",
)
def unique_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Texts play page URLs; Spanish documents have none."""
    url = F.when(F.col("lang") == "es", F.lit("")).otherwise(F.md5("text"))
    rows = load(spark, sf, "documents").select("doc_id", url.alias("company_page_url"))
    return dedupe.unique_companies(rows, "doc_id")


@query(
    "w2_unique_jobs",
    "SELECT min(p_partkey) AS p_partkey, p_name AS title, nullif(p_brand, 'Brand#7') AS company FROM part GROUP BY 2, 3",
)
def unique_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.nullif("p_brand", F.lit("Brand#7")).alias("company")
    )
    return dedupe.unique_jobs(rows, "p_partkey")


@query(
    "w4_last_wins",
    """SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(props, event_id) AS props
    FROM events GROUP BY 1, 2""",
)
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_type", "event_id", "props")
    return dedupe.last_by_key(rows, ["user_id", "event_type"], "event_id")


@query(
    "w4_last_detail",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS about, p_name AS other FROM part""",
)
def last_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal detail names within a posting the last value stays."""
    second = F.when(F.col("p_size") > 25, F.lit("ABOUT")).otherwise(F.lit("Unused"))
    names = F.array(F.lit("About"), F.lit("Other"), second)
    details = details_to_map(names, F.array("p_brand", "p_name", "p_type"))
    rows = load(spark, sf, "part").select("p_partkey", details.alias("d"))
    return rows.select("p_partkey", F.col("d")["about"].alias("about"), F.col("d")["other"].alias("other"))


@query(
    "w5_row_ids",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS id FROM orders",
)
def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return number_rows(orders, ["o_orderdate", "o_orderkey"], "id", 1001).drop("o_orderdate")


def _stored_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Solvent customers are the companies on file."""
    rows = companies(spark, sf).where("is_active")
    return rows.select(
        "id", "company_name", "domain", "company_page_url", F.lit(None).cast("string").alias("title"),
        "discovered_at", "last_scraped", "is_active", F.lit("import").alias("source"),
    )


@query(
    "m1_insert_companies",
    f"""WITH {COMPANIES_SQL}, top AS (SELECT max(id) AS m FROM companies WHERE is_active)
    SELECT m + row_number() OVER (ORDER BY id) AS id, company_name, company_page_url, domain, true AS is_active,
    'google_serper' AS source FROM companies, top WHERE NOT is_active
    UNION ALL SELECT id, company_name, company_page_url, domain, true, 'import' FROM companies WHERE is_active""",
)
def insert_companies(spark: SparkSession, sf: str) -> DataFrame:
    """All customers, each twice, offered to the table of solvent ones."""
    every = companies(spark, sf).select(F.col("id").alias("pos"), "company_name", "domain", "company_page_url")
    again = every.select((F.col("pos") + F.lit(10**9)).alias("pos"), "company_name", "domain", "company_page_url")
    table = _stored_companies(spark, sf)
    stored = table.select(*[F.col(f.name).cast(f.dataType) for f in COMPANY.fields])
    change = tables.insert_companies(stored, every.unionByName(again), "pos", F.lit(NOW).cast("timestamp"))
    return change.snapshot.select("id", "company_name", "company_page_url", "domain", "is_active", "source")


def _stored_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Long documents are the postings on file."""
    rows = postings(spark, sf).where(F.col("n_chars") >= 2000)
    return rows.select(url_hash(F.col("url")).alias("url_hash"), F.col("pos").alias("id")).dropDuplicates(["url_hash"])


_FRESH_SQL = f"""{NORMALISED_SQL}, firsts AS (SELECT * FROM normalised QUALIFY row_number() OVER (PARTITION BY url
 ORDER BY pos) = 1), fresh AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM normalised s
 WHERE s.n_chars >= 2000 AND s.url = f.url))"""


def _incoming(spark: SparkSession, sf: str) -> DataFrame:
    jobs = postings(spark, sf).drop("n_chars")
    return jobs.withColumn("title", F.trim("title"))


@query(
    "m2_insert_jobs",
    f"""WITH {_FRESH_SQL} SELECT 5000000 + row_number() OVER (ORDER BY pos) AS id, trim(title) AS title, md5(url) AS url_hash,
    'jobs.example.com' AS from_domain, department_id, location_id, md5(description_text) AS description,
    CAST(NULL AS VARCHAR) AS employment_type, workplace_type, md5(trim(trim(title) || chr(10) || chr(10)
     || description_text, ' ' || chr(10))) AS embed_text FROM fresh""",
)
def insert_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting offered to the table of long ones; the delta comes back in stored form."""
    incoming = _incoming(spark, sf).withColumn("employment_type", F.lit(None).cast("string"))
    delta = tables.insert_jobs(
        _stored_jobs(spark, sf), incoming, "pos", as_of=F.lit(NOW).cast("timestamp"), first_id=5_000_001,
        **dimensions(spark),
    )
    return delta.select(
        "id", "title", "url_hash", "from_domain", "department_id", "location_id",
        F.md5("description").alias("description"), "employment_type", "workplace_type",
        F.md5("embed_text").alias("embed_text"),
    )


@query(
    "m3_persist_jobs",
    f"""WITH {_FRESH_SQL} SELECT md5(url) AS url_hash, 'Full-time' AS employment_type, md5(trim(description_text,
     ' ' || chr(10))) AS embed_text FROM fresh WHERE trim(description_text, ' ' || chr(10)) <> ''""",
)
def persist_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """As above with blank titles and without an employment column: its default fills in."""
    incoming = _incoming(spark, sf).withColumn("title", F.lit(" "))
    delta = tables.persist_jobs(
        _stored_jobs(spark, sf), incoming, "pos", as_of=F.lit(NOW).cast("timestamp"), **dimensions(spark)
    )
    return delta.select("url_hash", "employment_type", F.md5("embed_text").alias("embed_text"))


@query(
    "daily_batch",
    f"""WITH {NORMALISED_SQL}, bodies AS (SELECT *, trim(title) || ' ' || description_text || ' ' || location || ' '
     || company_name AS body FROM normalised WHERE contains(location, 'ISRAEL')),
    kept AS (SELECT * FROM bodies WHERE coalesce(length(regexp_replace(body, '[^\\x{{00C0}}-\\x{{00FF}}]', '', 'g'))::DOUBLE
     / nullif(length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')), 0) <= 0.1, true)
     AND coalesce(lower(trim(department)) <> 'general', true)),
    firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)
    SELECT row_number() OVER (ORDER BY pos) AS id, md5(url) AS url_hash, trim(title) AS title, department_id, location_id,
    md5(description_text) AS description FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM normalised s
     WHERE s.n_chars >= 2000 AND s.url = f.url)""",
)
def daily_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The main path: validate, screen, drop known and repeated postings, normalise, number."""
    raw = postings(spark, sf).drop("n_chars").withColumn("url", F.replace("url", F.lit("https:"), F.lit("HTTPS:")))
    valid = valid_jobs(check_jobs(raw))
    kept = kept_jobs(screen(valid, block=LATIN_LETTERS))
    delta = tables.insert_jobs(
        _stored_jobs(spark, sf), kept, "pos", as_of=F.lit(NOW).cast("timestamp"), first_id=1, **dimensions(spark)
    )
    return delta.select(
        "id", "url_hash", "title", "department_id", "location_id", F.md5("description").alias("description")
    )


@query(
    "m4_touch",
    f"""WITH {COMPANIES_SQL}, touched AS (SELECT id, CASE WHEN domain = 'building' THEN TIMESTAMP '{NOW}'
     ELSE last_scraped END AS last_scraped FROM companies) SELECT id, {shown_sql('last_scraped')} FROM touched""",
)
def touch(spark: SparkSession, sf: str) -> DataFrame:
    table = companies(spark, sf)
    scraped = table.where(F.col("domain") == "building").select("company_page_url")
    return tables.touch_companies(table, scraped, moment(NOW)).select("id", shown("last_scraped"))


@query(
    "m5_deactivate",
    f"WITH {COMPANIES_SQL} SELECT id, is_active AND domain <> 'machinery' AS is_active FROM companies",
)
def deactivate(spark: SparkSession, sf: str) -> DataFrame:
    table = companies(spark, sf)
    closed = table.where(F.col("domain") == "machinery").select("company_page_url")
    return tables.deactivate_companies(table, closed).select("id", "is_active")


@query(
    "m6_delete",
    """SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus <> 'P') AS kept,
    count(*) FILTER (o_orderstatus = 'P') AS removed FROM orders GROUP BY 1""",
)
def delete(spark: SparkSession, sf: str) -> DataFrame:
    jobs = load(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    doomed = jobs.where(F.col("o_orderstatus") == "P").select("o_orderkey")
    change = tables.delete_by_url(jobs.withColumn("o_orderkey", F.col("o_orderkey").cast("string")),
                                  doomed.select(F.col("o_orderkey").cast("string")), "o_orderkey")
    sides = change.snapshot.withColumn("gone", F.lit(False)).unionByName(change.rows.withColumn("gone", F.lit(True)))
    return sides.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count_if(~F.col("gone")).alias("kept"), F.count_if("gone").alias("removed")
    )


def _supplier_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"),
        F.col("s_nationkey").cast("string").alias("category"),
    )


@query(
    "m7_update_dimension",
    """SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN s_name || ' (debt)' ELSE s_name END AS canonical_name,
    CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS VARCHAR) END AS category FROM supplier""",
)
def update_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Indebted suppliers are renamed and lose their category."""
    changes = load(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit(" "), F.col("s_name"), F.lit(" (debt) ")).alias("canonical_name"),
        F.lit("  ").alias("category"),
    )
    return tables.update_dimension(_supplier_dimension(spark, sf), changes).snapshot


@query(
    "m7_insert_dimension",
    """WITH names AS (SELECT DISTINCT c_mktsegment AS n FROM customer UNION SELECT DISTINCT s_name FROM supplier),
    fresh AS (SELECT n FROM names WHERE n NOT IN (SELECT s_name FROM supplier))
    SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n) AS id, n AS canonical_name FROM fresh
    UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def insert_dimension(spark: SparkSession, sf: str) -> DataFrame:
    dimension = _supplier_dimension(spark, sf)
    segments = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("canonical_name"))
    offered = segments.unionByName(dimension.select("canonical_name"))
    return tables.insert_dimension(dimension, offered).snapshot.select("id", "canonical_name")


@query(
    "m7_add_synonyms",
    """SELECT row_number() OVER (ORDER BY p_name) AS id, p_name AS synonym, min(s_suppkey) AS supplier_id FROM part
    JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_name""",
)
def add_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Each part name goes to the lowest of the suppliers that deliver it."""
    delivered = load(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("supplier_id")).distinct()
    named = delivered.join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    offered = named.select(F.col("p_name").alias("synonym"), "supplier_id")
    empty = spark.createDataFrame([], "id BIGINT, synonym STRING, supplier_id BIGINT")
    return tables.add_synonyms(empty, _supplier_dimension(spark, sf), offered, "supplier_id").snapshot


@query(
    "m7_refused",
    """WITH one AS (SELECT arg_min(s_name, s_suppkey) AS name, min(s_suppkey) AS id FROM supplier)
    SELECT 'insert' AS change, NULL::BIGINT AS id, s_name AS name FROM supplier UNION ALL SELECT 'insert', NULL, NULL FROM nation
    UNION ALL SELECT 'update', s_suppkey, name FROM supplier, one WHERE s_suppkey <> id
    UNION ALL SELECT 'update', n_nationkey, NULL FROM nation
    UNION ALL SELECT 'synonym', -1 - s_suppkey, 'S ' || s_suppkey FROM supplier UNION ALL SELECT 'synonym', s_suppkey, NULL FROM supplier""",
)
def refused(spark: SparkSession, sf: str) -> DataFrame:
    """What each change refuses: known and blank names, the name of another row, synonyms of unknown rows and blank ones."""
    dimension, supplier = _supplier_dimension(spark, sf), load(spark, sf, "supplier")
    key, nations = F.col("s_suppkey"), load(spark, sf, "nation")
    blank = nations.select(F.lit("  ").alias("canonical_name"))
    fresh = supplier.select(F.concat(F.lit("new "), F.col("s_name")).alias("canonical_name"))
    inserted = tables.insert_dimension(dimension, dimension.select("canonical_name").unionByName(blank).unionByName(fresh)).rows
    first = supplier.agg(F.min_by("s_name", "s_suppkey")).scalar()
    changes = supplier.select(key.alias("id"), first.alias("canonical_name"), F.lit("c").alias("category")).unionByName(
        nations.select(F.col("n_nationkey").alias("id"), F.lit(" ").alias("canonical_name"), F.lit("c").alias("category"))
    )
    updated = tables.update_dimension(dimension, changes).rows
    named = F.concat(F.lit("S "), key)
    offered = supplier.select(F.inline(F.array(
        F.struct(named.alias("synonym"), (-key - 1).alias("supplier_id")), F.struct(F.lit(" ").alias("synonym"), key.alias("supplier_id")),
        F.struct(F.concat(F.lit("known "), key).alias("synonym"), key.alias("supplier_id")),
    )))
    empty = spark.createDataFrame([], "id BIGINT, synonym STRING, supplier_id BIGINT")
    added = tables.add_synonyms(empty, dimension, offered, "supplier_id").rows
    tagged = lambda change, rows, id_, name: rows.select(F.lit(change).alias("change"), id_.cast("long").alias("id"), F.col(name).alias("name"))
    return (
        tagged("insert", inserted, F.lit(None), "canonical_name")
        .unionByName(tagged("update", updated, F.col("id"), "canonical_name"))
        .unionByName(tagged("synonym", added, F.col("supplier_id"), "synonym"))
    )


@query(
    "m8_delete_dimension",
    """WITH doomed AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
    left_over AS (SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM doomed))
    SELECT 'dimension' AS part, count(*) AS rows FROM left_over
    UNION ALL SELECT 'synonyms', count(*) FROM left_over
    UNION ALL SELECT 'linked jobs', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM left_over)
    UNION ALL SELECT 'unlinked jobs', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM doomed)""",
)
def delete_dimension(spark: SparkSession, sf: str) -> DataFrame:
    supplier = load(spark, sf, "supplier")
    synonyms = supplier.select(F.col("s_name").alias("synonym"), F.col("s_suppkey").alias("supplier_id"))
    jobs = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("supplier_id"))
    doomed = supplier.where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("id"))
    after = tables.delete_dimension(_supplier_dimension(spark, sf), synonyms, jobs, doomed, "supplier_id")
    size = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"))
    linked = after.jobs.agg(
        F.array(
            F.struct(F.lit("linked jobs").alias("part"), F.count("supplier_id").alias("rows")),
            F.struct(F.lit("unlinked jobs").alias("part"), F.count_if(F.col("supplier_id").isNull()).alias("rows")),
        ).alias("sides")
    ).select(F.inline("sides"))
    return size(after.dimension, "dimension").unionByName(size(after.synonyms, "synonyms")).unionByName(linked)


@query(
    "m8_delete_synonyms",
    "SELECT s_suppkey AS id, s_name AS synonym FROM supplier WHERE s_nationkey <> 3",
)
def delete_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    synonyms = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("synonym"))
    doomed = load(spark, sf, "supplier").where(F.col("s_nationkey") == 3).select(F.col("s_name").alias("synonym"))
    return tables.delete_synonyms(synonyms, doomed)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and views are batches: views are still processing."""
    events = load(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    status = F.when(F.col("event_type") == "view", F.lit("processing")).otherwise(F.lit("completed"))
    return events.select(
        F.col("event_id").cast("string").alias("batch_id"), status.alias("status"),
        F.lit(NOW).cast("timestamp").alias("created_at"),
    )


@query(
    "m9_ledger",
    """SELECT event_id::VARCHAR AS batch_id, CASE event_type WHEN 'view' THEN CASE WHEN value > 20 THEN 'failed'
     ELSE 'processing' END WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status FROM events""",
)
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Register all events as batches, then fail the dear views; bad states and unknown ids change nothing."""
    events = load(spark, sf, "events")
    offered = events.select(F.col("event_id").cast("string").alias("batch_id"))
    table = tables.add_batches(_ledger(spark, sf), offered, F.lit(NOW).cast("timestamp"))
    views = events.where(F.col("event_type") == "view")
    status = F.when(F.col("value") > 20, F.lit("failed")).otherwise(F.lit("lost"))
    updates = views.select(F.col("event_id").cast("string").alias("batch_id"), status.alias("status"))
    return tables.set_batch_status(table, updates).select("batch_id", "status")


@query(
    "m10_batch_state",
    """SELECT event_id::VARCHAR AS batch_id, CASE WHEN value < 10 THEN 'ingest' WHEN value < 20 THEN 'fail'
     WHEN value < 40 THEN 'wait' ELSE 'warn' END AS action, CASE WHEN value < 10 THEN 'completed' WHEN value < 20
     THEN 'failed' ELSE 'processing' END AS next_status FROM events WHERE event_type = 'view'""",
)
def batch_state(spark: SparkSession, sf: str) -> DataFrame:
    remote = load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("batch_id"),
        F.expr(
            """CASE WHEN value < 10 THEN 'completed' WHEN value < 20 THEN 'failed' WHEN value < 30 THEN 'in_progress'
            WHEN value < 40 THEN 'validating' ELSE 'expired' END"""
        ).alias("status"),
    )
    return tables.route_batches(_ledger(spark, sf), remote).select("batch_id", "action", "next_status")


@query(
    "m11_ensure_column",
    "SELECT doc_id, true AS lacks_vector, source FROM documents",
)
def ensured(spark: SparkSession, sf: str) -> DataFrame:
    vector = next(f.dataType for f in JOB.fields if f.name == "embedding")
    old = tables.ensure_column(load(spark, sf, "documents"), "embedding", vector)
    same = tables.ensure_column(old, "source", T.StringType())
    return same.select("doc_id", F.col("embedding").isNull().alias("lacks_vector"), "source")


@query(
    "d8_status",
    """SELECT user_id AS job_id, arg_max(event_type, event_id) AS status FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) WHERE r = 1 GROUP BY 1""",
)
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    log = load(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("changed_at")
    )
    return tables.latest_status(log).select("job_id", "status")
