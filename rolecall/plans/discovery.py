"""Search results, search log and landed company files over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators import discovery, tables
from rolecall.plans.inputs import load, moment, shown, shown_sql
from rolecall.plans.registry import query
from rolecall.plans.scalars import NETLOC_SQL
from rolecall.session import shared_path
from rolecall.sources.readers import read_legacy_companies
from rolecall.sources.writers import write_json_arrays


def _result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One search result page per web page: two organic hits, or none for pages in Spanish."""
    hit = lambda title, link: F.struct(title.alias("title"), link.alias("link"))
    site = F.concat(F.lit("https://www.comeet.com/jobs/"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("/1.00"))
    own = hit(F.concat(F.lit("Jobs at Firm "), F.col("page_id"), F.lit(" - Comeet")), F.concat(site, F.lit("/dev/2")))
    blank = hit(F.lit("Jobs at  - Comeet"), F.col("url"))
    full = F.to_json(F.array(F.struct(F.array(own, blank).alias("organic"))))
    payload = F.when(F.col("url").contains("/es/"), F.lit('[{"credits":1}]')).otherwise(full)
    return load(spark, sf, "pages").select("page_id", F.lit("comeet.com").alias("domain"), payload.alias("payload"))


_HITS_SQL = f"""hits AS (SELECT page_id, 'Firm ' || page_id AS company_name, 'https://www.comeet.com/jobs/'
 || {NETLOC_SQL} || '/1.00' AS company_page_url FROM pages WHERE url NOT LIKE '%/es/%')"""


@query(
    "s13_search_hits",
    """SELECT page_id, 0::BIGINT AS hit_pos, 'Jobs at Firm ' || page_id || ' - Comeet' AS title FROM pages
    WHERE url NOT LIKE '%/es/%' UNION ALL SELECT page_id, 1, 'Jobs at  - Comeet' FROM pages WHERE url NOT LIKE '%/es/%'""",
)
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = discovery.search_hits(_result_pages(spark, sf))
    return hits.select("page_id", F.col("hit_pos").cast("long").alias("hit_pos"), "title")


@query("f14_named_companies", f"WITH {_HITS_SQL} SELECT page_id, company_name, company_page_url FROM hits")
def named_companies(spark: SparkSession, sf: str) -> DataFrame:
    companies = discovery.hits_to_companies(discovery.search_hits(_result_pages(spark, sf)))
    return companies.select("page_id", "company_name", "company_page_url")


@query(
    "a9_new_companies",
    f"""WITH {_HITS_SQL}, known AS (SELECT company_page_url FROM hits JOIN pages USING (page_id) WHERE url LIKE 'https:%')
    SELECT 'comeet.com' AS domain, count(DISTINCT company_page_url) FILTER (company_page_url NOT IN
     (SELECT company_page_url FROM known)) AS new_companies, count(*) AS results FROM hits""",
)
def new_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Companies found on https pages are on file already."""
    found = discovery.hits_to_companies(discovery.search_hits(_result_pages(spark, sf)))
    secure = load(spark, sf, "pages").where(F.col("url").startswith("https:")).select("page_id")
    known = found.join(secure, "page_id", "left_semi").select("company_page_url")
    return discovery.discovery_counters(tables.mark_new(found, known, "company_page_url", "page_id"))


@query(
    "d5_search_due",
    f"""WITH last AS (SELECT event_type || '-' || user_id AS domain, max(ts) AS last_searched FROM events
     WHERE event_type <> 'error' GROUP BY 1), domains AS (SELECT DISTINCT event_type || '-' || user_id AS domain FROM events)
    SELECT domain, {shown_sql('last_searched')} FROM domains LEFT JOIN last USING (domain)
    WHERE last.last_searched IS NULL OR last.last_searched < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR""",
)
def search_due(spark: SparkSession, sf: str) -> DataFrame:
    """Events are searches of a domain; errors were never logged."""
    domain = F.concat_ws("-", "event_type", "user_id")
    events = load(spark, sf, "events").withColumn("domain", domain)
    searches = events.where(F.col("event_type") != "error").select(
        "domain", F.col("props").alias("query"), F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp_ntz").alias("searched_at"), F.col("event_id").alias("results_count"),
    )
    due = discovery.domains_due(searches, events.select("domain").distinct(), moment("2024-01-30 12:00:00"), 24)
    return due.select("domain", shown("last_searched"))


@query(
    "d5_search_log",
    """SELECT event_type AS source, count(*) AS searches, CAST(sum(k) AS BIGINT) AS results FROM (SELECT event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """Views are on the log; all other events are appended to it."""
    events = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("domain"), F.col("props").alias("query"),
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("results_count"),
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    log = events.where(F.col("source") == "view").withColumn("searched_at", now)
    full = discovery.log_search(log, events.where(F.col("source") != "view"), now)
    return full.groupBy("source").agg(F.count("*").alias("searches"), F.sum("results_count").alias("results"))


@query(
    "s15_legacy_companies",
    f"""SELECT c_name AS company_name, 'https://old.example.com/' || c_custkey AS company_page_url,
    {shown_sql('discovered_at')} FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * c_nationkey
     AS discovered_at FROM customer) c""",
)
def legacy_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Old records landed as JSON arrays, read back, renamed, epoch seconds to times."""
    path = shared_path(spark, "legacy")
    old = load(spark, sf, "customer").select(
        F.col("c_name").alias("company_name"), F.lit("comeet.com").alias("domain"),
        F.concat(F.lit("https://old.example.com/"), F.col("c_custkey")).alias("job_page_url"),
        F.lit("t").alias("title"), (F.lit(1704067200) + F.col("c_nationkey")).cast("double").alias("discovered_at"),
        F.lit(None).cast("double").alias("last_scraped"),
    )
    write_json_arrays(old, path)
    found = discovery.legacy_companies(read_legacy_companies(spark, path))
    utc = F.to_utc_timestamp("discovered_at", F.current_timezone())
    return found.withColumn("discovered_at", utc).select("company_name", "company_page_url", shown("discovered_at"))
