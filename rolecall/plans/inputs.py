"""Job-shaped views of the given tables, as Spark frames and as SQL common table expressions.

Every view maps all rows of its tables; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall import reference_data

# Latin-1 letters stand in for the rejected script in the given texts.
LATIN_LETTERS = ("À", "ÿ")

_DEPARTMENT = """CASE source WHEN 'src0' THEN ' General ' WHEN 'src1' THEN 'r&d' WHEN 'src2' THEN ' QA'
 WHEN 'src3' THEN 'bizdev' WHEN 'src4' THEN 'People Ops' WHEN 'src5' THEN 'engineering'
 WHEN 'src6' THEN 'Wizardry' WHEN 'src7' THEN '   ' WHEN 'src8' THEN 'legal' ELSE 'Sales' END"""
_LOCATION = """CASE lang WHEN 'en' THEN CASE WHEN n_chars < 1000 THEN 'tlv, ISRAEL' ELSE 'TEL AVIV, ISRAEL' END
 WHEN 'fr' THEN 'Haifa, ISRAEL' WHEN 'de' THEN 'Berlin, DE' END"""
_WORKPLACE = "CASE WHEN n_chars < 1000 THEN 'Remote' WHEN n_chars < 2000 THEN 'Hybrid' ELSE 'On-site' END"
_EXPERIENCE = "CASE lang WHEN 'en' THEN 'Senior' WHEN 'fr' THEN 'Junior' WHEN 'de' THEN 'Intern' END"

POSTINGS_SQL = f"""postings AS (SELECT doc_id AS pos, '  ' || source || ' ' || lang || ' ' AS title,
 source AS company_name, {_DEPARTMENT} AS department, {_LOCATION} AS location, {_WORKPLACE} AS workplace_type,
 {_EXPERIENCE} AS experience_level, 'https://jobs.example.com/' || md5(text) AS url, text AS description_text,
 n_chars FROM documents)"""


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """One posting per document; equal texts share a URL."""
    return load(spark, sf, "documents").selectExpr(
        "doc_id AS pos",
        "'  ' || source || ' ' || lang || ' ' AS title",
        "source AS company_name",
        f"{_DEPARTMENT} AS department",
        f"{_LOCATION} AS location",
        f"{_WORKPLACE} AS workplace_type",
        f"{_EXPERIENCE} AS experience_level",
        "'https://jobs.example.com/' || md5(text) AS url",
        "text AS description_text",
        "CAST(NULL AS MAP<STRING, STRING>) AS description_map",
        "n_chars",
    )


COMPANIES_SQL = """companies AS (SELECT c_custkey AS id, c_name AS company_name, lower(c_mktsegment) AS domain,
 'https://' || lower(c_mktsegment) || '.example.com/' || c_custkey AS company_page_url, c_acctbal >= 0 AS is_active,
 TIMESTAMP '2024-01-01 00:00:00' + n_regionkey * INTERVAL 1 DAY AS discovered_at, l.last_scraped
 FROM customer JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT user_id, max(ts) AS last_scraped FROM events GROUP BY user_id) l ON l.user_id = c_custkey)"""


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """One company per customer; its last scrape is the user's last event."""
    last = load(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.max(F.col("ts").cast("timestamp_ntz")).alias("last_scraped")
    )
    base = load(spark, sf, "customer").join(
        load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    day = F.make_dt_interval(days=F.col("n_regionkey"))
    return base.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("company_name"),
        F.lower("c_mktsegment").alias("domain"),
        F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/"), F.col("c_custkey")).alias(
            "company_page_url"
        ),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        (moment("2024-01-01 00:00:00") + day).alias("discovered_at"),
    ).join(last, "id", "left")


ORDER_JOBS_SQL = """order_jobs AS (SELECT 'https://jobs.example.com/o/' || o_orderkey AS url,
 'Customer ' || o_custkey AS company_name, o_orderpriority AS workplace_type, o_orderstatus AS experience_level,
 CASE WHEN o_totalprice > 250000 THEN 'Full-time' ELSE 'Contract' END AS employment_type,
 CAST(left(o_orderpriority, 1) AS BIGINT) AS department_id, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS BIGINT) AS location_id,
 o_orderdate AS scraped_at FROM orders)"""


def order_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One stored posting per order."""
    return load(spark, sf, "orders").selectExpr(
        "'https://jobs.example.com/o/' || o_orderkey AS url",
        "'Customer ' || o_custkey AS company_name",
        "o_orderpriority AS workplace_type",
        "o_orderstatus AS experience_level",
        "CASE WHEN o_totalprice > 250000 THEN 'Full-time' ELSE 'Contract' END AS employment_type",
        "CAST(left(o_orderpriority, 1) AS BIGINT) AS department_id",
        "CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS BIGINT) AS location_id",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) AS scraped_at",
    )


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def shown(at: str) -> Column:
    """Second-precise text of a time, the same in both engines."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias(at)


def shown_sql(at: str) -> str:
    return f"strftime({at}, '%Y-%m-%d %H:%M:%S') AS {at}"


def _values(rows: tuple) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join([str(i), *map(quote, row)]) + ")" for i, row in enumerate(rows, 1))


DIMENSIONS_SQL = f"""departments(id, canonical_name, category) AS (VALUES {_values(reference_data.DEPARTMENTS)}),
department_seed(id, synonym, canonical_name) AS (VALUES {_values(reference_data.DEPARTMENT_SYNONYMS)}),
department_synonyms AS (SELECT s.id, s.synonym, d.id AS department_id FROM department_seed s
 JOIN departments d USING (canonical_name)),
locations(id, canonical_name, country, region) AS (VALUES {_values(reference_data.LOCATIONS)}),
location_seed(id, synonym, canonical_name) AS (VALUES {_values(reference_data.LOCATION_SYNONYMS)}),
location_synonyms AS (SELECT s.id, s.synonym, d.id AS location_id FROM location_seed s
 JOIN locations d USING (canonical_name))"""


def folded_sql(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


NORMALISED_SQL = f"""{POSTINGS_SQL}, {DIMENSIONS_SQL},
keyed AS (SELECT *, {folded_sql("nullif(trim(department), '')")} AS dkey,
 {folded_sql("nullif(trim(string_split(location, ',')[1]), '')")} AS lkey FROM postings),
normalised AS (SELECT k.*,
 CAST(coalesce((SELECT min(department_id) FROM department_synonyms s WHERE {folded_sql("s.synonym")} = k.dkey),
  (SELECT min(id) FROM departments d WHERE {folded_sql("d.canonical_name")} = k.dkey)) AS BIGINT) AS department_id,
 CAST(coalesce((SELECT min(location_id) FROM location_synonyms s WHERE {folded_sql("s.synonym")} = k.lkey),
  (SELECT min(id) FROM locations d WHERE {folded_sql("d.canonical_name")} = k.lkey)) AS BIGINT) AS location_id
 FROM keyed k)"""


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "departments": reference_data.departments(spark),
        "department_synonyms": reference_data.department_synonyms(spark),
        "locations": reference_data.locations(spark),
        "location_synonyms": reference_data.location_synonyms(spark),
    }


def cv_row(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of the lowest id plays the CV; one aggregated row."""
    return load(spark, sf, "embeddings").agg(F.min_by("embedding", "vec_id").alias("embedding"))


SCORED_SQL = """cv AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings),
scored AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM cv)::DOUBLE[])
 AS similarity_score FROM embeddings)"""
