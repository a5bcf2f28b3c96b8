"""Filters, lookups, counts, reference joins and distributions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions.urls import url_hash
from rolecall.operators import dimensions, lookup, reports
from rolecall.operators.joins import drop_known
from rolecall.operators.numbering import number_rows
from rolecall.plans.inputs import (
    COMPANIES_SQL,
    NORMALISED_SQL,
    ORDER_JOBS_SQL,
    companies,
    load,
    moment,
    order_jobs,
    postings,
    shown,
    shown_sql,
)
from rolecall.plans.inputs import dimensions as seed_dimensions
from rolecall.plans.registry import query
from rolecall.reference_data import resolve_synonyms


@query(
    "s1_all_companies",
    f"WITH {COMPANIES_SQL} SELECT id, company_name, company_page_url, {shown_sql('discovered_at')} FROM companies WHERE is_active",
)
def all_companies(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.companies(companies(spark, sf)).select("id", "company_name", "company_page_url", shown("discovered_at"))


@query(
    "l1_newest_companies",
    f"""WITH {COMPANIES_SQL} SELECT id, {shown_sql('discovered_at')} FROM companies
    ORDER BY companies.discovered_at DESC, company_page_url LIMIT 25""",
)
def newest_companies(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.companies(companies(spark, sf), active_only=False, limit=25).select("id", shown("discovered_at"))


@query(
    "f5_equal_filters",
    f"""WITH {ORDER_JOBS_SQL} SELECT url, department_id, {shown_sql('scraped_at')} FROM order_jobs
    WHERE workplace_type = '1-URGENT' AND experience_level = 'O' AND employment_type = 'Full-time'
    ORDER BY order_jobs.scraped_at DESC, url LIMIT 100""",
)
def equal_filters(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.jobs_by_filters(order_jobs(spark, sf), "1-URGENT", "O", "Full-time", department_id=0, limit=100)
    return found.select("url", "department_id", shown("scraped_at"))


@query(
    "f6_any_of_filters",
    f"""WITH {ORDER_JOBS_SQL} SELECT url, company_name FROM order_jobs WHERE (lower(company_name) LIKE '%mer 1%'
     OR lower(company_name) LIKE '%er _7%') AND workplace_type IN ('1-URGENT', '5-LOW')""",
)
def any_of_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Substring match ignoring ASCII case, exact match, an empty list that filters nothing."""
    jobs = order_jobs(spark, sf).withColumn("location", F.col("company_name"))
    wanted = {"location": ["MER 1", "er _7"], "workplace_type": ["1-URGENT", "5-LOW"], "experience_level": []}
    return lookup.filter_records(jobs, wanted).select("url", "company_name")


@query(
    "f7_stale_companies",
    f"""WITH {COMPANIES_SQL} SELECT id, company_page_url FROM companies WHERE is_active AND (last_scraped IS NULL
    OR last_scraped < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR)""",
)
def stale_companies(spark: SparkSession, sf: str) -> DataFrame:
    due = lookup.stale(companies(spark, sf), moment("2024-01-30 12:00:00"), 24)
    return due.select("id", "company_page_url")


@query(
    "l2_oldest_scrapes",
    f"""WITH {COMPANIES_SQL} SELECT id FROM companies WHERE is_active AND (last_scraped IS NULL
    OR last_scraped < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR)
    ORDER BY last_scraped ASC NULLS FIRST, company_page_url LIMIT 50""",
)
def oldest_scrapes(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.stale(companies(spark, sf), moment("2024-01-30 12:00:00"), 1).limit(50).select("id")


@query(
    "f8_companies_by_domain",
    f"WITH {COMPANIES_SQL} SELECT id, company_name FROM companies WHERE domain = 'building' AND is_active",
)
def by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.companies_by_domain(companies(spark, sf), "building").select("id", "company_name")


@query(
    "f9_company_by_url",
    f"""WITH {COMPANIES_SQL} SELECT id, company_name FROM companies
    WHERE company_page_url = 'https://machinery.example.com/1'""",
)
def company_by_url(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.by_url(companies(spark, sf), "https://machinery.example.com/1", "company_page_url")
    return found.select("id", "company_name")


@query(
    "f10_job_by_url",
    f"""WITH {ORDER_JOBS_SQL} SELECT url, company_name, workplace_type FROM order_jobs
    WHERE url = 'https://jobs.example.com/o/7'""",
)
def job_by_url(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.by_url(order_jobs(spark, sf), "https://jobs.example.com/o/7")
    return found.select("url", "company_name", "workplace_type")


@query(
    "f11_jobs_by_company",
    f"""WITH {ORDER_JOBS_SQL} SELECT url, {shown_sql('scraped_at')} FROM order_jobs WHERE company_name = 'Customer 7'
    ORDER BY order_jobs.scraped_at DESC, url LIMIT 10""",
)
def by_company(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.jobs_by_company(order_jobs(spark, sf), "Customer 7", 10).select("url", shown("scraped_at"))


@query(
    "f12_embedding_backlog",
    """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    AND lang <> 'es'""",
)
def backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents count as embedded, Spanish ones as undescribed."""
    vectors = load(spark, sf, "labels").select("doc_id", F.array(F.col("quality").cast("float")).alias("embedding"))
    jobs = load(spark, sf, "documents").join(vectors, "doc_id", "left").select(
        "doc_id", "embedding", F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("text")).alias("description"),
        F.col("doc_id").alias("scraped_at"), F.col("doc_id").alias("url"),
    )
    return lookup.embedding_backlog(jobs).select("doc_id")


@query("f13_processing_batches", "SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def processing(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", F.lit("processing")).otherwise(F.lit("completed"))
    ledger = load(spark, sf, "events").select("event_id", "user_id", status.alias("status"))
    return lookup.processing_batches(ledger).select("event_id", "user_id")


@query(
    "a1_count_companies",
    f"WITH {COMPANIES_SQL} SELECT count(*) AS companies FROM companies WHERE domain = 'furniture' AND is_active",
)
def count_companies(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.count_companies(companies(spark, sf), "furniture")


@query(
    "a2_count_jobs",
    f"""WITH {ORDER_JOBS_SQL} SELECT count(*) AS jobs FROM order_jobs WHERE workplace_type = '5-LOW'
    AND department_id = 3""",
)
def count_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.count_jobs(order_jobs(spark, sf), workplace_type="5-LOW", experience_level="", department_id=3)


@query("a4_unique_values", "SELECT DISTINCT lang FROM documents WHERE lang <> ''")
def unique_languages(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.unique_values(load(spark, sf, "documents"), "lang")


@query(
    "a15_distributions",
    f"""WITH {ORDER_JOBS_SQL} SELECT CASE WHEN grouping(workplace_type) = 0 THEN 'workplace_type'
     WHEN grouping(experience_level) = 0 THEN 'experience_level' ELSE 'employment_type' END AS "column",
    CASE WHEN grouping(workplace_type) = 0 THEN workplace_type WHEN grouping(experience_level) = 0
     THEN experience_level ELSE employment_type END AS value, count(*) AS rows FROM order_jobs
    GROUP BY GROUPING SETS ((workplace_type), (experience_level), (employment_type))""",
)
def distributions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distributions(order_jobs(spark, sf), ["workplace_type", "experience_level", "employment_type"])


@query(
    "a15_top_departments",
    f"""WITH {NORMALISED_SQL} SELECT canonical_name, count(*) AS rows FROM normalised JOIN departments d
    ON d.id = department_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def top_departments(spark: SparkSession, sf: str) -> DataFrame:
    dims = seed_dimensions(spark)
    jobs = dimensions.with_department_id(postings(spark, sf), dims["departments"], dims["department_synonyms"])
    named = dimensions.rolled_up(jobs, dims["departments"], "department_id", "canonical_name")
    return named.withColumnRenamed("jobs", "rows").orderBy(F.col("rows").desc(), "canonical_name").limit(3)


@query(
    "a15_top_locations",
    f"""WITH {NORMALISED_SQL} SELECT canonical_name, count(*) AS rows FROM normalised JOIN locations l
    ON l.id = location_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def top_locations(spark: SparkSession, sf: str) -> DataFrame:
    dims = seed_dimensions(spark)
    jobs = dimensions.with_location_id(postings(spark, sf), dims["locations"], dims["location_synonyms"])
    named = dimensions.rolled_up(jobs, dims["locations"], "location_id", "canonical_name")
    return named.withColumnRenamed("jobs", "rows").orderBy(F.col("rows").desc(), "canonical_name").limit(5)


@query(
    "a15_top_companies",
    f"""WITH {ORDER_JOBS_SQL} SELECT company_name, count(*) AS rows FROM order_jobs GROUP BY 1
    ORDER BY rows DESC, company_name LIMIT 4""",
)
def top_companies(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distribution(order_jobs(spark, sf), "company_name", 4)


@query("l3_alphabetical", "SELECT DISTINCT p_name FROM part")
def alphabetical(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.unique_values(load(spark, sf, "part"), "p_name")


@query("l5_first_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 80")
def first_documents(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_rows(load(spark, sf, "documents"), "doc_id", 80).select("doc_id", "source")


@query("l6_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def sampled(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.sample_rows(load(spark, sf, "documents"), "doc_id", 50, seed=7).select("doc_id")


@query(
    "l6_sample_newest",
    f"""WITH {ORDER_JOBS_SQL}, newest AS (SELECT url FROM order_jobs ORDER BY scraped_at DESC, url LIMIT 50)
    SELECT url FROM newest ORDER BY md5('7:' || url), url LIMIT 20""",
)
def sampled_newest(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.sample_newest(order_jobs(spark, sf), "scraped_at", "url", 50, 20, seed=7).select("url")


@query("j1_j2_normalise", f"WITH {NORMALISED_SQL} SELECT pos, department_id, location_id FROM normalised")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(spark, sf).select("pos", "department_id", "location_id")


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    dims = seed_dimensions(spark)
    jobs = dimensions.with_department_id(postings(spark, sf), dims["departments"], dims["department_synonyms"])
    return dimensions.with_location_id(jobs, dims["locations"], dims["location_synonyms"])


@query(
    "j7_unresolved",
    f"""WITH {NORMALISED_SQL} SELECT 'department' AS kind, trim(department) AS value, count(*) AS rows FROM normalised
    WHERE department_id IS NULL AND trim(department) <> '' GROUP BY 2
    UNION ALL SELECT 'location', trim(string_split(location, ',')[1]), count(*) FROM normalised
    WHERE location_id IS NULL AND trim(location) <> '' GROUP BY 2""",
)
def unresolved(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _normalised(spark, sf)
    departments = dimensions.unresolved(jobs, "department", "department_id")
    places = dimensions.unresolved(jobs, "location", "location_id", head=True)
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "value", "rows")
    return tagged(departments, "department").unionByName(tagged(places, "location"))


@query(
    "j3_new_jobs",
    """SELECT page_id, md5(url) AS url_hash FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s
    WHERE s.url LIKE 'https:%' AND md5(s.url) = md5(p.url))""",
)
def new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages already stored are those fetched over https."""
    pages = load(spark, sf, "pages").select("page_id", "url", url_hash(F.col("url")).alias("url_hash"))
    stored = pages.where(F.col("url").startswith("https:"))
    return drop_known(pages, stored, "url_hash").select("page_id", "url_hash")


def _part_dimension(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brand and type pairs as a dimension, their large sizes as synonyms; both as long as the vocabulary."""
    part = load(spark, sf, "part")
    name = F.concat_ws("/", "p_brand", "p_type")
    dimension = number_rows(part.select(name.alias("canonical_name")).distinct(), ["canonical_name"], "id")
    seed = part.where(F.col("p_size") > 40).select(
        F.concat_ws("/", "p_brand", "p_type", "p_size").alias("synonym"), name.alias("canonical_name")
    )
    numbered = number_rows(seed.distinct(), ["synonym"], "id")
    return dimension, resolve_synonyms(numbered, dimension, "pair_id")


PAIRS_SQL = """pairs AS (SELECT row_number() OVER (ORDER BY canonical_name) AS id, canonical_name FROM
 (SELECT DISTINCT p_brand || '/' || p_type AS canonical_name FROM part)),
pair_synonyms AS (SELECT synonym, id AS pair_id FROM (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_size AS synonym,
 p_brand || '/' || p_type AS canonical_name FROM part WHERE p_size > 40) JOIN pairs USING (canonical_name))"""


@query(
    "j4_synonym_lists",
    f"""WITH {PAIRS_SQL} SELECT id, canonical_name, string_agg(synonym, ', ' ORDER BY synonym) AS synonyms FROM pairs
    LEFT JOIN pair_synonyms ON pair_id = id GROUP BY 1, 2""",
)
def synonym_lists(spark: SparkSession, sf: str) -> DataFrame:
    return dimensions.with_synonyms(*_part_dimension(spark, sf), "pair_id")


@query(
    "j8_synonyms_of",
    f"""WITH {PAIRS_SQL} SELECT synonym, pair_id FROM pair_synonyms WHERE pair_id IN (SELECT id FROM pairs
    WHERE canonical_name LIKE '%/PROMO')""",
)
def synonyms_of(spark: SparkSession, sf: str) -> DataFrame:
    dimension, synonyms = _part_dimension(spark, sf)
    wanted = dimension.where(F.col("canonical_name").endswith("/PROMO")).select(F.col("id").alias("pair_id"))
    return dimensions.synonyms_of(synonyms, wanted, "pair_id").select("synonym", "pair_id")


@query("j9_synonym_ids", f"WITH {PAIRS_SQL} SELECT synonym, pair_id FROM pair_synonyms")
def synonym_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _part_dimension(spark, sf)[1].select("synonym", "pair_id")


@query(
    "a8_usage",
    f"""WITH {NORMALISED_SQL} SELECT d.id::BIGINT AS id, canonical_name, count(n.pos) AS jobs FROM departments d
    LEFT JOIN normalised n ON n.department_id = d.id GROUP BY 1, 2""",
)
def department_usage(spark: SparkSession, sf: str) -> DataFrame:
    rows = dimensions.usage(seed_dimensions(spark)["departments"], _normalised(spark, sf), "department_id")
    return rows.select("id", "canonical_name", "jobs")


@query(
    "d7_rollups",
    f"""WITH {NORMALISED_SQL} SELECT 'category' AS level, category AS value, count(*) AS jobs FROM normalised
    JOIN departments d ON d.id = department_id GROUP BY 2
    UNION ALL SELECT 'region', region, count(*) FROM normalised JOIN locations l ON l.id = location_id GROUP BY 2""",
)
def rollups(spark: SparkSession, sf: str) -> DataFrame:
    dims, jobs = seed_dimensions(spark), _normalised(spark, sf)
    categories = dimensions.rolled_up(jobs, dims["departments"], "department_id", "category")
    regions = dimensions.rolled_up(jobs, dims["locations"], "location_id", "region")
    tagged = lambda df, level: df.select(F.lit(level).alias("level"), F.col(level).alias("value"), "jobs")
    return tagged(categories, "category").unionByName(tagged(regions, "region"))


@query(
    "d7_region_filter",
    f"""WITH {NORMALISED_SQL} SELECT pos FROM normalised JOIN locations l ON l.id = location_id
    WHERE region IN ('North')""",
)
def in_region(spark: SparkSession, sf: str) -> DataFrame:
    places = seed_dimensions(spark)["locations"]
    return dimensions.in_rollup(_normalised(spark, sf), places, "location_id", "region", ["North"]).select("pos")


@query(
    "d6_auto_create",
    f"""WITH {NORMALISED_SQL}, unknown AS (SELECT DISTINCT trim(department) AS name FROM normalised
     WHERE department_id IS NULL AND trim(department) <> '') SELECT id::BIGINT AS id, canonical_name, category
    FROM departments UNION ALL SELECT 23 + row_number() OVER (ORDER BY name), name, NULL FROM unknown""",
)
def auto_created(spark: SparkSession, sf: str) -> DataFrame:
    unknown = dimensions.unresolved(_normalised(spark, sf), "department", "department_id")
    return dimensions.auto_create(seed_dimensions(spark)["departments"], unknown)


@query(
    "d6_auto_create_locations",
    f"""WITH {NORMALISED_SQL}, heads AS (SELECT trim(string_split(location, ',')[1]) AS name FROM normalised WHERE location_id IS NULL
     UNION ALL SELECT 'City of ' || n_name FROM nation), unknown AS (SELECT DISTINCT name FROM heads WHERE name <> ''
     AND name NOT IN (SELECT canonical_name FROM locations))
    SELECT id::BIGINT AS id, canonical_name, country, region FROM locations
    UNION ALL SELECT (SELECT max(id) FROM locations) + row_number() OVER (ORDER BY name), name, NULL, NULL FROM unknown""",
)
def auto_created_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Places that no reference row matches: those of the postings, and a city per nation."""
    places = seed_dimensions(spark)["locations"]
    unknown = dimensions.unresolved(_normalised(spark, sf), "location", "location_id", head=True)
    cities = load(spark, sf, "nation").select(
        F.concat(F.lit("City of "), F.col("n_name"), F.lit(", XX")).alias("location"), F.lit(None).cast("long").alias("location_id")
    )
    more = dimensions.unresolved(cities, "location", "location_id", head=True)
    return dimensions.auto_create(places, unknown.unionByName(more))


@query(
    "s14_seed_coverage",
    f"""WITH {NORMALISED_SQL}, named AS (SELECT coalesce(canonical_name, '-') AS name, pos FROM normalised
     LEFT JOIN departments d ON d.id = department_id) SELECT name, count(*) AS jobs FROM named GROUP BY 1""",
)
def seed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Postings per seeded department, after loading the seed twice."""
    from rolecall.reference_data import load_seed

    dims = seed_dimensions(spark)
    loaded = load_seed(dims["departments"], dims["departments"])
    jobs = dimensions.with_department_id(postings(spark, sf), loaded, dims["department_synonyms"])
    counts = jobs.groupBy(F.col("department_id").alias("id")).agg(F.count("*").alias("jobs"))
    named = counts.join(loaded.select("id", "canonical_name"), "id", "left")
    return named.select(F.coalesce("canonical_name", F.lit("-")).alias("name"), "jobs")


_SAMPLES = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name"], "customer": ["c_custkey", "c_name"],
    "supplier": ["s_suppkey", "s_name"], "part": ["p_partkey", "p_name"], "orders": ["o_orderkey", "o_orderstatus"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id", "event_type"], "documents": ["doc_id", "lang", "source"],
    "embeddings": ["vec_id", "label"], "pages": ["page_id", "url"], "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role"],
}


def _table_sql(name: str, columns: list[str]) -> str:
    shown = ", ".join(f"'{c}': {c}" for c in columns)
    return f"""SELECT '{name}' AS "table", true AS present, (SELECT count(*) FROM {name}) AS rows, CAST(NULL AS VARCHAR) AS error,
     (SELECT CAST(to_json({{{shown}}}) AS VARCHAR) FROM {name} ORDER BY {", ".join(columns)} LIMIT 1) AS sample"""


@query(
    "a7_verify_tables",
    " UNION ALL ".join(_table_sql(*item) for item in _SAMPLES.items())
    + " UNION ALL SELECT 'salaries', false, 0, 'table salaries is missing', NULL",
)
def verified(spark: SparkSession, sf: str) -> DataFrame:
    """All given tables and one that is not there."""
    tables: dict[str, DataFrame | None] = {name: load(spark, sf, name) for name in _SAMPLES}
    tables["salaries"] = None
    return reports.verify_tables(tables, {"pages": ["url", "html"]}, _SAMPLES)
