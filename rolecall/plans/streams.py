"""The streaming jobs, each fed with messages that Spark derives from whole tables.

Messages land as files below the shared folder and are drained with ``availableNow``. The SQL
twins are the batch equivalents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.operators import tables
from rolecall.operators.embeddings import write_back
from rolecall.plans.inputs import (
    COMPANIES_SQL,
    LATIN_LETTERS,
    NORMALISED_SQL,
    POSTINGS_SQL,
    companies,
    dimensions,
    load,
    moment,
    postings,
)
from rolecall.plans.pages import mixed_pages
from rolecall.plans.registry import query
from rolecall.schemas import COMPANY_MESSAGE
from rolecall.session import shared_path
from rolecall.sources.readers import read_json_array, stream_json
from rolecall.sources.writers import company_messages, job_batches, write_json_arrays
from rolecall.streaming.jobs import (
    BATCH_COUNTERS,
    JOB_DOCUMENT,
    QUEUED_JOB,
    RUN_COUNTERS,
    STORED_JOB,
    TOUCHED,
    HASHED_URL,
    IngestJob,
    PollJob,
    ScrapeJob,
    UniqueJob,
    company_stream,
    consume,
    current_vectors,
    document_stream,
    drain,
    ledger,
    publish_stale,
    poll_stream,
    rejected_lines,
    unpack_documents,
)
from rolecall.streaming.pages import PageStore
from rolecall.streaming.seen import SeenUrls
from rolecall.streaming.tables import read_committed, read_loads, write_load

NOW = "2024-02-01 08:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query(
    "t1_stale_feed",
    f"""WITH {COMPANIES_SQL} SELECT company_name, domain, company_page_url FROM companies WHERE is_active
    AND (last_scraped IS NULL OR last_scraped < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR)""",
)
def stale_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Stale companies go out as messages and come back through the company stream."""
    queue, sink, mark = (shared_path(spark, name) for name in ("companies", "consumed", "checkpoint"))
    publish_stale(companies(spark, sf), moment("2024-01-30 12:00:00"), 24, queue)
    drain(company_stream(spark, queue), lambda batch, load_id: write_load(batch, sink, load_id), mark)
    return read_loads(spark, sink, COMPANY_MESSAGE).drop("load_id")


def _queued_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting as a queue message row; its company is the source."""
    rows = postings(spark, sf).select(
        F.concat(F.lit("https://www.comeet.com/jobs/"), F.col("company_name")).alias("source_url"),
        F.col("pos").alias("job_pos"), "title", "company_name", "department", "location", "workplace_type",
        "experience_level", "url", "description_map", "description_text",
    )
    have = set(rows.columns)
    fields = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in QUEUED_JOB.fields
    ]
    return rows.select("source_url", *fields)


def _publish(spark: SparkSession, sf: str) -> str:
    queue = shared_path(spark, "jobs")
    job_batches(_queued_jobs(spark, sf), "source_url", 100).write.text(queue)
    return queue


@query(
    "t3_drain",
    f"""WITH {POSTINGS_SQL} SELECT 'https://www.comeet.com/jobs/' || company_name AS source_url, pos AS job_pos, url,
    md5(description_text) AS description FROM postings""",
)
def drained(spark: SparkSession, sf: str) -> DataFrame:
    """Batch documents are published, drained and unpacked; nothing is lost and nothing repeats."""
    queue, sink, mark = _publish(spark, sf), shared_path(spark, "drained"), shared_path(spark, "checkpoint")

    def handle(batch: DataFrame, load_id: int) -> None:
        rows = unpack_documents(batch)
        write_load(rows.select("source_url", "job_pos", "url", F.md5("description_text").alias("description")), sink, load_id)

    for _ in range(2):  # the second run finds an empty queue
        drain(document_stream(spark, queue), handle, mark)
    schema = T.StructType(
        [T.StructField("source_url", T.StringType()), T.StructField("job_pos", T.LongType()),
         T.StructField("url", T.StringType()), T.StructField("description", T.StringType())]
    )
    return read_loads(spark, sink, schema).drop("load_id")


@query(
    "s18_job_batches",
    f"""WITH {POSTINGS_SQL} SELECT 'https://www.comeet.com/jobs/' || company_name AS source_url, count(*) AS jobs
    FROM postings GROUP BY 1""",
)
def published(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs per source over the published documents, none of which holds a whole large source."""
    documents = spark.read.schema(JOB_DOCUMENT).json(_publish(spark, sf))
    return documents.groupBy("source_url").agg(F.sum(F.size("jobs")).alias("jobs"))


@query(
    "s17_company_messages",
    f"WITH {COMPANIES_SQL} SELECT company_name, domain, company_page_url FROM companies",
)
def company_queue(spark: SparkSession, sf: str) -> DataFrame:
    queue = shared_path(spark, "companies")
    company_messages(companies(spark, sf).select(*COMPANY_MESSAGE.names)).write.text(queue)
    return spark.read.schema(COMPANY_MESSAGE).json(queue)


def _scrape(spark: SparkSession, sf: str) -> tuple[str, str]:
    """One page per part is scraped, though an older one landed too; relative links fail validation,
    postings of supplier ids are on file."""
    queue, root, out, store, mark = (
        shared_path(spark, name) for name in ("companies", "scrape", "documents", "store", "checkpoint")
    )
    page = F.concat(F.lit("https://site.example.com/"), F.col("page_key"))
    latest = mixed_pages(spark, sf).select(page.alias("url"), "html", _now().alias("landed"))
    older = latest.select("url", F.lit("<p>old</p>").alias("html"), (_now() - F.expr("INTERVAL 1 DAY")).alias("landed"))
    pages = PageStore(shared_path(spark, "pages"), 16)
    pages.land(latest)
    pages.land(older)
    messages = latest.select(
        F.lit("x").alias("company_name"), F.lit("comeet.com").alias("domain"), F.col("url").alias("company_page_url")
    )
    company_messages(messages).write.text(queue)
    known = load(spark, sf, "supplier").select(
        F.md5(F.concat(F.lit("https://jobs.example.com/"), F.col("s_suppkey"))).alias("url_hash")
    )
    write_load(_as_stored(known), store, 0)
    ScrapeJob(pages, store, root, out, _now()).run(company_stream(spark, queue), mark)
    return root, out


def _as_stored(rows: DataFrame) -> DataFrame:
    """Stored postings of which only the given columns are known."""
    have = set(rows.columns)
    return rows.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED_JOB.fields]
    )


@query(
    "t2_scrape",
    """WITH jobs AS (SELECT p_partkey, 0 AS job_pos, p_name AS title, 'https://jobs.example.com/' || p_partkey AS url
     FROM part WHERE p_size <= 15)
    SELECT 'https://site.example.com/' || p_partkey AS source_url, job_pos::BIGINT AS job_pos, title, url FROM jobs
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)""",
)
def scraped(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.schema(JOB_DOCUMENT).json(_scrape(spark, sf)[1])
    return unpack_documents(documents).select("source_url", "job_pos", "title", "url")


@query(
    "t2_touched",
    """SELECT 'https://site.example.com/' || p_partkey AS company_page_url, true AS fresh FROM part""",
)
def touched(spark: SparkSession, sf: str) -> DataFrame:
    """Every scraped page gets its scrape time."""
    rows = read_loads(spark, f"{_scrape(spark, sf)[0]}/touched", TOUCHED)
    return rows.select("company_page_url", (F.col("last_scraped") == _now()).alias("fresh"))


@query(
    "t2_counters",
    "SELECT count(*) FILTER (p_size <= 48) AS processed, count(*) FILTER (p_size > 48) AS failed FROM part",
)
def scrape_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_loads(spark, f"{_scrape(spark, sf)[0]}/counters", RUN_COUNTERS)
    return rows.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))


_KEPT_SQL = f"""WITH {NORMALISED_SQL}, bodies AS (SELECT *, title || ' ' || description_text || coalesce(' ' || location, '')
 || ' ' || company_name AS body FROM normalised), kept AS (SELECT * FROM bodies WHERE contains(location, 'ISRAEL')
 AND coalesce(length(regexp_replace(body, '[^\\x{{00C0}}-\\x{{00FF}}]', '', 'g'))::DOUBLE
  / nullif(length(regexp_replace(body, '[^\\p{{L}}]', '', 'g')), 0) <= 0.1, true)
 AND coalesce(lower(trim(department)) <> 'general', true))"""


def _ingest(spark: SparkSession, sf: str, runs: int = 1, files: int = 10) -> str:
    """Drain the published postings into a fresh store, so many files a micro-batch."""
    root, mark, queue = shared_path(spark, "store"), shared_path(spark, "checkpoint"), _publish(spark, sf)
    job = IngestJob(dimensions(spark), root, "text-embedding-small", _now(), {"block": LATIN_LETTERS})
    for _ in range(runs):
        job.run(document_stream(spark, queue, files), mark)
    return root


@query(
    "t6_ingest",
    f"""{_KEPT_SQL} SELECT md5(url) AS url_hash, md5(description_text) AS description, department_id, location_id FROM kept
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY company_name, pos) = 1""",
)
def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """All stored postings, of copies that come in one micro-batch the first by source and place there."""
    stored = read_loads(spark, f"{_ingest(spark, sf, files=1_000_000)}/jobs", STORED_JOB)
    return stored.select("url_hash", F.md5("description").alias("description"), "department_id", "location_id")


@query(
    "t6_request_ledger",
    f"""{_KEPT_SQL} SELECT count(DISTINCT url) AS requests, count(DISTINCT url) AS ids, true AS dense FROM kept""",
)
def requested(spark: SparkSession, sf: str) -> DataFrame:
    """After two runs: one request per stored posting, and gapless ids."""
    root = _ingest(spark, sf, runs=2)
    lines = spark.read.schema("custom_id STRING").json(f"{root}/requests").agg(F.count("custom_id").alias("requests"))
    ids = read_loads(spark, f"{root}/jobs", STORED_JOB).agg(
        F.countDistinct("id").alias("ids"), (F.max("id") == F.count("id")).alias("dense")
    )
    return ids.select(lines.scalar().alias("requests"), "ids", "dense")


@query(
    "t7_stream_dedupe",
    f"WITH {POSTINGS_SQL} SELECT DISTINCT md5(url) AS url_hash FROM postings",
)
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """All URLs are queued twice, in two folders drained one after the other into one table."""
    queue, store, mark = (shared_path(spark, name) for name in ("urls", "unique", "checkpoint"))
    schema = T.StructType([T.StructField("url", T.StringType())])
    for _ in range(2):
        postings(spark, sf).select("url").write.mode("append").json(queue)
        UniqueJob(SeenUrls(store)).run(stream_json(spark, queue, schema), mark)
    return read_loads(spark, store, HASHED_URL).select("url_hash")


@query(
    "t4_t5_consume",
    "SELECT role, count(*) AS turns FROM conversations GROUP BY 1",
)
def consumed(spark: SparkSession, sf: str) -> DataFrame:
    """A handler per batch; a batch handled twice still counts once."""
    queue, sink, mark = (shared_path(spark, name) for name in ("turns", "handled", "checkpoint"))
    schema = load(spark, sf, "conversations").schema
    load(spark, sf, "conversations").write.json(queue)

    def handle(batch: DataFrame, load_id: int) -> None:
        for _ in range(2):
            write_load(batch, sink, load_id)

    stream = stream_json(spark, queue, schema)
    consume(stream, handle, mark, available_now=True).awaitTermination()
    return read_loads(spark, sink, schema).groupBy("role").agg(F.count("*").alias("turns"))


#: States of the batches, by label, in two polls. Batch 7 completes but nothing landed of it; what is final stays so.
POLLS = (
    {0: "completed", 1: "completed", 2: "completed", 3: "completed", 4: "in_progress", 5: "failed", 6: "expired", 7: "completed", 8: "validating", 9: "finalizing"},
    {0: "failed", 4: "completed", 5: "completed", 8: "failed", 9: "completed"},
)
_INGESTED = "label IN (0, 1, 2, 3, 4, 9)"


def _landed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Six lines per vector: the vector, a blank, the vector halved, a cut-off line, an error, and an answer without a vector."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    half = F.transform("embedding", lambda x: x.cast("double") / 2)
    key = F.col("vec_id").cast("string")

    def result(*vectors):
        data = F.array(*[F.struct(v.alias("embedding")) for v in vectors])
        return F.to_json(F.struct(key.alias("custom_id"), F.struct(F.struct(data.alias("data")).alias("body")).alias("response")))

    opening = F.concat(F.lit('{"custom_id":"'), key)
    lines = F.array(
        result(double), F.lit("  "), result(half), F.concat(opening, F.lit('","response":{"body":')),
        F.concat(opening, F.lit('","error":{"message":"rate limit"}}')), F.concat(opening, F.lit('","response":{"body":{"data":[]}}}')),
    )
    rows = load(spark, sf, "embeddings")
    batch = F.concat(F.lit("batch-"), F.col("label")).alias("batch_id")
    return rows.where("label <> 7").select(batch, "vec_id", F.posexplode(lines).alias("n", "value"))


def _polled(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Registered batches, one per label, polled twice; the results of a batch are on file before it completes."""
    results, registry, polls, store, root, mark = (
        shared_path(spark, name) for name in ("results", "registry", "polls", "store", "polled", "checkpoint")
    )
    landed = _landed_results(spark, sf).repartition("batch_id").sortWithinPartitions("batch_id", "vec_id", "n")
    landed.select("value", "batch_id").write.partitionBy("batch_id").text(results)
    batches = load(spark, sf, "embeddings").select("label", F.concat(F.lit("batch-"), F.col("label")).alias("batch_id")).distinct()
    entries = batches.select("batch_id", F.lit("processing").alias("status"), _now().alias("created_at"))
    write_load(entries, f"{registry}/ledger", 0)
    keys = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url_hash"))
    write_load(_as_stored(keys), store, 0)
    job = PollJob(registry, results, store, root)
    for states in POLLS:
        state = F.try_element_at(F.create_map(*[F.lit(x) for pair in states.items() for x in pair]), F.col("label").cast("int"))
        asked = batches.select("batch_id", state.alias("status"))
        asked.where("status IS NOT NULL").write.mode("append").json(polls)
        job.run(poll_stream(spark, polls), mark)
    return registry, root


@query(
    "t8_write_back",
    f"""SELECT d.doc_id, round(e.embedding[1]::DOUBLE / 2, 5) AS first FROM documents d
    LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND {_INGESTED}""",
)
def written_back(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of completed batches become the vectors of the postings; of equal keys the last line stays."""
    jobs = load(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("url_hash"), F.lit(None).cast("array<float>").alias("embedding")
    )
    updated = write_back(jobs, current_vectors(spark, _polled(spark, sf)[1]))
    return updated.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query(
    "t8_counters",
    f"""SELECT 'batch-' || label AS batch_id, 6 * count(*) AS lines, count(*) AS blank, count(*) AS malformed, count(*) AS error,
    count(*) AS no_vector, count(*) AS superseded, count(d.doc_id) AS updated, count(*) - count(d.doc_id) AS failed
    FROM embeddings LEFT JOIN documents d ON doc_id = vec_id WHERE {_INGESTED} GROUP BY 1""",
)
def written_back_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each line of the ingested batches."""
    return read_committed(spark, _polled(spark, sf)[1], "counters", BATCH_COUNTERS).drop("load_id")


@query(
    "t8_ledger",
    f"""SELECT DISTINCT 'batch-' || label AS batch_id, CASE WHEN {_INGESTED} THEN 'completed' WHEN label IN (5, 8) THEN 'failed'
    ELSE 'processing' END AS status FROM embeddings""",
)
def polled_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """States after two polls: final ones stay, a completed batch without output is still open."""
    return ledger(spark, *_polled(spark, sf)).select("batch_id", "status")


@query(
    "t8_rejects",
    f"""WITH ingested AS (SELECT 'batch-' || label AS batch_id, '{{"custom_id":"' || vec_id AS opening FROM embeddings WHERE {_INGESTED})
    SELECT batch_id, 'malformed' AS reason, opening || '","response":{{"body":' AS line FROM ingested
    UNION ALL SELECT batch_id, 'error', opening || '","error":{{"message":"rate limit"}}}}' FROM ingested
    UNION ALL SELECT batch_id, 'no vector', opening || '","response":{{"body":{{"data":[]}}}}}}' FROM ingested""",
)
def polled_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Each cut-off, erroneous or empty line of the ingested batches, as it came."""
    return rejected_lines(spark, _polled(spark, sf)[1]).drop("load_id")


@query(
    "d9_migration",
    f"""WITH {POSTINGS_SQL}, firsts AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)
    SELECT row_number() OVER (ORDER BY pos) AS id, md5(url) AS url_hash FROM firsts""",
)
def migrated(spark: SparkSession, sf: str) -> DataFrame:
    """Records of JSON array files become stored postings with ids in record order."""
    path = shared_path(spark, "jobs-json")
    write_json_arrays(_queued_jobs(spark, sf), path)
    landed = read_json_array(spark, path, QUEUED_JOB, missing_ok=False)
    empty = spark.createDataFrame([], "id BIGINT, url_hash STRING")
    delta = tables.insert_jobs(empty, landed, "job_pos", as_of=_now(), **dimensions(spark))
    return delta.select("id", "url_hash")
