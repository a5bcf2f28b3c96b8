"""The four recurring jobs as micro-batch queries: feed, scrape, ingest, write-back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolecall.functions.urls import url_hash
from rolecall.operators.dedupe import first_by_key
from rolecall.operators.embeddings import REJECTS, VECTOR_LINE, batch_counters, request_lines, sort_result_lines
from rolecall.operators.extract import extract_jobs
from rolecall.operators.joins import drop_known, is_small
from rolecall.operators.lookup import stale
from rolecall.operators.screening import kept_jobs, reject_counts, screen
from rolecall.operators.tables import persist_jobs, route_batches
from rolecall.operators.validate import check_jobs, valid_jobs
from rolecall.schemas import BATCH_LEDGER, COMPANY_MESSAGE, JOB, RAW_JOB, REMOTE_BATCH, VECTOR
from rolecall.sources.readers import read_batch_lines, stream_json, with_line_order
from rolecall.sources.writers import company_messages, job_batches
from rolecall.streaming.pages import LATEST, PageStore
from rolecall.streaming.runs import Runs
from rolecall.streaming.seen import SeenUrls
from rolecall.streaming.tables import commit, last_commit, last_mark, read_committed, read_load, read_loads, write_load

STAGED_JOB = T.StructType(
    [T.StructField("source_url", T.StringType()), T.StructField("job_pos", T.LongType())]
    + [f for f in RAW_JOB.fields if f.name != "type_errors"]
)
HASHED_JOB = T.StructType([*STAGED_JOB.fields, T.StructField("url_hash", T.StringType())])
SCREENED_JOB = T.StructType([*STAGED_JOB.fields, T.StructField("reject_reason", T.StringType())])
TOUCHED = T.StructType(
    [T.StructField("company_page_url", T.StringType()), T.StructField("last_scraped", T.TimestampType())]
)
RUN_COUNTERS = T.StructType([T.StructField("processed", T.LongType()), T.StructField("failed", T.LongType())])
HASHED_URL = T.StructType([T.StructField("url", T.StringType()), T.StructField("url_hash", T.StringType())])
QUEUED_JOB = T.StructType([f for f in STAGED_JOB.fields if f.name != "source_url"])
JOB_DOCUMENT = T.StructType(
    [T.StructField("jobs", T.ArrayType(QUEUED_JOB)), T.StructField("source_url", T.StringType())]
)
STORED_JOB = T.StructType([*JOB.fields, T.StructField("embed_text", T.StringType())])
ROUTE = T.StructType(
    [*BATCH_LEDGER.fields]
    + [T.StructField(name, T.StringType()) for name in ("remote_status", "action", "next_status")]
)
RESULT_PLACE = T.StructType(
    [
        T.StructField("load", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_block_start", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)
RESULT_LINE = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("at", RESULT_PLACE),
        T.StructField("url_hash", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("line", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)
BATCH_COUNTERS = T.StructType(
    [T.StructField("batch_id", T.StringType())]
    + [
        T.StructField(name, T.LongType())
        for name in ("lines", "blank", "malformed", "error", "no_vector", "superseded", "updated", "failed")
    ]
)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handle everything queued so far, batch by batch, then stop. A failing handler fails the query."""
    consume(stream, handle, checkpoint, available_now=True).awaitTermination()


def consume(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Handle batches as they arrive; a batch counts as done only after its handler returns."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def publish_stale(companies: DataFrame, as_of: Column, max_age_hours: int, queue: str) -> None:
    """Queue every stale company as one message."""
    due = stale(companies, as_of, max_age_hours).select(*COMPANY_MESSAGE.names)
    company_messages(due).write.mode("append").text(queue)


@dataclass(frozen=True)
class ScrapeJob:
    """Company messages to batch documents of new, valid postings.

    Beside the ``queue`` of documents, ``root`` receives the scraped page URLs with their time and
    one row of counters per micro-batch, which count page URLs. Of several pages of a URL the one that
    landed last is scraped. URLs whose page did not land, or landed empty, count as failed.
    """

    pages: PageStore
    store: str
    root: str
    queue: str
    as_of: Column

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        drain(stream, self.handle, checkpoint)

    def handle(self, batch: DataFrame, load_id: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("company_page_url").distinct()
        write_load(touched.withColumn("last_scraped", self.as_of.cast("timestamp")), f"{self.root}/touched", load_id)
        wanted = read_load(spark, f"{self.root}/touched", load_id, TOUCHED).select(F.col("company_page_url").alias("url"))

        # the pages are counted in the pass that parses them
        seen = Observation()
        filled = F.coalesce(F.length("html") > 0, F.lit(False))
        write_load(self.pages.latest(wanted), f"{self.root}/found", load_id)
        found = self.pages.fetch(read_load(spark, f"{self.root}/found", load_id, LATEST))
        pages = found.select(F.col("url").alias("source_url"), "html")
        jobs = extract_jobs(pages.observe(seen, F.count_if(filled).alias("processed")))
        checked = valid_jobs(check_jobs(jobs)).withColumn("url_hash", url_hash(F.col("url")))
        fields = [F.col(f.name).cast(f.dataType) for f in STAGED_JOB.fields]
        write_load(checked.select(*fields, "url_hash"), f"{self.root}/valid", load_id)
        processed = F.lit(seen.get["processed"]).cast("long")
        counters = wanted.agg(processed.alias("processed"), (F.count("*") - processed).alias("failed"))
        write_load(counters, f"{self.root}/counters", load_id)

        valid = read_load(spark, f"{self.root}/valid", load_id, HASHED_JOB)
        fresh = drop_known(valid, read_loads(spark, self.store, STORED_JOB), "url_hash", is_small(valid))
        write_load(fresh.select(*STAGED_JOB.names), f"{self.root}/fresh", load_id)
        staged = read_load(spark, f"{self.root}/fresh", load_id, STAGED_JOB)
        write_load(job_batches(staged, "source_url"), self.queue, load_id, "text")


@dataclass(frozen=True)
class IngestJob:
    """Batch documents to stored postings, embedding requests and a ledger entry.

    Each load leaves its highest id in ``marks``, so that the next one need not look at stored ids.
    """

    dimensions: dict[str, DataFrame]
    root: str
    model: str
    as_of: Column
    options: dict

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        drain(stream, self.handle, checkpoint)

    @property
    def store(self) -> str:
        return f"{self.root}/jobs"

    def handle(self, batch: DataFrame, load_id: int) -> None:
        spark = batch.sparkSession
        write_load(screen(unpack_documents(batch), **self.options), f"{self.root}/screened", load_id)
        screened = read_load(spark, f"{self.root}/screened", load_id, SCREENED_JOB)
        write_load(reject_counts(screened), f"{self.root}/rejects", load_id)
        kept = kept_jobs(screened).withColumn("_order", F.struct("source_url", "job_pos", "url"))
        earlier = read_loads(spark, self.store, STORED_JOB, before=load_id)
        delta = persist_jobs(
            earlier, kept, "_order", as_of=self.as_of, new_is_small=is_small(kept),
            first_id=last_mark(spark, f"{self.root}/marks", before=load_id) + 1, **self.dimensions,
        )
        write_load(delta, self.store, load_id, lookup=("url", "url_hash"))
        stored = read_load(spark, self.store, load_id, STORED_JOB)
        write_load(stored.agg(F.max("id").alias("mark")), f"{self.root}/marks", load_id)
        write_load(request_lines(stored, self.model), f"{self.root}/requests", load_id, "text")
        entry = stored.limit(1).select(
            F.lit(f"batch-{load_id}").alias("batch_id"), F.lit("processing").alias("status"),
            self.as_of.cast("timestamp").alias("created_at"),
        )
        write_load(entry, f"{self.root}/ledger", load_id)


def unpack_documents(documents: DataFrame) -> DataFrame:
    """One row per posting of the batch documents."""
    return documents.select("source_url", F.explode("jobs").alias("_job")).select("source_url", "_job.*")


@dataclass(frozen=True)
class UniqueJob:
    """Postings to the URL hashes not seen before. The table, not stream state, remembers the old ones."""

    store: SeenUrls

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        drain(stream, self.handle, checkpoint)

    def handle(self, batch: DataFrame, load_id: int) -> None:
        hashed = batch.select("url", url_hash(F.col("url")).alias("url_hash"))
        unique = first_by_key(hashed, ["url_hash"], "url")
        self.store.remember(self.store.unseen(unique, load_id), load_id)


@dataclass(frozen=True)
class PollJob:
    """Landed states of remote batches to stored vectors, rejected lines, counters and the next ledger state.

    A batch is ``processing`` from its entry in the ledger of ``registry`` until a poll finds it completed with
    landed results, or failed; both states are final. ``results`` holds the lines of each batch below
    ``batch_id=<id>``; only folders of batches that complete now are read. A completed batch without a landed line
    stays open. Of several states of a batch in one micro-batch the furthest counts.

    A micro-batch writes ``routes`` (batch, action, next status), ``results`` (every line by its outcome) and
    ``counters`` (per batch), then commits the three together. What was committed is not done again, what was
    not is invisible. Vectors of several polls are merged to runs, ``fan`` at a time.
    """

    registry: str
    results: str
    store: str
    root: str
    fan: int = 8

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        drain(stream, self.handle, checkpoint)

    def handle(self, batch: DataFrame, load_id: int) -> None:
        spark = batch.sparkSession
        if last_commit(spark, self.root) >= load_id:
            return
        routed = route_batches(ledger(spark, self.registry, self.root, before=load_id), furthest_state(batch))
        # what was not polled has nothing to route
        polled = routed.where(F.col("remote_status").isNotNull()).select(*ROUTE.names)
        write_load(polled, f"{self.root}/asked", load_id)
        asked = read_load(spark, f"{self.root}/asked", load_id, ROUTE)

        done = asked.where(F.col("action") == "ingest").select("batch_id", "created_at")
        lines = lines_of(read_batch_lines(spark, self.results), done)
        kept = sort_result_lines(lines).withColumn("line", F.when(F.col("outcome").isin(*REJECTS), F.col("value")))
        place = F.struct(F.lit(load_id).alias("load"), "created_at", "batch_id", "pos.*")
        kept = kept.withColumn("at", place)
        write_load(kept.select(*[F.col(f.name).cast(f.dataType) for f in RESULT_LINE.fields]), f"{self.root}/results", load_id, parts=("outcome",))

        vector_runs(self.root, self.fan).merge(spark, load_id)
        read = read_load(spark, f"{self.root}/results", load_id, RESULT_LINE).select("batch_id", "url_hash", "outcome")
        counted = batch_counters(read, read_loads(spark, self.store, STORED_JOB))
        write_load(counted.select(*BATCH_COUNTERS.names), f"{self.root}/counters", load_id)

        counters = read_load(spark, f"{self.root}/counters", load_id, BATCH_COUNTERS).select("batch_id", F.lit(True).alias("_landed"))
        landed = asked.join(counters, "batch_id", "left")
        waits = (F.col("action") == "ingest") & F.col("_landed").isNull()
        routes = landed.withColumn("next_status", F.when(waits, F.col("status")).otherwise(F.col("next_status")))
        routes = routes.withColumn("action", F.when(waits, F.lit("wait")).otherwise(F.col("action")))
        write_load(routes.select(*ROUTE.names), f"{self.root}/routes", load_id)
        commit(spark, self.root, load_id, ["results", "counters", "routes"])


def lines_of(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """Lines of the given batches with their place. Few batches, counted in a written table, prune the folders read."""
    if is_small(batches):
        return with_line_order(lines.join(F.broadcast(batches), "batch_id"))
    return with_line_order(lines).join(batches, "batch_id")  # a shuffle would mix the order


def furthest_state(remote: DataFrame) -> DataFrame:
    """One state per batch: failed or completed before any other, else the last in the order of names."""
    final = F.col("status").isin("completed", "failed")
    last = F.max_by("status", F.struct(final.alias("final"), F.col("status")))
    return remote.where(F.col("batch_id").isNotNull() & F.col("status").isNotNull()).groupBy("batch_id").agg(last.alias("status"))


def vector_runs(root: str, fan: int) -> Runs:
    return Runs(f"{root}/results", f"{root}/vectors", RESULT_LINE, "url_hash", "at", f"outcome = '{VECTOR_LINE}'", fan)


def current_vectors(spark: SparkSession, root: str, fan: int = 8) -> DataFrame:
    """Latest vector per posting over all committed polls: later polls first, then later batches, then later lines.

    ``fan`` must be that of the job. Lines that gave no vector are not read.
    """
    return vector_runs(root, fan).current(spark, last_commit(spark, root)).select("url_hash", "embedding")


def rejected_lines(spark: SparkSession, root: str) -> DataFrame:
    """The dead letters of all committed polls: batch, reason and the line as it came."""
    results = read_committed(spark, root, "results", RESULT_LINE).where(F.col("outcome").isin(*REJECTS))
    return results.select("batch_id", F.col("outcome").alias("reason"), "line", "load_id")


def ledger(spark: SparkSession, registry: str, polls: str | None = None, before: int | None = None) -> DataFrame:
    """Every registered batch with its state: processing, or what a committed poll made of it."""
    entries = read_loads(spark, f"{registry}/ledger", BATCH_LEDGER).drop("load_id")
    if polls is None:
        return entries
    final = read_committed(spark, polls, "routes", ROUTE, before).where(F.col("next_status") != F.col("status"))
    final = final.select("batch_id", F.col("next_status").alias("_final"))
    state = F.coalesce("_final", "status").alias("status")
    return entries.join(final, "batch_id", "left").select("batch_id", state, "created_at")


def company_stream(spark: SparkSession, queue: str) -> DataFrame:
    return stream_json(spark, queue, COMPANY_MESSAGE)


def document_stream(spark: SparkSession, queue: str, files_per_trigger: int = 10) -> DataFrame:
    return stream_json(spark, queue, JOB_DOCUMENT, files_per_trigger)


def poll_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Landed states of remote batches."""
    return stream_json(spark, path, REMOTE_BATCH, files_per_trigger)
