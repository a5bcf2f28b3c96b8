"""Streaming jobs: replays and repeated input must not change the tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import reference_data
from rolecall.session import shared_path
from rolecall.streaming.jobs import (
    BATCH_COUNTERS,
    STORED_JOB,
    IngestJob,
    PollJob,
    consume,
    current_vectors,
    document_stream,
    ledger,
    rejected_lines,
    unpack_documents,
)
from rolecall.streaming.pages import LATEST, PageStore
from rolecall.streaming.runs import Runs, spans
from rolecall.streaming.seen import SeenUrls
from rolecall.streaming.tables import read_committed, read_load, read_loads, write_load


def ingest_job(spark, root):
    dims = {
        "departments": reference_data.departments(spark),
        "department_synonyms": reference_data.department_synonyms(spark),
        "locations": reference_data.locations(spark),
        "location_synonyms": reference_data.location_synonyms(spark),
    }
    return IngestJob(dims, root, "model", F.lit("2024-02-01 08:00:00").cast("timestamp"), {})


def publish(queue, name, *jobs):
    document = {"jobs": [dict(job, job_pos=i) for i, job in enumerate(jobs)], "source_url": f"https://c/{name}"}
    with open(f"{queue}/{name}.json", "w", encoding="utf-8") as handle:
        handle.write(json.dumps(document) + "\n")


def job(n, **more):
    return {"title": f"Dev {n}", "url": f"https://a.com/{n}", "location": "TLV, ISRAEL", "department": "R&D",
            "description_map": {"description": "Build"}, **more}


def test_ingest_is_idempotent(spark, tmp_path):
    queue, root, mark = tmp_path / "queue", shared_path(spark, "store"), shared_path(spark, "mark")
    queue.mkdir()
    publish(queue, "one", job(1), job(2, department="General"), job(3, location=None), job(1))
    work = ingest_job(spark, root)
    work.run(document_stream(spark, str(queue)), mark)
    publish(queue, "two", job(1), job(4))
    work.run(document_stream(spark, str(queue)), mark)
    work.run(document_stream(spark, str(queue)), mark)
    stored = {r.url: r for r in read_loads(spark, work.store, STORED_JOB).collect()}
    assert sorted((r.id, r.url) for r in stored.values()) == [(1, "https://a.com/1"), (2, "https://a.com/4")]
    assert stored["https://a.com/1"].department_id == 3 and stored["https://a.com/1"].location_id == 1
    assert [r.batch_id for r in ledger(spark, root).orderBy("batch_id").collect()] == ["batch-0", "batch-1"]
    requests = spark.read.text(f"{root}/requests").collect()
    assert {json.loads(r.value)["body"]["input"] for r in requests} == {
        "Dev 1\n\ndescription: Build", "Dev 4\n\ndescription: Build",
    }
    # a replayed batch finds its own rows again and writes the same ones
    replay = spark.read.schema(document_stream(spark, str(queue)).schema).json(f"{queue}/two.json")
    work.handle(replay, 1)
    assert {r.url: r.id for r in read_loads(spark, work.store, STORED_JOB).collect()} == {
        "https://a.com/1": 1, "https://a.com/4": 2,
    }


def test_failing_handler_keeps_the_batch(spark, tmp_path):
    queue, mark = tmp_path / "queue", shared_path(spark, "mark")
    queue.mkdir()
    publish(queue, "one", job(1))

    def fail(_batch, _load):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        consume(document_stream(spark, str(queue)), fail, mark, available_now=True).awaitTermination()
    seen = []
    query = consume(
        document_stream(spark, str(queue)), lambda batch, _: seen.append(unpack_documents(batch).count()), mark,
        available_now=True,
    )
    query.awaitTermination()
    assert seen == [1]


def landed(folder, batch, *lines):
    (folder / f"batch_id={batch}").mkdir(parents=True)
    (folder / f"batch_id={batch}" / "out.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")


def answer(key, *vector):
    return json.dumps({"custom_id": key, "response": {"body": {"data": [{"embedding": list(vector)}]}}})


@pytest.fixture
def polls(spark, tmp_path):
    """Three registered batches; ``a`` and ``b`` landed, ``c`` did not."""
    root, now = shared_path(spark, "polls"), F.lit("2024-02-01 08:00:00").cast("timestamp")
    results = tmp_path / "results"
    landed(results, "a", answer("k1", 1.0), "", answer("k1", 2.0), answer("gone", 3.0), '{"custom_id":"k1","respo', '{"custom_id":7}')
    landed(results, "b", answer("k2", 4.0), '{"custom_id":"k2","error":{"message":"late"}}', answer("k2"), '[1]')
    entries = spark.createDataFrame([("a",), ("b",), ("c",)], "batch_id string")
    write_load(entries.select("batch_id", F.lit("processing").alias("status"), now.alias("created_at")), f"{root}/registry/ledger", 0)
    stored = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "url_hash string")
    fields = [(F.col(f.name) if f.name == "url_hash" else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED_JOB.fields]
    write_load(stored.select(*fields), f"{root}/jobs", 0)
    return PollJob(f"{root}/registry", str(results), f"{root}/jobs", f"{root}/polled", 2)


def states(spark, **status):
    return spark.createDataFrame(list(status.items()), "batch_id string, status string")


def tables_of(spark, job):
    vectors = {r.url_hash: r.embedding for r in current_vectors(spark, job.root, job.fan).collect()}
    rejects = sorted((r.batch_id, r.reason) for r in rejected_lines(spark, job.root).collect())
    counters = {r[0]: tuple(r)[1:-1] for r in read_committed(spark, job.root, "counters", BATCH_COUNTERS).collect()}
    return vectors, rejects, counters, {r.batch_id: r.status for r in ledger(spark, job.registry, job.root).collect()}


def test_polls(spark, polls):
    polls.handle(states(spark, a="completed", b="in_progress", c="completed", stray="completed"), 0)
    first = tables_of(spark, polls)
    assert first == (
        {"k1": [2.0], "gone": [3.0]},
        [("a", "malformed"), ("a", "no vector")],
        {"a": (6, 1, 1, 0, 1, 1, 1, 1)},
        {"a": "completed", "b": "processing", "c": "processing"},
    )
    polls.handle(states(spark, a="failed", b="completed", c="failed"), 1)
    after = tables_of(spark, polls)
    assert after == (
        {"k1": [2.0], "gone": [3.0], "k2": [4.0]},
        sorted([*first[1], ("b", "malformed"), ("b", "error"), ("b", "no vector")]),
        first[2] | {"b": (4, 0, 1, 1, 1, 0, 1, 0)},
        {"a": "completed", "b": "completed", "c": "failed"},
    )
    # every line is in one counter
    assert all(row[0] == sum(row[1:]) for row in after[2].values())
    assert spark.read.parquet(f"{polls.root}/vectors").count() == 3  # both polls in one run
    polls.handle(states(spark, b="failed"), 1)  # committed already
    assert tables_of(spark, polls) == after


def test_uncommitted_polls_are_invisible(spark, polls, monkeypatch):
    done = states(spark, a="completed", b="completed")
    before = tables_of(spark, polls)

    def lost(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as patch:
        patch.setattr("rolecall.streaming.jobs.commit", lost)
        with pytest.raises(OSError, match="lost"):
            polls.handle(done, 0)
    assert tables_of(spark, polls) == before == ({}, [], {}, {"a": "processing", "b": "processing", "c": "processing"})
    polls.handle(done, 0)
    once = tables_of(spark, polls)
    assert once[3] == {"a": "completed", "b": "completed", "c": "processing"} and len(once[1]) == 5
    polls.handle(states(spark, c="validating"), 1)
    assert tables_of(spark, polls) == once


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_seen_urls_stay_where_they_are(spark):
    store = SeenUrls(shared_path(spark, "seen"), 4)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("url"), F.md5(F.col("id").cast("string")).alias("url_hash"))
    store.remember(store.unseen(rows(0, 10), 0), 0)
    for _ in range(2):  # a replay finds the same
        fresh = store.unseen(rows(5, 20), 1)
        assert sorted(int(r.url) for r in fresh.collect()) == list(range(10, 20))
        store.remember(fresh, 1)
    assert spark.read.parquet(store.path).count() == 20
    assert store.unseen(rows(0, 20), 2).isEmpty()
    lines = plan_of(store.unseen(rows(0, 20), 2)).split("\n")
    scan = next(n for n, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    above = lines[:scan]
    join = max(n for n, line in enumerate(above) if "ShuffledHashJoin" in line and "LeftSemi" in line)
    assert not any("Exchange" in line or "Sort" in line for line in above[join:])


def test_pages_are_read_by_bucket_and_day(spark):
    store = PageStore(shared_path(spark, "pages"), 8)
    assert store.latest(spark.createDataFrame([("u1",)], "url string")).collect() == []
    at = lambda text: F.lit(text).cast("timestamp")
    rows = lambda html, day: spark.createDataFrame([(f"u{n}", f"{html}{n}") for n in range(20)], "url string, html string").withColumn("landed", at(day))
    store.land(rows("new", "2024-01-03 10:00:00"))
    store.land(rows("old", "2024-01-02 10:00:00"))
    store.land(spark.createDataFrame([("u3", "odd", None), (None, "none", None)], "url string, html string, landed timestamp"))
    wanted = spark.createDataFrame([("u3",), ("u5",), ("absent",)], "url string")
    found = store.latest(wanted)
    assert "html" not in plan_of(found).split("FileScan", 1)[1]
    write_load(found, store.path + "-found", 0)
    latest = read_load(spark, store.path + "-found", 0, LATEST)
    pages = store.fetch(latest)
    assert sorted(map(tuple, pages.collect())) == [("u3", "new3"), ("u5", "new5")]
    plan = plan_of(pages)
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "day" in filters and "bucket" in filters
    assert store.fetch(latest.where("false")).collect() == []


def test_spans():
    assert [b - a for a, b in spans(27, 4)] == [16, 4, 4, 1, 1, 1]
    assert spans(0, 2) == [] and spans(8, 2) == [(0, 8)]
    for loads in range(1, 200):
        runs = spans(loads, 3)
        assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])] and runs[-1][1] == loads
        assert len(runs) <= 2 * len(str(loads)) * 3


def test_runs_keep_the_last_rows(spark):
    root = shared_path(spark, "runs")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("kind", T.StringType())])
    runs = Runs(f"{root}/loads", f"{root}/merged", schema, "key", "at", "kind = 'good'", 2)
    assert runs.current(spark, -1).collect() == []
    want = {}
    for load in range(6):
        rows = [(f"k{n}", 100 * load + n, "good" if (n + load) % 5 else "bad") for n in range(load % 3, 8, 1 + load % 2)]
        want.update({key: at for key, at, kind in rows if kind == "good"})
        write_load(spark.createDataFrame(rows, schema), runs.loads, load)
        for _ in range(2):  # a replay merges the same again
            runs.merge(spark, load)
        assert {r.key: r["at"] for r in runs.current(spark, load).collect()} == want
    folders = {line.split("run=")[1][:3] for line in runs.current(spark, 5).inputFiles() if "run=" in line}
    assert folders == {"0-4", "4-6"} and len(runs.current(spark, 5).inputFiles()) <= 2 * 8
