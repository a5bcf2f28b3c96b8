"""Operators on small tables, with the invariants they must keep."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolecall import reference_data
from rolecall.functions.urls import url_hash
from rolecall.operators import (
    dedupe,
    dimensions,
    discovery,
    embeddings,
    joins,
    lookup,
    matching,
    numbering,
    reports,
    screening,
    tables,
    validate,
)
from rolecall.operators.extract import extract_jobs, site_report
from rolecall.operators.joins import drop_known
from rolecall.schemas import BATCH_LEDGER, COMPANY, DEPARTMENT_SYNONYM, JOB, SEARCH_LOG
from rolecall.session import shared_path
from rolecall.sources.readers import read_jobs, read_json_array, read_legacy_companies, read_lines
from rolecall.sources.writers import dealt_in_order, job_batches, write_json_arrays, write_lines

NOW = dt.datetime(2024, 2, 1, 8)


def now():
    return F.lit(NOW).cast("timestamp")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_embedded_json(spark):
    position = {
        "name": "Dev", "department": 12, "location": {"city": "TA", "country": "IL", "is_remote": True},
        "url_comeet_hosted_page": "https://a.com/1", "url_active_page": "", "url_detected_page": "https://b.com",
        "custom_fields": {"details": [
            {"name": "Req", "value": "<p>x</p><p>y</p>"}, {"name": "Other", "value": None}, {"name": None, "value": "z"},
            {"name": "REQ", "value": "last"},
        ]},
    }
    pages = [
        (1, f"var COMPANY_POSITIONS_DATA\n = {json.dumps([position, {'name': 'B'}])}; more];"),
        (2, 'COMPANY_POSITIONS_DATA = [{"name": "a];b"}]; <div class="job-card"><h2>Card</h2></div>'),
        (3, "COMPANY_POSITIONS_DATA = [broken];"),
        (4, "COMPANY_POSITIONS_DATA = [];"),
        (5, None),
    ]
    jobs = extract_jobs(spark.createDataFrame(pages, "id int, html string"))
    got = {(r.id, r.job_pos): r for r in jobs.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    first = got[1, 0]
    assert (first.title, first.location, first.type_errors) == ("Dev", "TA, ISRAEL, (Remote)", ["department"])
    assert first.description_map == {"req": "last", "": "z"} and first.original_website_job_url == "https://b.com"
    assert got[1, 1].location == "Not specified" and got[1, 1].description_map == {}
    assert got[2, 0].title == "Card"
    report = site_report(spark.createDataFrame(pages, "id int, html string"))
    assert [(r.id, r.success, r.jobs) for r in report.orderBy("id").collect()] == [
        (1, True, 2), (2, True, 1), (3, True, 0), (4, True, 0), (5, False, 0),
    ]


def test_validation(spark):
    raw = spark.createDataFrame(
        [
            (1, " Dev ", "HTTPS://A.com", "  ", []), (2, " ", "https://a.com/x", "D", []), (3, None, None, None, []),
            (4, "Dev", "/rel", "D", []), (5, "Dev", "https://a.com/y", "D", ["department"]),
        ],
        "id int, title string, url string, department string, type_errors array<string>",
    )
    checked = validate.check_jobs(raw)
    assert rows(validate.valid_jobs(checked), "id", "title", "url", "department") == [(1, "Dev", "https://a.com/", None)]
    errors = dict(rows(validate.invalid_jobs(checked), "id", "error"))
    assert set(errors) == {2, 3, 4, 5} and errors[5] == "department: input should be a valid string"
    assert errors[3] == "title: field required; url cannot be empty"
    assert validate.validation_summary(checked).first().asDict() == {"invalid": 4, "total": 5}


JOBS = [
    ("Backend Engineer", "Engineering", "Tel Aviv, ISRAEL", "Build services"),
    ("Anything", " General ", "Haifa, ISRAEL", "Build services"),
    ("מפתח תוכנה", "Engineering", "Tel Aviv, ISRAEL", "דרוש מפתח"),
    ("Engineer", "Engineering", "San Francisco, USA", "Build services"),
    ("Engineer", "Engineering", None, "Build services"),
]


def screened(spark):
    jobs = spark.createDataFrame(JOBS, "title string, department string, location string, description_text string")
    return screening.screen(validate.with_raw_fields(jobs))


def test_screening(spark):
    counts = screening.reject_counts(screened(spark)).first().asDict()
    assert counts == {"hebrew": 1, "general_department": 1, "job_not_in_israel": 2, "valid": 1}
    assert sum(counts.values()) == len(JOBS)
    assert rows(screening.kept_jobs(screened(spark)), "title") == [("Backend Engineer",)]


def test_reject_counts_keep_zeros(spark):
    none = screening.reject_counts(screened(spark).limit(0)).first().asDict()
    assert none == {"hebrew": 0, "general_department": 0, "job_not_in_israel": 0, "valid": 0}


def company_rows(spark, *pages):
    return spark.createDataFrame(
        [(i, f"C{i}", "comeet.com", page) for i, page in enumerate(pages)],
        "pos long, company_name string, domain string, company_page_url string",
    )


def test_company_lifecycle(spark):
    empty = spark.createDataFrame([], COMPANY)
    first = tables.insert_companies(empty, company_rows(spark, "u1", "u2", "u1", ""), "pos", now())
    assert rows(first.rows, "id", "company_page_url", "is_active", "source") == [
        (1, "u1", True, "google_serper"), (2, "u2", True, "google_serper"),
    ]
    again = tables.insert_companies(first.snapshot, company_rows(spark, "u2", "u3"), "pos", now())
    assert rows(again.rows, "id", "company_page_url") == [(3, "u3")]
    u1 = spark.createDataFrame([("u1",), ("",)], "company_page_url string")
    touched = tables.touch_companies(again.snapshot, u1, now())
    assert rows(touched.where(F.col("last_scraped").isNotNull()), "company_page_url") == [("u1",)]
    closed = tables.deactivate_companies(touched, u1)
    assert rows(closed.where(~F.col("is_active")), "company_page_url") == [("u1",)]
    gone = tables.delete_by_url(closed, u1, "company_page_url")
    assert gone.rows.count() == 1 and gone.snapshot.count() == 2
    assert tables.delete_by_url(gone.snapshot, u1, "company_page_url").rows.count() == 0


def seed(spark):
    return {
        "departments": reference_data.departments(spark),
        "department_synonyms": reference_data.department_synonyms(spark),
        "locations": reference_data.locations(spark),
        "location_synonyms": reference_data.location_synonyms(spark),
    }


def test_job_insert(spark):
    jobs = spark.createDataFrame(
        [
            (1, "Dev", "https://a.com/1", "engineering", "TLV, IL", "", "2024-01-01"),
            (2, "Dev again", "https://a.com/1", "x", "y", "", None),
            (3, "Ops", "https://u@a.com:81/2", " people OPS", "Haifa", "2024-03-03", "2024-01-01"),
            (4, None, "https://a.com/3", None, None, None, None),
            (5, "No page", None, None, None, None, None),
        ],
        "pos long, title string, url string, department string, location string, last_updated string, publish_date string",
    )
    empty = spark.createDataFrame([], JOB)
    delta = tables.insert_jobs(empty, jobs, "pos", as_of=now(), **seed(spark))
    got = {r.id: r for r in delta.collect()}
    assert set(got) == {1, 2}
    assert (got[1].department_id, got[1].location_id, got[1].publish_date) == (1, 1, "2024-01-01")
    assert (got[2].department_id, got[2].location_id, got[2].publish_date) == (16, 3, "2024-03-03")
    assert got[2].from_domain == "u@a.com:81" and got[1].employment_type == "Full-time" and got[1].is_ai_inferred is False
    stored = delta.select(*JOB.names)
    assert tables.insert_jobs(stored, jobs, "pos", as_of=now(), **seed(spark)).count() == 0
    assert drop_known(jobs.withColumn("url_hash", url_hash(F.col("url"))), stored, "url_hash").select("pos").count() == 2


def test_employment_default_needs_an_absent_column(spark):
    jobs = spark.createDataFrame([(1, "Dev", "https://a.com/1", "text")], "pos long, title string, url string, description_text string")
    dims = seed(spark)
    part = jobs.withColumn("employment_type", F.lit(None).cast("string"))
    row = tables.job_rows(part, **dims, as_of=now()).first()
    assert row.employment_type is None
    row = tables.persist_jobs(spark.createDataFrame([], JOB), jobs, "pos", as_of=now(), **dims).first()
    assert row.employment_type == "Full-time" and row.embed_text == "Dev\n\ntext"


def test_seed_is_idempotent(spark):
    for table in (reference_data.departments(spark), reference_data.locations(spark)):
        assert reference_data.load_seed(table, table).count() == table.count()
    assert reference_data.department_synonyms(spark).count() == 22
    assert reference_data.location_synonyms(spark).count() == 13


def test_synonym_outranks_canonical_name(spark):
    dims = spark.createDataFrame([(1, "Data"), (2, "Data Science")], "id long, canonical_name string")
    synonyms = spark.createDataFrame([(1, "DATA", 2)], "id long, synonym string, department_id long")
    jobs = spark.createDataFrame([("data",), (" Data Science ",), ("Dáta",), (None,)], "department string")
    got = dict(rows(dimensions.with_department_id(jobs, dims, synonyms), "department", "department_id"))
    assert got == {"data": 2, " Data Science ": 2, "Dáta": None, None: None}


def test_dimension_changes(spark):
    dim = reference_data.departments(spark)
    offered = spark.createDataFrame([("Sales", "x"), (" Robotics ", " "), ("Robotics", "R"), (" ", None)],
                                    "canonical_name string, category string")
    change = tables.insert_dimension(dim, offered)
    assert rows(change.snapshot.where("id > 23"), "id", "canonical_name", "category") == [(24, "Robotics", None)]
    assert change.rows.count() == 2
    moves = spark.createDataFrame([(1, "Sales", "x"), (2, "Coding", " "), (3, " ", "x")],
                                  "id long, canonical_name string, category string")
    update = tables.update_dimension(dim, moves)
    assert rows(update.snapshot.where("id <= 3"), "id", "canonical_name", "category") == [
        (1, "Engineering", "R&D"), (2, "Coding", None), (3, "Research & Development", "R&D"),
    ]
    assert rows(update.rows, "id") == [(1,), (3,)]


def test_dimension_delete_cascades(spark):
    parts = seed(spark)
    jobs = spark.createDataFrame([(1, 11), (2, 1), (3, None)], "id long, department_id long")
    doomed = spark.createDataFrame([(11,)], "id long")
    after = tables.delete_dimension(parts["departments"], parts["department_synonyms"], jobs, doomed, "department_id")
    assert after.dimension.count() == 22 and after.synonyms.count() == 20
    assert rows(after.jobs, "id", "department_id") == [(1, None), (2, 1), (3, None)]


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", "processing", NOW), ("b", "failed", NOW)], BATCH_LEDGER)
    more = tables.add_batches(ledger, spark.createDataFrame([("b",), ("c",), (None,)], "batch_id string"), now())
    assert rows(more, "batch_id", "status") == [("a", "processing"), ("b", "failed"), ("c", "processing")]
    remote = spark.createDataFrame([("a", "completed"), ("c", "finalizing")], "batch_id string, status string")
    routed = dict(rows(tables.route_batches(more, remote), "batch_id", "action"))
    assert routed == {"a": "ingest", "c": "wait"}
    done = tables.set_batch_status(more, spark.createDataFrame([("a", "completed"), ("c", "odd")], "batch_id string, status string"))
    assert rows(lookup.processing_batches(done), "batch_id") == [("c",)]


def test_numbers_are_dense_under_ties(spark):
    frame = spark.range(5000).select("id", F.lit(1).alias("same"))
    numbered = numbering.number_rows(frame.repartition(13), ["same", F.col("id").desc()], "n", 7)
    assert numbered.where(F.col("n") != 5006 - F.col("id")).count() == 0
    assert numbered.count() == 5000


def test_dedupe_limits_before_the_shuffle(spark):
    hot = F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.col("id").cast("string"))
    frame = spark.range(1000).select("id", hot.alias("k"), F.col("id").alias("pos"))
    kept = dedupe.first_by_key(frame, ["k"], "pos")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("Exchange", 1)[1] and plan.count("WindowGroupLimit") == 2
    assert kept.count() == 101 and rows(kept.where("k = 'hot'"), "id") == [(0,)]


def test_company_and_job_dedupe(spark):
    frame = spark.createDataFrame(
        [(1, "a", None, "u"), (2, "a", "", "u"), (3, "a", "c", ""), (4, "a", "c", None)],
        "pos int, title string, company string, company_page_url string",
    )
    assert rows(dedupe.unique_companies(frame, "pos"), "pos") == [(1,)]
    assert rows(dedupe.unique_jobs(frame, "pos"), "pos") == [(1,), (3,)]


def test_filters(spark):
    jobs = spark.createDataFrame(
        [("u1", "Tel Aviv-Jaffa, IL", "Remote", 1, NOW), ("u2", "TEL AVIV", "Hybrid", 0, NOW), ("u3", "Haifa 100%", None, 2, None)],
        "url string, location string, workplace_type string, department_id long, scraped_at timestamp",
    )
    assert rows(lookup.filter_records(jobs, {"location": ["tel aviv"], "workplace_type": []}), "url") == [("u1",), ("u2",)]
    assert rows(lookup.filter_records(jobs, {"location": ["ha_fa", "xyz"]}), "url") == [("u3",)]
    with pytest.raises(ValueError, match="salary"):
        lookup.filter_records(jobs, {"salary": ["1"]})
    assert lookup.jobs_by_filters(jobs, workplace_type="", department_id=0, limit=0).count() == 3
    assert [r.url for r in lookup.jobs_by_filters(jobs).collect()] == ["u1", "u2", "u3"]
    assert rows(lookup.unique_values(jobs, "workplace_type"), "workplace_type") == [("Hybrid",), ("Remote",)]


def test_staleness_is_strict(spark):
    hours = lambda n: NOW - dt.timedelta(hours=n)
    table = spark.createDataFrame(
        [("exact", True, hours(24)), ("old", True, hours(25)), ("never", True, None), ("closed", False, None)],
        "company_page_url string, is_active boolean, last_scraped timestamp",
    )
    assert [r[0] for r in lookup.stale(table, now(), 24).select("company_page_url").collect()] == ["never", "old"]


def test_results_last_line_wins(spark):
    line = lambda key, value: json.dumps(
        {"custom_id": key, "response": {"body": {"data": [{"embedding": [value]}]}}}
    )
    path = shared_path(spark, "lines")
    lines = spark.createDataFrame([(line("a", 1.0),), ("",), (line("b", 2.0),), (line("a", 3.0),),
                                   (json.dumps({"custom_id": "c", "error": {"message": "x"}}),)], "value string")
    lines.coalesce(1).write.text(path)
    vectors = embeddings.parse_results(read_lines(spark, path), "pos")
    assert rows(vectors, "url_hash", "embedding") == [("a", [3.0]), ("b", [2.0])]
    jobs = spark.createDataFrame([("a", [0.0]), ("z", [9.0])], "url_hash string, embedding array<float>")
    assert rows(embeddings.write_back(jobs, vectors), "url_hash", "embedding") == [("a", [3.0]), ("z", [9.0])]
    counters = embeddings.write_back_counters(embeddings.match_results(jobs, vectors)).first()
    assert (counters.updated, counters.failed) == (1, 1)


def test_empty_request_batch_is_an_error(spark):
    texts = spark.createDataFrame([("h", "  ")], "url_hash string, embed_text string")
    with pytest.raises(ValueError, match="without requests"):
        write_lines(embeddings.request_lines(texts, "m"), shared_path(spark, "none"))


def test_ranking_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)] + [(300 + i, [1.0] * 5) for i in range(5)]
    cv = [1.0] * 5
    frame = spark.createDataFrame(data, "pos long, embedding array<float>")
    scored = matching.score_jobs(frame, spark.createDataFrame([(cv,)], "embedding array<float>"))

    def score(vector):
        return sum(vector) / (5**0.5 * sum(x * x for x in vector) ** 0.5)

    order = [pos for pos, _ in sorted(((p, score(v)) for p, v in data), key=lambda t: (-round(t[1], 9), t[0]))]
    ranked = {r.rank: r.pos for r in matching.rank_all(scored.withColumn(matching.SCORE, F.round(matching.SCORE, 9)), "pos").collect()}
    assert [ranked[i] for i in range(1, 306)] == order
    best = matching.top_matches(scored.withColumn(matching.SCORE, F.round(matching.SCORE, 9)), "pos", 10)
    assert [r.pos for r in best.orderBy("rank").collect()] == order[:10]


def test_job_batches_split_hot_sources(spark):
    jobs = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("source_url"),
                                    F.lit("same").alias("url"), F.lit(NOW).cast("date").alias("day"))
    documents = [json.loads(r.value) for r in job_batches(jobs, "source_url", 100).collect()]
    sizes = [len(d["jobs"]) for d in documents if d["source_url"] == "hot"]
    assert len(sizes) > 1 and sum(sizes) == 900 and max(sizes) < 200
    assert sum(len(d["jobs"]) for d in documents) == 1000
    assert documents[0]["jobs"][0]["day"] == "2024-02-01"


def test_search_results(spark):
    pages = spark.createDataFrame(
        [(1, "comeet.com", '[{"organic":[{"title":"Jobs at Flare - Comeet","link":"https://www.comeet.com/jobs/f/1/x"},{"title":"y"}]}]'),
         (2, "comeet.com", '[{"credits":1}]'), (3, "comeet.com", "[]")],
        "page int, domain string, payload string",
    )
    hits = discovery.search_hits(pages)
    assert hits.count() == 2
    assert rows(discovery.hits_to_companies(hits), "company_name", "company_page_url", "source") == [
        ("Flare", "https://www.comeet.com/jobs/f/1", "google_serper")
    ]


def test_json_files(spark, tmp_path):
    path = str(tmp_path / "jobs.json")
    records = [{"title": f"T{i}", "day": i} for i in range(50)]
    with open(path, "w", encoding="utf-8") as handle:
        json.dump(records, handle)
    schema = spark.createDataFrame([], "title string, day long").schema
    assert [r.title for r in read_jobs(spark, path, schema, 3).orderBy("pos").collect()] == ["T0", "T1", "T2"]
    assert read_json_array(spark, path, schema).count() == 50
    assert read_json_array(spark, str(tmp_path / "absent.json"), schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_jobs(spark, str(tmp_path / "absent.json"), schema)
    old = [{"company_name": "A", "domain": "d", "job_page_url": "u", "discovered_at": 1761584034.0663881, "last_scraped": None}]
    legacy = str(tmp_path / "legacy.json")
    with open(legacy, "w", encoding="utf-8") as handle:
        json.dump(old, handle)
    row = discovery.legacy_companies(read_legacy_companies(spark, legacy)).first()
    assert row.company_page_url == "u" and row.discovered_at.year == 2025 and row.last_scraped is None


def test_digest_and_seen_store(spark):
    jobs = spark.createDataFrame([(1, "T", None, "Haifa", "u", ["a", "b"], 0.823)],
                                 "rank long, title string, company_name string, location string, url string, highlights array<string>, similarity_score double")
    assert [r.value for r in reports.digest(jobs).collect()] == [
        "Daily matched jobs (1)", "1) [N/A] T — score 0.82\n   Location: Haifa\n   URL: u\n   Highlights: a, b",
    ]
    seen = spark.createDataFrame([("x", dt.datetime(2024, 1, 1))], "job_id string, first_seen timestamp")
    offered = spark.createDataFrame([("x",), ("y",)], "job_id string")
    assert rows(reports.unseen(offered, seen), "job_id") == [("y",)]
    kept = dict(rows(reports.remember(seen, offered, now()), "job_id", "first_seen"))
    assert kept == {"x": dt.datetime(2024, 1, 1), "y": NOW}


def test_unique_values_by_type(spark):
    frame = spark.createDataFrame([("0", 0, True), ("", 2, False), (None, None, None)], "s string, n int, b boolean")
    values = lambda name: [r[0] for r in lookup.unique_values(frame, name).collect()]
    assert (values("s"), values("n"), values("b")) == (["0"], [2], [True])


def test_search_log(spark):
    log = spark.createDataFrame([("a.com", "q", "s", NOW - dt.timedelta(hours=30), 5)], SEARCH_LOG)
    more = discovery.log_search(
        log, spark.createDataFrame([("b.com", "q", "s", 7)], "domain string, query string, source string, results_count long"), now()
    )
    domains = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string")
    assert rows(discovery.domains_due(more, domains, now(), 24), "domain") == [("a.com",), ("c.com",)]


def test_add_synonyms(spark):
    dims = reference_data.departments(spark)
    empty = spark.createDataFrame([], DEPARTMENT_SYNONYM)
    offered = spark.createDataFrame([(" Coding ", 2), ("Coding", 3), (" ", 1), ("Ghost", 99)], "synonym string, department_id long")
    change = tables.add_synonyms(empty, dims, offered, "department_id")
    assert rows(change.snapshot, "id", "synonym", "department_id") == [(1, "Coding", 2)]
    assert change.rows.count() >= 2
    left = tables.delete_synonyms(change.snapshot, spark.createDataFrame([("Coding",)], "synonym string"))
    assert left.count() == 0


def test_write_back_of_few_vectors_equals_the_full_join(spark):
    jobs = spark.createDataFrame([(str(i), [float(i)], i) for i in range(40)], "url_hash string, embedding array<float>, n int")
    vectors = spark.createDataFrame([(str(i), [-1.0]) for i in range(30, 50)], "url_hash string, embedding array<double>")
    few = embeddings.write_back(jobs, vectors, few_vectors=True)
    assert few.columns == jobs.columns
    assert rows(few, *jobs.columns) == rows(embeddings.write_back(jobs, vectors), *jobs.columns)


def test_details_keep_texts_only_and_pages_must_hold_json(spark):
    details = '[{"name":"A","value":"x"},{"name":"B","value":5},{"name":"C","value":{"a":1}},{"value":"y"},{"name":"D","value":true},null]'
    good = 'var COMPANY_POSITIONS_DATA = [{"name":"t","custom_fields":{"details":' + details + '}}];'
    single = "var COMPANY_POSITIONS_DATA = [{'name':'x'}];"
    pages = spark.createDataFrame([(1, good), (2, single)], "id long, html string")
    assert [(r["id"], r["description_map"]) for r in extract_jobs(pages).collect()] == [(1, {"a": "x", "": "y"})]


def test_two_named_hits_of_one_page(spark):
    incoming = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "pos long, url string")
    stored = spark.createDataFrame([("c",)], "url string")
    got = rows(tables.mark_new(incoming, stored, "url", "pos"), "pos", "url", "is_new")
    assert sorted(got) == [(1, "a", True), (1, "b", True), (2, "a", False), (2, "c", False)]


def test_one_change_per_dimension_row_and_name(spark):
    dimension = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, canonical_name string")
    changes = spark.createDataFrame([(1, "N"), (2, "N"), (3, "X"), (3, "Y")], "id long, canonical_name string")
    change = tables.update_dimension(dimension, changes)
    assert sorted(rows(change.snapshot, "id", "canonical_name")) == [(1, "N"), (2, "B"), (3, "X")]
    assert sorted(rows(change.rows, "id", "canonical_name")) == [(2, "N"), (3, "Y")]


def test_equal_hits_count_once(spark):
    incoming = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "")], "pos long, url string")
    stored = spark.createDataFrame([("z",)], "url string")
    got = rows(tables.mark_new(incoming, stored, "url", "pos"), "pos", "url", "is_new")
    assert sorted(got, key=str) == sorted([(1, "a", True), (1, "a", False), (2, "b", True), (3, None, False), (4, "", False)], key=str)


def test_job_batches_do_not_depend_on_splits(spark):
    kinds = F.when(F.col("id") < 700, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id")))
    source = F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 3 == 1, F.lit('b"')).otherwise(F.lit(None))
    jobs = spark.range(2000).select(source.alias("source_url"), kinds.alias("title"), F.lit(None).cast("string").alias("none"))
    batches = [[r.value for r in job_batches(jobs.repartition(n, "title"), "source_url", 50).collect()] for n in (1, 7)]
    assert sorted(batches[0]) == sorted(batches[1])
    documents = [json.loads(value) for value in batches[0]]
    assert max(len(d["jobs"]) for d in documents) < 100
    got = Counter((d.get("source_url"), job["title"]) for d in documents for job in d["jobs"])
    assert got == Counter(map(tuple, jobs.select("source_url", "title").collect()))


def test_json_array_files(spark, tmp_path):
    path = str(tmp_path / "arrays")
    records = spark.range(40).selectExpr("id", "IF(id % 3 = 0, NULL, concat('a\\n\"', id)) AS text")
    write_json_arrays(records.repartitionByRange(4, "id").sortWithinPartitions("id"), path)
    files = sorted((tmp_path / "arrays").glob("*.txt"))
    assert [r["id"] for file in files for r in json.loads(file.read_text(encoding="utf-8"))] == list(range(40))
    assert sorted(map(tuple, read_json_array(spark, path, records.schema).collect())) == sorted(map(tuple, records.collect()))
    first = read_jobs(spark, path, records.schema, 25).collect()
    sizes = [len(json.loads(file.read_text(encoding="utf-8"))) for file in files]
    places = [(file.name, n) for file, size in zip(files, sizes, strict=True) for n in range(size)]
    want = sorted((key, *place) for key, place in zip(range(25), places, strict=False))
    assert sorted((r["id"], r["file"].rsplit("/", 1)[1], r["index"]) for r in first) == want
    write_json_arrays(records.where("false").coalesce(1), str(tmp_path / "none"))
    assert read_json_array(spark, str(tmp_path / "none"), records.schema).count() == 0


def test_numbering_moves_keys_only(spark, monkeypatch):
    sorted_columns = []

    def watch(df):
        sorted_columns.append(df.columns)
        return numbering_cut(df)

    numbering_cut = numbering.cut_lineage
    monkeypatch.setattr(numbering, "cut_lineage", watch)
    bulky = spark.range(100).selectExpr("concat('k', id) AS key", "100 - id AS pos", "repeat('x', 1000) AS text")
    got = numbering.number_keys(bulky, "key", ["pos"], "id", 7)
    assert sorted_columns == [["key", "pos"]]
    assert sorted((r.id, r.pos, len(r.text)) for r in got.collect()) == [(n + 6, n, 1000) for n in range(1, 101)]
    scored = spark.createDataFrame([(1, 0.5, "a"), (2, None, "b"), (3, 0.9, "c")], "pos long, similarity_score double, text string")
    assert sorted(rows(matching.rank_all(scored, "pos"), "rank", "pos", "text")) == [(1, 3, "c"), (2, 1, "a"), (3, 2, "b")]
    assert sorted_columns[1] == ["pos", "similarity_score"]


def test_known_first_id_scans_nothing(spark, monkeypatch):
    def scan(_):
        raise AssertionError("the stored ids were scanned")

    monkeypatch.setattr(tables, "next_id", scan)
    stored = spark.createDataFrame([], "id long, company_name string, company_page_url string, domain string, title string, "
                                   "discovered_at timestamp, last_scraped timestamp, is_active boolean, source string")
    incoming = spark.createDataFrame([(1, "A", "u1", "d"), (2, "B", "u2", "d"), (3, "C", "u1", "d")],
                                     "pos long, company_name string, company_page_url string, domain string")
    change = tables.insert_companies(stored, incoming, "pos", F.lit(NOW).cast("timestamp"), first_id=42)
    assert sorted(rows(change.rows, "id", "company_name")) == [(42, "A"), (43, "B")]


def test_small_sides_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    keys = spark.range(10).mapInArrow(count, "id long")
    assert spark.range(20).join(joins.small_side(keys), "id").count() == 10
    assert spark.range(20).join(joins.small_side(keys, 5), "id").count() == 10
    assert calls.value == 20


def test_array_files_grow_in_number_not_in_size(spark, tmp_path):
    """Twenty times the text lies in as many more files, still in the order of the ids."""
    sizes = []
    for n in (400, 8000):
        path = tmp_path / f"grown-{n}"
        records = spark.range(n).selectExpr("id", "concat(id, repeat('x', 100)) AS text")
        write_json_arrays(dealt_in_order(records, "id", "text", least=5, bytes_per_file=8000), str(path))
        files = sorted(path.glob("*.txt"))
        assert [r["id"] for file in files for r in json.loads(file.read_text(encoding="utf-8"))] == list(range(n))
        sizes.append(max(file.stat().st_size for file in files))
        assert sorted(r["id"] for r in read_jobs(spark, str(path), records.schema, 150).collect()) == list(range(150))
    assert sizes[1] < 2 * sizes[0]
    copies = spark.range(4000).selectExpr("1L AS id", "concat(id, repeat('x', 100)) AS text")
    assert dealt_in_order(copies, "id", "text", bytes_per_file=8000).groupBy(F.spark_partition_id()).count().count() > 10
    assert dealt_in_order(copies.where("false"), "id", "text", least=5).count() == 0
