"""Embedding exchange, ranking and digest over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.functions.text import cut, squeeze
from rolecall.operators import embeddings, matching, reports
from rolecall.operators.joins import is_small
from rolecall.operators.screening import above_score
from rolecall.plans.inputs import SCORED_SQL, cv_row, load, moment, shown, shown_sql
from rolecall.plans.registry import query
from rolecall.session import shared_path
from rolecall.sources.readers import read_cv, read_jobs, read_json_array, read_table
from rolecall.sources.writers import dealt_in_order, export_json, write_json, write_json_arrays, write_lines, write_report, write_vectors

MODEL = "text-embedding-small"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return matching.score_jobs(load(spark, sf, "embeddings"), cv_row(spark, sf))


@query("p11_cosine", f"WITH {SCORED_SQL} SELECT vec_id, round(similarity_score, 6) AS score FROM scored")
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("vec_id", F.round(matching.SCORE, 6).alias("score"))


@query(
    "j6_top_matches",
    f"""WITH {SCORED_SQL} SELECT vec_id, label, round(similarity_score, 6) AS score,
    row_number() OVER (ORDER BY similarity_score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 10""",
)
def top_matches(spark: SparkSession, sf: str) -> DataFrame:
    best = matching.top_matches(_scored(spark, sf), "vec_id", 10)
    return best.select("vec_id", "label", F.round(matching.SCORE, 6).alias("score"), "rank")


@query(
    "w3_rank_all",
    f"WITH {SCORED_SQL} SELECT vec_id, row_number() OVER (ORDER BY similarity_score DESC, vec_id) AS rank FROM scored",
)
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return matching.rank_all(_scored(spark, sf).select("vec_id", matching.SCORE), "vec_id").select("vec_id", "rank")


@query(
    "a6_score_statistics",
    f"""WITH {SCORED_SQL} SELECT count(*) AS scored, round(avg(similarity_score) * 100, 6) AS mean_pct,
    round(max(similarity_score) * 100, 6) AS max_pct, round(min(similarity_score) * 100, 6) AS min_pct,
    round(stddev_pop(similarity_score) * 100, 6) AS stddev_pct FROM scored""",
)
def statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = matching.score_statistics(_scored(spark, sf))
    return stats.select("scored", *[F.round(c, 6).alias(c) for c in stats.columns if c != "scored"])


@query(
    "p12_formats",
    f"""WITH {SCORED_SQL} SELECT vec_id, printf('%.4f', similarity_score) AS shown,
    printf('%.2f%%', similarity_score * 100) AS percent FROM scored""",
)
def formats(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col(matching.SCORE)
    return _scored(spark, sf).select(
        "vec_id", F.format_string("%.4f", score).alias("shown"), matching.display_line(score).alias("percent")
    )


@query(
    "p12_cuts",
    "SELECT doc_id, md5(left(text, 500)) AS head, md5(left(text, 200)) AS snippet, length(text) AS text_length FROM documents",
)
def cuts(spark: SparkSession, sf: str) -> DataFrame:
    """What a report shows of a text, and how long the text is."""
    rows = load(spark, sf, "documents")
    text = F.col("text")
    return rows.select(
        "doc_id", F.md5(cut(text, 500)).alias("head"), F.md5(cut(text, 200)).alias("snippet"), F.length(text).cast("long").alias("text_length")
    )


@query(
    "d2_min_score",
    f"WITH {SCORED_SQL} SELECT vec_id FROM scored WHERE similarity_score >= 0.6",
)
def above_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return above_score(_scored(spark, sf)).select("vec_id")


@query(
    "s11_model_mismatch",
    "SELECT vec_id, label > 4 AS model_mismatch FROM embeddings",
)
def mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """The CV vector is stored with its metadata, read back, and its model compared."""
    path = shared_path(spark, "cv")
    write_vectors(embeddings.with_metadata(cv_row(spark, sf), MODEL, F.lit("cv.pdf")), path)
    model = F.when(F.col("label") > 4, F.lit("other-model")).otherwise(F.lit(MODEL))
    vectors = load(spark, sf, "embeddings").select("vec_id", model.alias("model_name"))
    return matching.model_mismatch(vectors, read_cv(spark, path)).drop("model_name")


@query(
    "s10_stored_vectors",
    "SELECT vec_id::VARCHAR AS source_file, 64::BIGINT AS embedding_dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
)
def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "vectors")
    write_vectors(
        embeddings.with_metadata(load(spark, sf, "embeddings"), MODEL, F.col("vec_id").cast("string")), path
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read_table(spark, path).select("source_file", "embedding_dim", F.round(total, 4).alias("total"))


@query(
    "s8_request_lines",
    f"""SELECT md5(text) AS custom_id, 'POST' AS method, '/v1/embeddings' AS url, '{MODEL}' AS model, md5(text) AS input
    FROM documents WHERE trim(text, ' ' || chr(10)) <> ''""",
)
def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON Lines and read back."""
    path = shared_path(spark, "requests")
    texts = load(spark, sf, "documents").select(F.md5("text").alias("url_hash"), F.col("text").alias("embed_text"))
    write_lines(embeddings.request_lines(texts, MODEL), path)
    schema = "custom_id STRING, method STRING, url STRING, body STRUCT<model STRING, input STRING>"
    return spark.read.schema(schema).json(path).select(
        "custom_id", "method", "url", F.col("body.model").alias("model"), F.md5("body.input").alias("input")
    )


def _result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two result lines per vector, the later one halved, and a blank line."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    half = F.transform("embedding", lambda x: x.cast("double") / 2)

    def result(vector):
        response = F.struct(F.struct(F.array(F.struct(vector.alias("embedding"))).alias("data")).alias("body"))
        return F.to_json(F.struct(F.col("vec_id").cast("string").alias("custom_id"), response.alias("response")))

    rows = load(spark, sf, "embeddings")
    return rows.select(F.posexplode(F.array(result(double), F.lit("  "), result(half))).alias("_n", "value"), "vec_id").select(
        (F.col("vec_id") * 3 + F.col("_n")).alias("pos"), "value"
    )


@query(
    "s9_batch_results",
    """SELECT vec_id::VARCHAR AS url_hash, 64::BIGINT AS dim, round(embedding[1]::DOUBLE / 2, 6) AS first,
    round(embedding[64]::DOUBLE / 2, 6) AS last FROM embeddings""",
)
def batch_results(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embeddings.parse_results(_result_lines(spark, sf), "pos")
    return vectors.select(
        "url_hash", F.size("embedding").cast("long").alias("dim"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"),
        F.round(F.get("embedding", F.lit(63)), 6).alias("last"),
    )


def _documents_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents have a vector already."""
    old = load(spark, sf, "labels").select("doc_id", F.array(F.col("quality").cast("float")).alias("embedding"))
    docs = load(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url_hash"), "lang")
    return docs.join(old, "doc_id", "left")


@query(
    "j5_write_back",
    """SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN round(e.embedding[1]::DOUBLE / 2, 5)
     ELSE quality::DOUBLE END AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def write_back(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embeddings.parse_results(_result_lines(spark, sf), "pos")
    jobs = _documents_with_vectors(spark, sf)
    updated = embeddings.write_back(jobs, vectors, few_vectors=is_small(vectors.select("url_hash")))
    return updated.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query(
    "a12_write_back_counters",
    """SELECT count(*) FILTER (lang = 'en') AS updated, count(*) FILTER (coalesce(lang <> 'en', true)) AS failed
    FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
)
def write_back_counters(spark: SparkSession, sf: str) -> DataFrame:
    jobs = load(spark, sf, "documents").where(F.col("lang") == "en").select(F.col("doc_id").cast("string").alias("url_hash"))
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("url_hash"))
    return embeddings.write_back_counters(embeddings.match_results(jobs, vectors))


@query(
    "a13_batch_progress",
    """SELECT o_orderpriority AS batch_id, count(*) FILTER (o_orderstatus = 'F') AS completed,
    count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS total FROM orders GROUP BY 1""",
)
def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    requests = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("batch_id"), F.col("o_orderkey").alias("custom_id"), "o_orderstatus"
    )
    results = requests.where(F.col("o_orderstatus") == "F")
    errors = requests.where(F.col("o_orderstatus") == "P")
    return embeddings.batch_progress(requests, results, errors)


_PROMPT = {
    "model": "chat-model",
    "temperature": 0.3,
    "system_prompt": "Describe the job that fits this person.",
    "user_template": "Task: write a job description.\nInput CV:\n{cv_text}\n\nOutput:\n",
}


@query(
    "x14_chat_requests",
    """SELECT conv_id, turn, 'chat-model' AS model, 'user' AS role, md5('Task: write a job description.' || chr(10)
     || 'Input CV:' || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || chr(10) || 'Output:' || chr(10))
     AS content FROM conversations""",
)
def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn plays a CV: cleaned, rendered into the template, encoded and decoded."""
    cvs = load(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("key"), squeeze(F.col("text")).alias("cv")
    )
    requests = embeddings.chat_requests(cvs, "key", "cv", _PROMPT)
    schema = "model STRING, messages ARRAY<STRUCT<role STRING, content STRING>>"
    parsed = requests.select("key.*", F.from_json("request", schema).alias("r"))
    user = F.get(F.col("r.messages"), F.lit(1))
    return parsed.select(
        "conv_id", "turn", F.col("r.model").alias("model"), user["role"].alias("role"),
        F.md5(user["content"]).alias("content"),
    )


def _job_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Scored vectors dressed as postings."""
    scored = _scored(spark, sf)
    return scored.select(
        "vec_id", F.concat(F.lit("Job "), F.col("vec_id")).alias("title"),
        F.concat(F.lit("Team "), F.col("label")).alias("company_name"), F.lit("Haifa").alias("location"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("vec_id")).alias("url"),
        F.array(F.lit("Spark"), F.concat(F.lit("L"), F.col("label"))).alias("highlights"),
        F.lit("Text").alias("description"), "embedding", F.lit("long").alias("full_text"), matching.SCORE,
    )


_TOP_SQL = f"""WITH {SCORED_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY similarity_score DESC, vec_id) AS rank
 FROM scored QUALIFY rank <= 10)"""


@query(
    "s7_ranked_report",
    f"""{_TOP_SQL} SELECT rtrim(string_agg(value, '|' ORDER BY rank), '|') AS report FROM (SELECT 0 AS rank, 'CV: cv.pdf|Jobs analyzed: '
     || (SELECT count(*) FROM embeddings) || '|' || repeat('=', 60) || '|' AS value UNION ALL SELECT rank,
     '#' || rank || ' | Score: ' || printf('%.4f', similarity_score) || '|    Job ' || vec_id || ' @ Team ' || label
     || '|    Text...|' FROM top)""",
)
def ranked_report(spark: SparkSession, sf: str) -> DataFrame:
    """Written as one text file and read back, lines joined by a bar."""
    path = shared_path(spark, "report")
    jobs = _job_matches(spark, sf)
    total = jobs.agg(F.count("*").alias("n"))
    lines = matching.ranked_report(matching.top_matches(jobs, "vec_id", 10), "cv.pdf", total)
    write_report(lines, path)
    return spark.read.text(path, wholetext=True).select(
        F.rtrim(F.replace("value", F.lit("\n"), F.lit("|")), F.lit("|")).alias("report")
    )


@query(
    "s6_export_matches",
    f"""WITH {SCORED_SQL} SELECT vec_id, 'Team ' || label AS company_name, round(similarity_score, 6) AS score,
    'vec_id,title,company_name,location,url,highlights,description,similarity_score' AS columns FROM scored""",
)
def export_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Scored postings without vector and full text, through JSON."""
    path = shared_path(spark, "matches")
    write_json(matching.for_export(_job_matches(spark, sf)), path)
    lines = spark.read.text(path)
    record = F.from_json("value", "vec_id BIGINT, company_name STRING, similarity_score DOUBLE")
    columns = F.array_join(F.json_object_keys("value"), ",").alias("columns")  # what each record really has
    back = lines.select(record.alias("r"), columns)
    return back.select("r.vec_id", "r.company_name", F.round("r.similarity_score", 6).alias("score"), "columns")


@query(
    "s5_export_rows",
    """SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
    round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Filter result through JSON; times go out as text."""
    path = shared_path(spark, "export")
    rows = load(spark, sf, "orders").where(F.col("o_orderpriority") == "2-HIGH")
    export_json(rows.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), path)
    schema = "o_orderkey BIGINT, o_orderstatus STRING, o_orderdate STRING, o_totalprice DOUBLE"
    back = spark.read.schema(schema).json(path)
    return back.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "s4_json_records",
    "SELECT doc_id, md5(text) AS text, CASE WHEN lang <> 'de' THEN lang END AS lang FROM documents",
)
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "records")
    lang = F.when(F.col("lang") != "de", F.col("lang"))
    write_json(load(spark, sf, "documents").select("doc_id", "text", lang.alias("lang")), path)
    back = spark.read.schema("doc_id BIGINT, text STRING, lang STRING").json(path)
    return back.select("doc_id", F.md5("text").alias("text"), "lang")


@query(
    "d3_digest",
    f"""{_TOP_SQL} SELECT 0 AS rank, 'Daily matched jobs (' || count(*) || ')' AS value FROM top UNION ALL SELECT rank,
     rank || ') [Team ' || label || '] Job ' || vec_id || ' — score ' || printf('%.2f', similarity_score) || chr(10)
     || '   Location: Haifa' || chr(10) || '   URL: https://jobs.example.com/' || vec_id || chr(10)
     || '   Highlights: Spark, L' || label FROM top""",
)
def digest(spark: SparkSession, sf: str) -> DataFrame:
    return reports.digest(matching.top_matches(_job_matches(spark, sf), "vec_id", 10))


@query(
    "d3_export",
    f"""WITH {SCORED_SQL} SELECT md5('Team ' || label || chr(1) || 'Job ' || vec_id || chr(1) || 'https://jobs.example.com/'
     || vec_id) AS job_id, 'Team ' || label AS company, 'https://jobs.example.com/' || vec_id AS apply_url,
    round(similarity_score, 6) AS score FROM scored""",
)
def filtered_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.export_rows(_job_matches(spark, sf).withColumn("department", F.lit("R&D")))
    return rows.select("job_id", "company", "apply_url", F.round("score", 6).alias("score"))


@query(
    "d4_unseen_jobs",
    """SELECT DISTINCT user_id AS job_id FROM events WHERE user_id NOT IN
    (SELECT user_id FROM events WHERE event_type = 'signup' AND value < 3)""",
)
def unseen_jobs(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    seen = events.where((F.col("event_type") == "signup") & (F.col("value") < 3)).select(F.col("user_id").alias("job_id"))
    return reports.unseen(events.select(F.col("user_id").alias("job_id")).distinct(), seen)


@query(
    "d4_seen_store",
    f"""SELECT job_id, {shown_sql('first_seen')} FROM (SELECT user_id AS job_id, min(CASE WHEN event_type = 'signup'
     AND value < 3 THEN ts ELSE TIMESTAMP '2024-02-01 00:00:00' END) AS first_seen FROM events GROUP BY 1) s""",
)
def seen_store(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    seen = events.where((F.col("event_type") == "signup") & (F.col("value") < 3)).groupBy(
        F.col("user_id").alias("job_id")
    ).agg(F.min("ts").cast("timestamp").alias("first_seen"))
    jobs = events.select(F.col("user_id").alias("job_id"))
    return reports.remember(seen, jobs, moment("2024-02-01 00:00:00")).select("job_id", shown("first_seen"))


@query(
    "s3_first_jobs",
    """SELECT row_number() OVER (ORDER BY doc_id) AS place, doc_id, md5(text) AS text, source FROM documents
    ORDER BY doc_id LIMIT 150""",
)
def first_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents landed as several array files in order of their ids; the first records, with their places."""
    path = shared_path(spark, "job-files")
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    write_json_arrays(dealt_in_order(docs, "doc_id", "text", least=5), path)
    taken = read_jobs(spark, path, docs.schema, 150)
    # records before this one: those of earlier files, all of which are taken, and the index in its own
    earlier = taken.groupBy("file").agg(F.count("*").alias("_n")).select(
        "file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    place = (F.col("_before") + F.col("index") + 1).alias("place")
    return taken.join(earlier, "file").select(place, "doc_id", F.md5("text").alias("text"), "source")


@query("s2_json_arrays", "SELECT doc_id, md5(text) AS text, source FROM documents")
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Landed as JSON array files of at most 500 records each, read back record by record."""
    path = shared_path(spark, "arrays")
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    chunk = F.floor(F.monotonically_increasing_id() / 500)
    arrays = docs.withColumn("_chunk", chunk).groupBy("_chunk").agg(F.collect_list(F.struct(*docs.columns)).alias("_rows"))
    arrays.select(F.to_json("_rows").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_json_array(spark, path, docs.schema).select("doc_id", F.md5("text").alias("text"), "source")
