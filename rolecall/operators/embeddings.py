"""Embedding round trip: request lines out, result lines in, vectors onto postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.functions.text import has_text
from rolecall.operators.dedupe import last_by_key
from rolecall.operators.joins import small_side
from rolecall.schemas import EMBEDDING_RESULT

# The route of an embedding request.
METHOD, ROUTE = "POST", "/v1/embeddings"


def request_lines(texts: DataFrame, model: str, key: str = "url_hash", text: str = "embed_text") -> DataFrame:
    """One JSON request per non-blank text, as a single text column."""
    body = F.struct(F.lit(model).alias("model"), F.col(text).alias("input"))
    request = F.struct(
        F.col(key).alias("custom_id"), F.lit(METHOD).alias("method"), F.lit(ROUTE).alias("url"), body.alias("body")
    )
    return texts.where(has_text(F.col(text))).select(F.to_json(request).alias("value"))


def parse_results(lines: DataFrame, position: str, line: str = "value") -> DataFrame:
    """Key and vector per result line. Blank lines are skipped; of equal keys the last line stays."""
    extra = [c for c in lines.columns if c not in (line, position)]
    parsed = lines.where(has_text(F.col(line))).select(
        *extra, position, F.from_json(line, EMBEDDING_RESULT).alias("_r")
    )
    vector = F.get(F.col("_r.response.body.data"), F.lit(0))["embedding"]
    rows = parsed.select(*extra, position, F.col("_r.custom_id").alias("url_hash"), vector.alias("embedding"))
    filled = rows.where(F.col("url_hash").isNotNull() & F.col("embedding").isNotNull())
    return last_by_key(filled, ["url_hash"], position)


#: What becomes of a result line: a vector, nothing, or a reject of one of three kinds.
VECTOR_LINE, BLANK_LINE, REJECTS = "vector", "blank", ("malformed", "error", "no vector")


def sort_result_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Every line with ``url_hash``, ``embedding`` and its ``outcome``; no line is left out.

    A line that is not whole JSON of the expected types is malformed, also where its key could be read; one that
    names an error message is an error; one without a key or with no or an empty vector has no vector.
    """
    form = T.StructType([*EMBEDDING_RESULT.fields, T.StructField("_damage", T.StringType())])
    parsed = lines.withColumn("_r", F.from_json(line, form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damage"}))
    key, vector = F.col("_r.custom_id"), F.get(F.col("_r.response.body.data"), F.lit(0))["embedding"]
    outcome = (
        F.when(~F.coalesce(has_text(F.col(line)), F.lit(False)), BLANK_LINE)
        .when(F.col("_r").isNull() | F.col("_r._damage").isNotNull(), REJECTS[0])
        .when(F.col("_r.error.message").isNotNull(), REJECTS[1])
        .when(key.isNull() | (F.coalesce(F.size(vector), F.lit(0)) <= 0), REJECTS[2])
        .otherwise(VECTOR_LINE)
    )
    sorted_lines = parsed.withColumn("outcome", outcome).withColumn("url_hash", key)
    usable = F.when(F.col("outcome") == VECTOR_LINE, vector)
    return sorted_lines.withColumn("embedding", usable).drop("_r")


def batch_counters(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per batch the lines read and what became of them; ``lines`` are sorted ones with their ``batch_id``.

    ``lines = blank + malformed + error + no vector + superseded + updated + failed``: of equal keys of a batch the
    last line counts as updated, where a posting has the key, or as failed, the others as superseded.
    """
    keys = lines.where(F.col("outcome") == VECTOR_LINE).groupBy("batch_id", "url_hash").agg(F.count("*").alias("_lines"))
    matched = match_results(jobs, keys.select("url_hash").distinct()).where("matched").select("url_hash", F.lit(True).alias("_known"))
    vectors = keys.join(matched, "url_hash", "left").groupBy("batch_id").agg(
        (F.sum("_lines") - F.count("*")).alias("superseded"),
        F.count("_known").alias("updated"),
        F.count_if(F.col("_known").isNull()).alias("failed"),
    )
    others = [BLANK_LINE, *REJECTS]
    outcomes = lines.groupBy("batch_id").agg(
        F.count("*").alias("lines"), *[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in others]
    )
    return outcomes.join(vectors, "batch_id", "left").na.fill(0, ["superseded", "updated", "failed"])


def write_back(jobs: DataFrame, vectors: DataFrame, few_vectors: bool = False) -> DataFrame:
    """Postings with the new vector where there is one, else the one they had.

    When ``is_small`` holds for the vectors, pass ``few_vectors``: only the postings they belong to
    are shuffled then, all others are copied where they lie.
    """
    fresh = vectors.select("url_hash", F.col("embedding").cast("array<float>").alias("_new"))
    if not few_vectors:
        return _with_vectors(jobs, fresh)
    keys = F.broadcast(vectors.select("url_hash"))
    touched = _with_vectors(jobs.join(keys, "url_hash", "left_semi").select(*jobs.columns), fresh)
    return jobs.join(keys, "url_hash", "left_anti").select(*jobs.columns).unionByName(touched)


def _with_vectors(jobs: DataFrame, fresh: DataFrame) -> DataFrame:
    joined = jobs.join(fresh, "url_hash", "left")
    return joined.withColumn("embedding", F.coalesce("_new", "embedding")).select(*jobs.columns)


def match_results(jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each result key with ``matched``: whether a posting has it.

    Result keys are unique; while they are few the stored postings are scanned, not shuffled.
    """
    keys = small_side(vectors.select("url_hash"))
    known = jobs.select("url_hash").join(keys, "url_hash", "left_semi").distinct()
    return keys.join(known.withColumn("_known", F.lit(True)), "url_hash", "left").select(
        "url_hash", F.coalesce("_known", F.lit(False)).alias("matched")
    )


def write_back_counters(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if("matched").alias("updated"), F.count_if(~F.col("matched")).alias("failed"))


def batch_progress(requests: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Completed, failed and total requests per batch; inputs are (batch_id, custom_id)."""
    done = results.select("batch_id", "custom_id").distinct().withColumn("_done", F.lit(1))
    broken = errors.select("batch_id", "custom_id").distinct().withColumn("_broken", F.lit(1))
    keys = ["batch_id", "custom_id"]
    joined = requests.select(*keys).join(done, keys, "left").join(broken, keys, "left")
    return joined.groupBy("batch_id").agg(
        F.count("_done").alias("completed"),
        F.count_if(F.col("_done").isNull() & F.col("_broken").isNotNull()).alias("failed"),
        F.count("*").alias("total"),
    )


def with_metadata(df: DataFrame, model_name: str, source_file: Column, embedding: str = "embedding") -> DataFrame:
    """A vector beside its model, source and dimension, ready to be stored."""
    return df.select(
        F.col(embedding).alias("embedding"),
        F.lit(model_name).alias("model_name"),
        source_file.alias("source_file"),
        F.size(embedding).cast("long").alias("embedding_dim"),
    )


def chat_requests(cvs: DataFrame, key: str, text: str, prompt: dict) -> DataFrame:
    """Model request per CV: the rendered template behind the system message, as JSON."""
    rendered = F.replace(F.lit(prompt["user_template"]), F.lit("{cv_text}"), F.col(text))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    request = F.struct(
        F.lit(prompt["model"]).alias("model"),
        F.lit(prompt["temperature"]).alias("temperature"),
        F.array(message("system", F.lit(prompt["system_prompt"])), message("user", rendered)).alias("messages"),
    )
    return cvs.select(key, F.to_json(request).alias("request"))
