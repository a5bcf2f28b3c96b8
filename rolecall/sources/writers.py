"""DataFrames to files. Writers never gather rows; only bounded reports become one file."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How many postings one batch document holds, about, slots of a source, and lines per request file.
JOBS_PER_DOCUMENT = 1000
SLOTS = 4096
LINES_PER_FILE = 50_000
# Text of the records that one JSON array file holds, about; such a file is read by one task.
BYTES_PER_ARRAY = 64 << 20

_JSON_TYPES = (T.StringType, T.BooleanType, T.NumericType, T.ArrayType, T.MapType, T.StructType)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json_types(df: DataFrame) -> DataFrame:
    """Columns that JSON has no type for become text."""
    return df.select(
        *[
            F.col(f.name) if isinstance(f.dataType, _JSON_TYPES) else F.col(f.name).cast("string").alias(f.name)
            for f in df.schema.fields
        ]
    )


def export_json(df: DataFrame, path: str) -> None:
    write_json(as_json_types(df), path)


def write_report(lines: DataFrame, path: str) -> None:
    """Text report of a bounded top-k; lines must come ordered by ``rank``."""
    lines.coalesce(1).sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, lines_per_file: int = LINES_PER_FILE) -> None:
    """JSON Lines files; an empty batch is an error."""
    if lines.isEmpty():
        raise ValueError("cannot create a batch without requests")
    lines.select("value").write.mode("overwrite").option("maxRecordsPerFile", lines_per_file).text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def company_messages(companies: DataFrame) -> DataFrame:
    """One JSON message per company."""
    return companies.select(F.to_json(F.struct(*companies.columns)).alias("value"))


def job_batches(jobs: DataFrame, source: str, jobs_per_document: int = JOBS_PER_DOCUMENT) -> DataFrame:
    """Batch documents (jobs, source_url) as JSON text, the same ones however the postings are split.

    Postings go to slots by a hash of what they hold. Slots of a source follow one another until a document is
    full; a slot that fills several is dealt again by another hash. Counts are taken per slot, never per source,
    and equal postings are counted before they move and written out in documents of their own where they are many.
    So no task gathers a large source, not even one of identical copies. Values JSON has no type for go out as text.
    """
    plain = as_json_types(jobs)
    fields = [c for c in plain.columns if c != source]
    texts = plain.select(F.col(source).alias("_source"), F.to_json(F.struct(*fields)).alias("_job"))
    slotted = texts.withColumn("_slot", F.pmod(F.xxhash64("_job"), F.lit(SLOTS)))
    unique = slotted.groupBy("_source", "_slot", "_job").agg(F.count("*").alias("_copies"))
    size = F.lit(jobs_per_document)

    slots = slotted.groupBy("_source", "_slot").agg(F.count("*").alias("_rows"))
    # at most SLOTS rows of a source
    before = Window.partitionBy("_source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    parts = slots.select(
        F.col("_source").alias("_of"), F.col("_slot").alias("_in"), F.ceil(F.col("_rows") / size).alias("_deals"),
        F.floor(F.coalesce(F.sum("_rows").over(before), F.lit(0)) / size).alias("_part"),
    )
    placed = unique.join(parts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_in")))
    many = F.col("_copies") > size
    deal = F.when(F.col("_deals") > 1, F.struct(F.pmod(F.xxhash64("_job", F.lit(1)), "_deals").alias("deal"), "_slot"))
    block = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_copies") / size) - 1)).alias("_block")
    blocks = placed.select(
        "_source", "_job", "_copies", "_part", deal.alias("_deal"), F.when(many, F.xxhash64("_job")).alias("_alone"), block
    )
    times = F.least(size, F.col("_copies") - F.col("_block") * size).cast("int")
    documents = blocks.groupBy("_source", "_part", "_deal", "_alone", "_block").agg(
        F.sort_array(F.collect_list(F.struct("_job", times.alias("_times")))).alias("_jobs")
    )
    listed = F.array_join(F.flatten(F.transform("_jobs", lambda j: F.array_repeat(j["_job"], j["_times"]))), ",")
    named = F.to_json(F.struct(F.col("_source").alias("source_url")))
    rest = F.when(F.col("_source").isNull(), F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(named, 2, 2**31 - 1)))
    return documents.select(F.concat(F.lit('{"jobs":['), listed, F.lit("]"), rest).alias("value"))


def dealt_in_order(df: DataFrame, key: str, text: str, least: int = 1, bytes_per_file: int = BYTES_PER_ARRAY) -> DataFrame:
    """Rows in order of ``key``, then by the hash of ``text``, over as many partitions as its bytes ask for, ``least`` at least."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    order = [F.col(key), F.xxhash64(text)]
    return df.repartitionByRange(max(least, -(-size // bytes_per_file)), *order).sortWithinPartitions(*order)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array file per partition, in the order of its rows; a record a line, written as it comes."""
    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            texts = [f"{mark if n == 0 else ','}{record}" for n, record in enumerate(batch.column(0).to_pylist())]
            if texts:
                mark = ","
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        closing = "]" if mark == "," else "[]"
        yield pa.RecordBatch.from_arrays([pa.array([closing], pa.string())], names=["value"])

    records.mapInArrow(lines, "value string").write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
