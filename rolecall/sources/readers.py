"""Landed files to DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.operators.joins import spread_splits
from rolecall.operators.lookup import first_rows
from rolecall.schemas import CV_VECTOR, LEGACY_COMPANY


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def _is_absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_present(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """The table, or an empty one where nothing has been written yet."""
    try:
        return spark.read.format(form).schema(schema).load(path)
    except AnalysisException as error:
        if not _is_absent(error):
            raise
        return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True) -> DataFrame:
    """Records of JSON array files; an absent path gives no rows, or an error when it must exist."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if not (missing_ok and _is_absent(error)):
            raise
        return spark.createDataFrame([], schema)


def read_jobs(spark: SparkSession, path: str, schema: T.StructType, max_jobs: int = 30) -> DataFrame:
    """First records of JSON array files with their ``file`` and ``index`` there, by file name and then record.

    An array file is never split, so rows come in its order; what is taken of a file is its first records, so
    their numbers among the rows taken are their numbers in the file. Only ``max_jobs`` rows are numbered.
    """
    rows = read_json_array(spark, path, schema, missing_ok=False)
    position = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("row"))
    taken = first_rows(rows.withColumn("pos", position), "pos", max_jobs)
    index = F.row_number().over(Window.partitionBy("pos.file_path").orderBy("pos.row")) - 1
    return taken.withColumn("file", F.col("pos.file_path")).withColumn("index", index.cast("long"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page corpus."""
    return spread_splits(spark.read.parquet(path).select("url", "html"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a sortable position: files by name, then lines; parts are written in no order of time."""
    return with_line_order(
        spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_path",
                                     "_metadata.file_block_start")
    )


def read_batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines that landed below ``batch_id=<id>``, with their batch and what orders them; none where none landed."""
    order = ["file_path", "file_block_start"]
    lines = spark.read.schema("value STRING, batch_id STRING").format("text")
    try:
        return lines.load(path).select("batch_id", "value", *[f"_metadata.{c}" for c in order])
    except AnalysisException as error:
        if not _is_absent(error):
            raise
        return spark.createDataFrame([], "batch_id STRING, value STRING, file_path STRING, file_block_start LONG")


def with_line_order(lines: DataFrame) -> DataFrame:
    position: Column = F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("row"))
    return lines.withColumn("pos", position).drop("file_modification_time", "file_path", "file_block_start")


def read_cv(spark: SparkSession, path: str) -> DataFrame:
    """Stored CV vector with its metadata; one row."""
    return spark.read.schema(CV_VECTOR).parquet(path)


def read_legacy_companies(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, LEGACY_COMPANY)


def stream_json(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 10) -> DataFrame:
    """Queue of JSON documents as a stream; a broker topic takes its place in production."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)

