"""Append-only Parquet tables fed by micro-batches.

Each micro-batch owns the folder ``load_id=<n>``. A replay overwrites its own folder and looks
only at earlier ones, so processing a batch twice leaves the same table.

A job that fills several tables commits them together: after the last of its loads is written it adds
the load to ``commits``. Loads are committed in order, so the highest committed one says which loads
of every table are whole; readers see no later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.sources.readers import read_if_present


COMMIT = T.StructType([T.StructField("tables", T.ArrayType(T.StringType()))])


def write_load(
    df: DataFrame, path: str, load_id: int, form: str = "parquet", lookup: tuple[str, ...] = (), parts: tuple[str, ...] = ()
) -> None:
    """Write one load. ``lookup`` names the columns that point lookups ask for: they get bloom filters. ``parts``
    are columns that become folders."""
    writer = df.write.mode("overwrite").format(form).partitionBy(*parts)
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.save(f"{path}/load_id={load_id}")


def read_load(spark: SparkSession, path: str, load_id: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/load_id={load_id}")


def read_loads(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All loads with their ``load_id``, or only those before a given one; other folders are not listed."""
    full = T.StructType([*schema.fields, T.StructField("load_id", T.LongType())])
    table = read_if_present(spark, path, full)
    return table if before is None else table.where(F.col("load_id") < before)


def commit(spark: SparkSession, root: str, load_id: int, tables: list[str]) -> None:
    """Make the load of all named tables visible at once: one small file is written, or none."""
    manifest = spark.createDataFrame([(sorted(tables),)], COMMIT).coalesce(1)
    write_load(manifest, f"{root}/commits", load_id)


def last_commit(spark: SparkSession, root: str) -> int:
    """The highest committed load, or -1. One value, from the names of the folders."""
    commits = read_loads(spark, f"{root}/commits", COMMIT)
    return commits.agg(F.coalesce(F.max("load_id"), F.lit(-1))).first()[0]


def read_committed(spark: SparkSession, root: str, table: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of committed loads with their ``load_id``; the bound is a partition filter."""
    latest = last_commit(spark, root)
    bound = latest + 1 if before is None else min(before, latest + 1)
    return read_loads(spark, f"{root}/{table}", schema, before=bound)


def last_mark(spark: SparkSession, path: str, before: int) -> int:
    """The highest id that loads before the given one have given out, or 0; one row a load is read."""
    marks = read_loads(spark, path, T.StructType([T.StructField("mark", T.LongType())]), before)
    return marks.agg(F.coalesce(F.max("mark"), F.lit(0))).first()[0]
