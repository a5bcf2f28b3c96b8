"""Dense global row numbers without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.session import cut_lineage

_ROW_BITS = (1 << 33) - 1


def number_keys(df: DataFrame, key: str, order_by: list[str], name: str, start: int | Column = 1) -> DataFrame:
    """As ``number_rows``, for bulky rows with a unique key: only key and order are sorted and checkpointed.

    The numbers then join the rows by their key; rows that a window or an aggregate over the key has placed
    already do not move again.
    """
    narrow = df.select(key, *[c for c in order_by if c != key])
    numbered = number_rows(narrow, list(order_by), name, start).select(key, name)
    return df.join(numbered, key)


def number_rows(df: DataFrame, order_by: list[Column | str], name: str, start: int | Column = 1) -> DataFrame:
    """Add consecutive numbers in a global order.

    A range sort spreads the rows, a reliable checkpoint fixes their placement, and one small
    table of rows per partition turns local positions into global ones. Equal sort keys stay
    splittable as long as the order ends in a unique column.
    """
    placed = cut_lineage(df.orderBy(*order_by))
    tagged = placed.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_local"),
    )
    per_part = tagged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # as many rows as the sort has partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_local") + first).cast("long"))
        .drop("_part", "_local", "_before")
    )
