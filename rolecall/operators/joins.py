"""Joins that broadcast a side only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.session import cut_lineage

SMALL_ROWS = 200_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Counted per split and summed, so no split's rows meet in one task. For written tables: a plan would run twice."""
    return df.count() <= rows


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A narrow table, worked out once, with a broadcast hint if it has at most ``rows`` rows; else for a shuffled join."""
    once = cut_lineage(df)
    return F.broadcast(once) if is_small(once, rows) else once


def drop_known(new: DataFrame, known: DataFrame, key: str, new_is_small: bool = False) -> DataFrame:
    """Rows of ``new`` whose key is not in ``known``.

    When ``is_small`` holds for the delta, pass ``new_is_small``: the stored side is then only
    scanned for the delta's keys, never shuffled.
    """
    stored = known.select(key)
    if new_is_small:
        wanted = new.select(key).where(F.col(key).isNotNull()).distinct()
        stored = stored.join(F.broadcast(wanted), key, "left_semi")
    return new.join(stored, key, "left_anti")


def spread_splits(scan: DataFrame) -> DataFrame:
    """Spread a table scan over all cores before heavy per-row work, if it has fewer splits than cores.

    Such a scan is at most a split per core long, so the shuffle is small; longer tables stay
    where they are. For scans only: counting the splits of a later plan would run its stages.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
