"""Levelled runs over the loads of a keyed table: reading the current rows touches a logarithmic number of folders.

With fan ``f``, loads 0 to n-1 are covered by runs whose sizes are the digits of n in base f: 27 loads at fan 4 by
one run of 16, two of 4 and three single loads. The load that fills a run merges it, before it commits; a replay
merges the same loads to the same folder. Which runs are current follows from the last commit alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rolecall.operators.dedupe import last_by_key
from rolecall.streaming.tables import read_load


def spans(loads: int, fan: int) -> list[tuple[int, int]]:
    """Runs ``(first, after last)`` over the loads, longest first."""
    size = 1
    while size * fan <= loads:
        size *= fan
    found, first = [], 0
    while first < loads:
        if loads - first >= size:
            found.append((first, first + size))
            first += size
        else:
            size //= fan
    return found


@dataclass(frozen=True)
class Runs:
    """The last row per ``key``, by the column ``at``, of a table that grows by loads.

    ``loads`` is the folder of the loads, ``path`` that of the merged runs; both hold rows of ``schema``, of
    which those that ``where`` names belong to the table.
    """

    loads: str
    path: str
    schema: T.StructType
    key: str
    at: str
    where: str = "true"
    fan: int = 8

    def __post_init__(self) -> None:
        if self.fan < 2:
            raise ValueError("a fan of 2 or more")

    def _read(self, spark: SparkSession, span: tuple[int, int]) -> DataFrame:
        if span[1] - span[0] == 1:
            return read_load(spark, self.loads, span[0], self.schema).where(self.where)
        return spark.read.schema(self.schema).parquet(f"{self.path}/run={span[0]}-{span[1]}")

    def _last(self, spark: SparkSession, parts: list[tuple[int, int]]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self._read(spark, part) for part in parts])
        return last_by_key(rows, [self.key], self.at)

    def merge(self, spark: SparkSession, load_id: int) -> None:
        """Write the runs that this load fills, short ones first."""
        loads, size = load_id + 1, self.fan
        while loads % size == 0:
            first, step = loads - size, size // self.fan
            parts = [(a, a + step) for a in range(first, loads, step)]
            self._last(spark, parts).write.mode("overwrite").parquet(f"{self.path}/run={first}-{loads}")
            size *= self.fan

    def current(self, spark: SparkSession, last_load: int) -> DataFrame:
        """The last row per key of all loads up to the given one; none for -1."""
        if last_load < 0:
            return spark.createDataFrame([], self.schema)
        return self._last(spark, spans(last_load + 1, self.fan))
