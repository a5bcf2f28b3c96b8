"""Operator 10, line dedup: levelled sorted runs of line hashes; each new batch is anti-joined with them and adds its own."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import free_name, packed_row, stage, table
from rolecall.llm.registry import query

BATCHES = 4
FANOUT = 2
LEAST_LENGTH = 10
BLANKS = " \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class LineRuns:
    """The keys seen so far with the smallest id that holds each.

    A run is a table bucketed and sorted by key, so a batch is dealt into the same buckets and
    merged with it while the run itself stays where it is. Runs share no keys. Once a level has
    ``fanout`` runs they are rewritten as one run of the next level, so a store of n batches has
    about ``fanout * log(n)`` runs. ``buckets`` stays as it is for the life of a store.
    """

    spark: SparkSession
    buckets: int
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    name: str = field(default_factory=lambda: f"line_runs_{uuid.uuid4().hex}")
    made: int = 0

    def known(self) -> DataFrame | None:
        tables = [self.spark.table(run) for level in self.levels for run in level]
        return reduce(DataFrame.union, tables) if tables else None

    def unknown(self, keys: DataFrame) -> DataFrame:
        """Rows of dealt ``keys`` that no run holds: one merge with each run."""
        for level in self.levels:
            for run in level:
                keys = keys.join(self.spark.table(run), HASH, "left_anti")
        return keys

    def deal(self, keys: DataFrame) -> DataFrame:
        """``keys`` of several batches as one table, a folder per batch, in the buckets of the runs."""
        name = f"{self.name}_keys"
        dealt = keys.repartition(self.buckets, *HASH).write.partitionBy("batch").bucketBy(self.buckets, *HASH)
        dealt.sortBy(*HASH).saveAsTable(name)
        return self.spark.table(name)

    @staticmethod
    def _merge(left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one, bucket by bucket; they share no keys."""
        both = left.join(right.withColumnRenamed("first", "other"), HASH, "full_outer")
        return both.select(*HASH, F.coalesce("first", "other").alias("first"))

    def _write(self, rows: DataFrame) -> str:
        run = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(run)
        return run

    def add(self, rows: DataFrame) -> None:
        """Add ``h1, h2, first`` rows of unknown keys as a run of the lowest level; compact full levels."""
        run, depth = self._write(rows), 0
        while True:
            if depth == len(self.levels):
                self.levels.append([])
            self.levels[depth].append(run)
            if len(self.levels[depth]) < self.fanout:
                return
            old = self.levels[depth]
            run = self._write(reduce(self._merge, [self.spark.table(t) for t in old]))
            self.levels[depth] = []
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            depth += 1

    def drop(self) -> None:
        for run in [run for level in self.levels for run in level] + [f"{self.name}_keys"]:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.levels = []


def batch_of(ids: DataFrame, batches: int) -> list[int]:
    """Upper bounds of all batches but the last, so that ids rise from batch to batch."""
    cuts = ids.approxQuantile("_id", [n / batches for n in range(1, batches)], 0.01)
    return sorted({int(c) for c in cuts})


def dropped_lines(docs: DataFrame, runs: LineRuns, batches: int = BATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _row, drop``: for each row that loses lines the sorted positions (from 0) of those lines.

    Keys come to the runs in batches of rising ids, so the id that a run holds for a key is the
    smallest of all. Keys are counted before they are dealt into buckets; after that no batch and
    no run is shuffled again. At the end the lines meet the runs in one join, in which AQE splits
    what a common line makes large.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("_id"), whole.alias("_text"))
    cuts = batch_of(ids, batches)
    batch = reduce(lambda a, b: a + b, [(F.col("_id") > c).cast("int") for c in cuts], F.lit(0))
    lines = stage(
        ids.select("_id", F.xxhash64("_id", "_text").alias("_row"), F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
        .withColumn("line", line_key(F.col("line")))
        .where(F.length("line") >= LEAST_LENGTH)
        .select(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "_id", "_row", "pos"),
        "lines",
    )
    keys = lines.groupBy(batch.alias("batch"), *HASH).agg(F.min("_id").alias("first"))
    dealt = runs.deal(keys)
    for n in range(len(cuts) + 1):
        runs.add(runs.unknown(dealt.where(F.col("batch") == n).drop("batch")))
    later = lines.join(runs.known(), HASH).where(F.col("first") < F.col("_id"))
    return later.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def kept_lines(lines: Column, drop: Column) -> Column:
    """The lines whose positions are not in the sorted ``drop``: slices between them, so linear in the lines."""
    ends = F.concat(drop, F.array(F.size(lines)))
    pieces = F.transform(
        ends,
        lambda end, n: F.slice(
            lines,
            F.when(n == 0, 1).otherwise(F.get(ends, n - 1) + 2).cast("int"),
            (end - F.when(n == 0, 0).otherwise(F.get(ends, n - 1) + 1)).cast("int"),
        ),
    )
    return F.flatten(pieces)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated lines, and ``_n_lines`` and ``_n_dropped``.

    Extra columns come out as they went in; where one has the name of a count, the count's has underscores added.

    A line's key has no blanks at its ends and A to Z in lower case. A key of at least 10 code
    points that documents of several ids hold keeps its lines in the smallest id only, there all of
    them. A null or empty text is one empty line. Rows that share an id count as one document; rows
    without id count as one document after all others. An empty table stays empty.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        drops = stage(dropped_lines(docs, runs, batches, key, text), "line-drops")
    finally:
        runs.drop()
    own = docs.select(packed_row(docs, "_all"), F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("_id"))
    whole = F.coalesce(F.col("_all")[text], F.lit(""))
    own = own.withColumn("_row", F.xxhash64("_id", whole))
    joined = own.join(drops, ["_id", "_row"], "left")
    counted = joined.withColumn("_lines", F.split(whole, "\n"))
    kept = F.when(F.col("drop").isNull(), whole).otherwise(F.array_join(kept_lines(F.col("_lines"), F.col("drop")), "\n"))
    return counted.select(
        *[kept.alias(c) if c == text else F.col("_all")[c].alias(c) for c in docs.columns],
        F.size("_lines").cast("long").alias(free_name(docs, "_n_lines")),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(free_name(docs, "_n_dropped")),
    )


@query(
    "op10_line_dedup",
    """
    WITH l AS (
      SELECT doc_id, row, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
      FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
    k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
    f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
    r AS (
      SELECT k.doc_id, k.row, k.pos, k.line, coalesce(f.first < k.doc_id, false) AS dropped
      FROM k LEFT JOIN f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM r GROUP BY doc_id, row
    """,
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
