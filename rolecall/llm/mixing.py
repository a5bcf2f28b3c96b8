"""Operator 2, mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm.common import packed_row, stage, table
from rolecall.llm.registry import query
from rolecall.operators.numbering import number_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Leading hex digits of the seeded hash that make up a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def words(text: str | Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, vertical tab, form feed and return; null: 0."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def seeded(key: str, seed: str = SEED) -> Column:
    """The place of a document in its source's seeded order; a null key counts as the empty string."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows ``(source_size, weight)``.

    Each round gives every unclamped source its weight's part of what the clamped ones leave and
    clamps those above ``max_epochs`` times their size. The level only rises, so the rounds end; a
    round is one distributed sum of which the driver sees one row.
    """
    size, weight, cap = F.col("source_size"), F.col("weight"), F.col("source_size") * F.lit(float(max_epochs))
    total, weights = sources.agg(F.sum(size), F.sum(weight)).first()
    wanted = (total or 0) * share
    level = wanted / weights if weights else 0.0
    while True:
        clamped = cap <= F.lit(level) * weight
        used, free = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0).otherwise(weight))
        ).first()
        risen = max(level, (wanted - used) / free) if free else level
        if risen == level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * weight))
        level = risen


def mix_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """``(sizes, sources)``: ``doc_id, source, size, place`` of each row; and of each source what the mix takes.

    A source is taken ``whole`` times in full and once more as far as ``last_place`` in the seeded
    order, the place whose middle word is the last one inside the target. So what is taken is off
    the target by half of one document at most. A null source is a source of its own, last in
    order; rows that share a key are taken alike.
    """
    sizes = stage(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            words(text).cast("long").alias("size"),
            seeded(key, seed).alias("place"),
        ),
        "mix-sizes",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(totals, [F.col("source").asc_nulls_last()], "source_rank")
    nth = F.pmod(F.col("source_rank") - 1, F.lit(len(weights))).cast("int")
    weighed = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), nth))
    filled = water_fill(weighed, share, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    filled = stage(filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")

    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    by_place = (
        sizes.alias("d").join(filled.alias("s"), same)
        .groupBy("s.source_rank", "s.rest", "d.place").agg(F.sum("d.size").alias("size"))
        .withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    )
    by_bucket = by_place.groupBy("source_rank", "rest", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    # only the buckets in which the rest may end need their documents one by one
    near = starts.where("start <= rest").drop("rest")
    inside = Window.partitionBy("source_rank", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    last = (
        by_place.join(near, ["source_rank", "bucket"])
        .withColumn("middle", middle)
        .where("middle <= rest")
        .groupBy("source_rank").agg(F.max("place").alias("last_place"))
    )
    sources = filled.join(last, "source_rank", "left")
    return sizes, stage(sources, "mix-plan")


def copies(whole: Column, place: Column, last_place: Column) -> Column:
    return (whole + F.when(place <= last_place, 1).otherwise(0)).cast("int")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of each row."""
    sizes, sources = mix_plan(docs, **options)
    times = copies(F.col("s.whole"), F.col("d.place"), F.col("s.last_place"))
    return sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.size", "s.source_size", "s.target", (F.col("d.size") * times).alias("taken"), times.alias("copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all its columns, as often as the mix takes it.

    The texts meet only the small table of sources. An empty table stays empty.
    """
    _, sources = mix_plan(docs, key=key, source=source, **options)
    plan = sources.select(F.col("source").alias("_source"), "whole", "last_place")
    place = seeded(key, options.get("seed", SEED))
    rows = docs.select(packed_row(docs), F.col(source).alias("_of"), place.alias("_place"))
    joined = rows.join(plan, F.col("_of").eqNullSafe(F.col("_source")))
    times = copies(F.col("whole"), F.col("_place"), F.col("last_place"))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_row.*")


@query(
    "op2_mixing",
    """
    WITH d AS (
      SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
      FROM documents),
    s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
      FROM d GROUP BY source),
    -- the level at which the sources that run out first are clamped
    c AS (
      SELECT *, 2.0 * source_size / weight AS ratio,
             (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER less, 0.0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER less, 0)) AS level
      FROM s WINDOW less AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT min_by(level, ratio) FILTER (level <= ratio) AS level FROM c),
    t AS (
      SELECT source, source_size, least(2.0 * source_size, level * weight) AS target,
             CASE WHEN source_size > 0 THEN floor(least(2.0 * source_size, level * weight) / source_size) ELSE 0 END AS whole
      FROM s, l),
    m AS (
      SELECT source, place, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) - sum(size) / 2 AS middle
      FROM d GROUP BY source, place),
    e AS (
      SELECT m.source, max(place) AS last_place FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source
      WHERE middle <= target - whole * source_size GROUP BY m.source)
    SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target,
           CAST(d.size * (whole + CASE WHEN place <= last_place THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
    """,
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("copies")
