"""What several corpus operators share: staged tables, worker caches, dense places, components."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.session import cut_lineage, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def conf_set(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_end(spark: SparkSession):
    """Queries started inside give up their shuffle files as soon as they end, not when the driver collects garbage.

    For results that are written and read back: nothing asks for those files again, and a lost executor
    is made good for within the query as ever.
    """
    return conf_set(spark, CLEANUP_CONF, "true")


def batches_of(spark: SparkSession, rows: int):
    """Queries started inside hand texts to Python so many rows at a time, at most: a batch lies in memory twice, as
    Spark writes it and as Python reads it."""
    now = int(spark.conf.get(BATCH_CONF))
    return conf_set(spark, BATCH_CONF, now if 0 < now < rows else rows)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that leaves no shuffle files behind."""
    with shuffles_end(df.sparkSession):
        return cut_lineage(df)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write once below the shared folder and read back, so that later passes do not repeat the work."""
    path = shared_path(df.sparkSession, purpose)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Staged tables of one job by name; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, purpose: str) -> DataFrame:
        path = self.paths[purpose] = shared_path(self.spark, purpose)
        with shuffles_end(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *purposes: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for purpose in purposes:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(purpose))
            path.getFileSystem(conf).delete(path, True)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of this package; tasks call what is returned. Its classes travel by value, so that the
    workers need no package."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def packed_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns as one, so that no name of theirs can meet a name of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


#: Bits of a sieve for each id, and at most: 16 MB, however many ids there are.
SIEVE_BITS, MOST_SIEVE_BITS = 16, 1 << 27


def sift(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false where ``key`` is surely none of ``ids``, a table of one staged column.

    For bulky rows of which few are looked for: only those that may be meant need to travel to an exact join.
    A bitmap of hashes of the ids goes to all tasks; about one in 16 other rows passes, and more do beyond
    8 million ids, where the bitmap stays as large as it is.
    """
    bits = min(MOST_SIEVE_BITS, max(1 << 16, SIEVE_BITS * ids.count()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits)) + 1
    marks = ids.select(place(ids.columns[0]).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_part"))
    sieve = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    placed = rows.withColumn("_at", place(key)).withColumn("_part", F.bitmap_bucket_number("_at"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(sieve), "_part", "left").select(*[F.col(f"`{c}`") for c in rows.columns], may.alias("_may"))


def give_back() -> None:
    """Memory that this process has freed goes back to the system: idle Python workers count as their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):  # of the GNU C library
        library.malloc_trim(0)


def keep_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker builds once and keeps for its later tasks, until one of another name comes."""
    shelf = sys.modules.setdefault("_rolecall_worker", types.ModuleType("_rolecall_worker"))
    if getattr(shelf, "name", None) != name:
        shelf.name, shelf.value = name, None  # the old one goes before the new one is built
        give_back()
        shelf.value = make()
    return shelf.value


def places(
    df: DataFrame, group: list[str], bucket: Column, buckets: int, order_by: list[Column | str], name: str
) -> DataFrame:
    """Dense places from 0 within each group, also where one group holds most rows.

    Rows of a group are dealt over ``buckets`` by a hash; a bucket starts where the counts of the
    buckets before it end. Only ``buckets`` counts of a group ever meet in one task.
    """
    dealt = df.withColumn("_bucket", F.pmod(bucket, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order_by)
    numbered = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    on = [numbered[c].eqNullSafe(starts[c]) for c in [*group, "_bucket"]]
    joined = numbered.join(starts, on, "inner").select(
        *[numbered[c] for c in df.columns], (F.col("_start") + F.col("_inside")).cast("long").alias(name)
    )
    return joined


def components(links: DataFrame) -> DataFrame:
    """Smallest member of each connected component: rows ``(id, class_id)`` for every linked id.

    ``links`` has ids ``a`` and ``b``. Alternates the two star operations on links until nothing
    changes; each round is a minimum per id, aggregated before its shuffle, and one join. The links of a
    round go as soon as those of the next are written.
    """
    staged, turn = Stages(links.sparkSession), 0
    edges = staged(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                   .where("hi <> lo").distinct(), "links-0")
    state = None
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        ).select("e.*").where("hi <> lo").distinct()
        edges, turn = staged(small, f"links-{turn + 1}"), turn + 1
        staged.drop(f"links-{turn - 1}")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if tuple(new) == state:
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("class_id")).union(
                edges.select("lo", "lo").distinct()
            )
        state = tuple(new)
