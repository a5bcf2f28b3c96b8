"""The store of landed pages, laid out so that a micro-batch of URLs reads little more than its own pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.operators.joins import is_small
from rolecall.sources.readers import read_if_present

PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("landed", T.TimestampType()),
        T.StructField("day", T.DateType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
LATEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("file", T.StringType()),
        T.StructField("row", T.LongType()),
    ]
)
BUCKETS = 256


@dataclass(frozen=True)
class PageStore:
    """Pages ``url, html, landed`` as Parquet by landing ``day`` and ``bucket`` of the URL's hash.

    ``buckets`` must be what the folder was made with. The latest page of a URL is found on keys alone: URLs and
    times of the buckets asked for. Only then are texts read, of the days and buckets that hold a latest page.
    """

    path: str
    buckets: int = BUCKETS

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def land(self, pages: DataFrame) -> None:
        """Add pages; rows without a URL or a time of landing stay out. Files are sorted and filtered by URL."""
        usable = pages.where(F.col("url").isNotNull() & F.col("landed").isNotNull())
        laid_out = usable.select("url", "html", "landed", F.to_date("landed").alias("day"), self.bucket(F.col("url")).alias("bucket"))
        spread = laid_out.repartition("day", "bucket").sortWithinPartitions("day", "bucket", "url")
        writer = spread.write.mode("append").option("parquet.bloom.filter.enabled#url", "true")
        writer.partitionBy("day", "bucket").parquet(self.path)

    def _read(self, spark: SparkSession) -> DataFrame:
        return read_if_present(spark, self.path, PAGE)

    def latest(self, urls: DataFrame) -> DataFrame:
        """``url, day, file, row`` of the latest page of each of the distinct ``urls`` that landed; of equal times the last in the store.

        The buckets asked for, at most ``buckets`` numbers, become a partition filter; no text is read.
        """
        spark = urls.sparkSession
        asked = [r[0] for r in urls.select(self.bucket(F.col("url"))).distinct().collect()]
        stored = self._read(spark)
        if not asked or stored.isEmpty():
            return spark.createDataFrame([], LATEST)
        pages = stored.where(F.col("bucket").isin(asked))
        keys = pages.select("url", "landed", "day", "_metadata.file_path", "_metadata.row_index")
        wanted = F.broadcast(urls.select("url")) if is_small(urls) else urls.select("url")
        at = F.struct("landed", "file_path", "row_index", "day").alias("_at")
        best = keys.select("url", at).join(wanted, "url", "left_semi").groupBy("url").agg(F.max("_at").alias("_at"))
        return best.select("url", "_at.day", F.col("_at.file_path").alias("file"), F.col("_at.row_index").alias("row"))

    def fetch(self, latest: DataFrame) -> DataFrame:
        """``url, html`` of rows of ``latest``, read from a written table. Days and buckets that hold none are not listed."""
        spark = latest.sparkSession
        bounds = latest.agg(F.collect_set("day"), F.collect_set(self.bucket(F.col("url")))).first()  # days and buckets, not rows
        pages = self._read(spark).where(F.col("day").isin(bounds[0]) & F.col("bucket").isin(bounds[1]))
        if not bounds[0]:
            return pages.select("url", "html")
        placed = pages.select("url", "html", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        wanted = F.broadcast(latest.drop("day")) if is_small(latest) else latest.drop("day")
        return placed.join(wanted, ["url", "file", "row"], "left_semi").select("url", "html")
