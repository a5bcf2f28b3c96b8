"""The store of URLs seen so far: bucketed by their hash, so that a micro-batch meets it without moving it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.session import cut_lineage

BUCKETS = 64


@dataclass(frozen=True)
class SeenUrls:
    """Rows ``url, url_hash`` by ``load_id`` and bucket of the hash, as Parquet below ``path``.

    The files say which bucket they are, so any session can open the folder again; ``buckets`` must be what the
    folder was made with. A micro-batch is shuffled to the buckets and looked up there: the stored side is read
    bucket by bucket where it lies, with no exchange and no sort, however long it or the batch is.
    """

    path: str
    buckets: int = BUCKETS

    def open(self, spark: SparkSession) -> str:
        """Name of the table over the folder, made known to this session."""
        name = f"seen_{hashlib.sha256(f'{self.path} {self.buckets}'.encode()).hexdigest()[:24]}"
        spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {name} (url STRING, url_hash STRING, load_id BIGINT) USING parquet
            PARTITIONED BY (load_id) CLUSTERED BY (url_hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"""
        )
        spark.catalog.refreshTable(name)  # folders that another session wrote
        return name

    def unseen(self, batch: DataFrame, before: int) -> DataFrame:
        """Rows of ``batch`` whose ``url_hash`` no load before the given one has."""
        stored = batch.sparkSession.table(self.open(batch.sparkSession)).where(F.col("load_id") < before)
        wanted = batch.select("url_hash").hint("shuffle_hash")
        known = stored.select("url_hash").join(wanted, "url_hash", "left_semi")
        return batch.join(known, "url_hash", "left_anti")

    def remember(self, rows: DataFrame, load_id: int) -> None:
        """Write one load, one file a bucket; a replay writes it again."""
        spark = rows.sparkSession
        name = self.open(spark)
        fresh = cut_lineage(rows.select("url", "url_hash"))  # they were found by reading the table
        fresh.repartition(self.buckets, "url_hash").createOrReplaceTempView(f"{name}_fresh")
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (load_id = {int(load_id)}) SELECT url, url_hash FROM {name}_fresh")
        spark.catalog.dropTempView(f"{name}_fresh")
