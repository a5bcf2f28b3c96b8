"""Session set-up and the shared folder that checkpoints and staged tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rolecall") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if context.getCheckpointDir() is None:
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="rolecall-")
        context.setCheckpointDir(root)
    return (root or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, unused folder name below the shared root."""
    return f"{shared_root(spark)}/rolecall/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never changes row placement."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
