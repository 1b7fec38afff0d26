"""Session helpers: table loading, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "veinwork", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VEINWORK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; a table is a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only in a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veinwork-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    A checkpointed table keeps the size estimate of its plan, and those of joins multiply:
    over the rounds of a loop the estimate itself becomes a number of millions of digits.
    The rows are therefore taken up again as a table without a past.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def bounded(df: DataFrame, limit: int) -> tuple[bool, list]:
    """Rows of df if there are at most limit of them, else (False, [])."""
    rows = df.limit(limit + 1).collect()
    return (len(rows) <= limit), (rows if len(rows) <= limit else [])


def broadcast_if_small(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """Broadcast hint only after counting at most limit rows; a plain shuffle join otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores for a stage of heavy per-row work.

    Only inputs with fewer partitions than cores (small files) are moved; large inputs
    stay where they were read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle before heavy work in Python, where few bytes mean much time."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
