"""Session settings that the library's plans assume, and table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "ranksmith", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything given in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that the session names; a local master gets one of its own where none is set, a cluster must name one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to all cores, two tasks to each: for plans that work long on each row of a table that has few files."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows of whole documents that cross to a Python worker at a time, where the session leaves Spark's default.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows for each Arrow batch than Spark's 10,000: whole documents are long, and a worker holds several copies of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
