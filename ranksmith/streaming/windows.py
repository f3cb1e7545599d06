"""Event-time windows, token budgets and state, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(df: DataFrame, column: str = "ts", late: str | None = None) -> DataFrame:
    """Zone-less times become timestamps; ``late`` sets the watermark of a stream."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late and df.isStreaming else out


def tumbling(df: DataFrame, column: str, width: str, *by: str) -> DataFrame:
    g = df.groupBy(F.window(column, width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, column: str, width: str, step: str, *by: str) -> DataFrame:
    g = df.groupBy(F.window(column, width, step), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, column: str, gap: str, *by: str) -> DataFrame:
    g = df.groupBy(F.session_window(column, gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def token_budget(df: DataFrame, key: str, column: str, cost: str, tie: str, limit: float, margin: float = 0.1, seconds: int = 60) -> DataFrame:
    """Cost of the last ``seconds`` up to and with each row of a key, and whether it stays within limit * (1 - margin)."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(column).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("used", F.sum(cost).over(w)).withColumn("admitted", F.col("used") <= limit * (1 - margin))


STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("n", T.LongType())])
#: Order of the stages; a status never moves back.
STAGE_ORDER = ("view", "click", "signup", "purchase")


def furthest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Stream: the furthest stage that each key has reached and its number of events, updated with every batch."""

    def step(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        best, n = state.get if state.exists else (None, 0)
        rank = {s: i for i, s in enumerate(STAGE_ORDER)}
        at = rank.get(best, -1)
        for pdf in batches:
            n += len(pdf)
            at = max([at, *(rank.get(s, -1) for s in pdf["event_type"])])
        best = STAGE_ORDER[at] if at >= 0 else None
        state.update((best, n))
        yield pd.DataFrame({key: [k[0]], "status": [best], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, status string, n long", STATE, "update", "NoTimeout")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], checkpoint: str, version: str = "batch", newest: str | None = None):
    """Keeps one row of each key in a folder of versions: each batch writes the merged table anew and then names it current.

    Of a batch's rows of one key the one with the greatest ``newest`` column stays; without that column any of them.
    """
    from ranksmith.operators.mutations import upsert

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if newest:
            new = batch.groupBy(*keys).agg(F.max_by(F.struct("*"), newest).alias("_row")).select("_row.*")
        if batch_id:
            new = upsert(spark.read.parquet(f"{target}/{version}={batch_id - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{target}/{version}={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def upsert_partitioned(stream: DataFrame, target: str, keys: list[str], newest: str, checkpoint: str, buckets: int = 64, prepare=None, trigger: dict | None = None):
    """Keeps the newest row of each key in a table of ``buckets`` partitions, of which a batch rewrites only those it touches.

    ``newest`` decides, then all other columns, so a batch that is run again after a failure changes nothing and late rows never
    replace newer ones.  ``prepare`` may join or clean each batch first.  ``trigger`` is one of writeStream's, such as
    ``{"processingTime": "15 minutes"}`` for polling; without it what is there is taken and the query ends.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = prepare(batch) if prepare else batch
        new = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        staged = f"{target}/_staged"
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        known = spark.read.schema(new.schema).option("basePath", f"{target}/rows")
        paths = [f"{target}/rows/bucket={b}" for b in touched]
        there = [p for p in paths if _has_rows(spark, p)]
        both = new.unionByName(known.parquet(*there)) if there else new
        order = F.struct(newest, *[c for c in new.columns if c not in (newest, "bucket")])
        kept = both.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
        kept.write.mode("overwrite").parquet(staged)
        # the target is read above, so the merged rows are set down before any partition is replaced
        spark.read.schema(kept.schema).parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{target}/rows")

    out = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True}))


def _has_rows(spark, path: str) -> bool:
    """Whether a partition's folder exists; Spark has no other way to ask a store than to list it."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False
