"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.session import small_batches

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.  Where none is set a local master gets one of its own; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than a checkpoint, and its size is known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: decides which labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def new_name(df: DataFrame, name: str) -> str:
    """``name``, if no column of ``df`` has it; an operator never replaces a column of its input."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the input already has a column {name}: ask for another name")
    return name


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as make it new to ``df``: for columns that leave again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows without an id come last.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns that order its documents, and their names: the id, null last, and a tie-break.

    The tie-break is 0 where an id has one text only.  Rows without an id, and rows of an id that several texts share, are told
    apart by a 64-bit hash of the text, so only rows that are equal in both are one document.
    """
    doc, tie = free_name(docs, "doc"), free_name(docs, "tie")
    digest, known = F.xxhash64(F.col("text").cast("binary")), F.col("doc_id").isNotNull()
    out = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    ids = docs.where(known).groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b")
    shared = stored(ids.select(F.col("doc_id").cast("long").alias(tie)))
    if shared.limit(1).count():
        clash = free_name(docs, "clash")
        out = out.join(shared.withColumnRenamed(tie, clash), F.col(doc) == F.col(clash), "left")
        return out.withColumn(tie, F.when(known & F.col(clash).isNull(), 0).otherwise(digest)).drop(clash), doc, tie
    return out.withColumn(tie, F.when(known, F.lit(0).cast("long")).otherwise(digest)), doc, tie


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows_per_class: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """At most ``rows_per_class`` labelled whole texts of each class, chosen by a hash of the id, plus the class totals.

    The only rows that reach the driver: 2 * rows_per_class texts, of a repeated id the least one.  The id list is
    therefore also small enough to broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {int(r.y): int(r.n) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(*order).limit(rows_per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r.y, r.text) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))], totals


def logistic(x, y, weight, ridge: float = 1e-2, steps: int = 40):
    """Newton steps for a ridge logistic regression; the last coefficient is the intercept."""
    import numpy as np

    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + penalty * w
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
