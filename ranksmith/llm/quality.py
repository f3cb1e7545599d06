"""Quality classifier by compression: one zstandard dictionary per class, calibrated on normalised size differences.

A text that resembles good prose is shortened more by the dictionary built from good text, one
that resembles junk by the other.  For each dictionary, the text's size less its compressed size,
over the text's size, is an input of a logistic calibration; their difference tells the classes apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, labelled_sample, logistic, new_name, table

#: Bound of the training sample: rows for each class; their texts are read whole.
TRAIN_ROWS = 1500
#: Texts are compressed in chunks that a dictionary still matters for.
DICT_BYTES, CHUNK_BYTES, LEVEL = 64 * 1024, 1024, 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    intercept: float


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; where there is too little text to train one, the text itself serves as raw content."""
    import zstandard

    parts = [t[i : i + CHUNK_BYTES] for t in texts for i in range(0, len(t), CHUNK_BYTES)]
    total = sum(map(len, parts))
    if len(parts) >= 16 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[-size:]


def _compressor(raw: bytes):
    import zstandard

    if len(raw) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def size_differences(text: bytes, good, bad) -> tuple[float, float]:
    """100 * (bytes of the text - bytes compressed) / bytes of the text, with the good and the bad dictionary, over all chunks of the whole text; 0 for an empty one."""
    if not text:
        return 0.0, 0.0
    g = b = 0
    for i in range(0, len(text), CHUNK_BYTES):
        part = text[i : i + CHUNK_BYTES]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    n = len(text)
    return 100 * (n - g) / n, 100 * (n - b) / n


def calibrate(x, y, weight) -> tuple[tuple[float, float], float]:
    """Slopes and intercept: what the good dictionary saves may only raise a score and what the bad one saves only lower it.

    An input whose slope comes out with the other sign leaves, and the rest is fitted again.
    """
    used = [0, 1]
    while True:
        fitted = logistic(x[:, used], y, weight)
        wrong = [j for j, slope in zip(used, fitted[:-1], strict=True) if slope * (1, -1)[j] < 0]
        if not wrong:
            slopes = dict(zip(used, map(float, fitted[:-1]), strict=True))
            return (slopes.get(0, 0.0), slopes.get(1, 0.0)), float(fitted[-1])
        used = [j for j in used if j not in wrong]


def train(sample: list[tuple[int, str]], totals: dict[int, int]) -> QualityModel:
    """Two thirds of the sample build the dictionaries, the rest calibrates; class totals restore the prior.

    With one class (or none) in the labels, every text gets that class's share (or 0.5).
    """
    import numpy as np

    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    by = {y: [t.encode() for z, t in sample if z == y and t] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 3:
        return QualityModel(b"", b"", (0.0, 0.0), prior if n0 + n1 else 0.0)
    fit = {y: [t for i, t in enumerate(v) if i % 3] for y, v in by.items()}
    held = {y: v[::3] for y, v in by.items()}
    good, bad = build_dictionary(fit[1]), build_dictionary(fit[0])
    cg, cb = _compressor(good), _compressor(bad)
    x = np.array([size_differences(t, cg, cb) for y in (0, 1) for t in held[y]])
    y = np.array([float(k) for k in (0, 1) for _ in held[k]])
    weight = np.where(y == 1, n1 / max(1, len(held[1])), n0 / max(1, len(held[0])))
    slopes, intercept = calibrate(x, y, weight * len(y) / weight.sum())
    return QualityModel(good, bad, slopes, intercept)


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts get the calibrated value of no difference."""

    @F.pandas_udf(T.DoubleType())
    def score(s):
        import numpy as np
        import pandas as pd

        good, bad = _compressor(model.good), _compressor(model.bad)
        x = np.array([size_differences((t or "").encode("utf-8", "surrogatepass"), good, bad) for t in s], dtype=float).reshape(-1, 2)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(model.slopes) + model.intercept, -30, 30))))

    return score(text)


def fit_quality(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows_per_class: int = TRAIN_ROWS) -> QualityModel:
    allowed = fold(F.col("doc_id"), 3) != 1 if allowed is None else allowed
    return train(*labelled_sample(docs, labels, "quality", allowed, rows_per_class))


def score_quality(docs: DataFrame, labels: DataFrame, out: str = "quality_score", **bounds) -> DataFrame:
    """All rows and columns of ``docs`` plus the score in column ``out``, which must be new.

    Duplicates and null ids are scored like any other row, null and empty texts as no difference; whole texts of any
    length are read; an empty table gives an empty result; without labels every score is 0.5.
    """
    return docs.withColumn(new_name(docs, out), quality_score(F.col("text"), fit_quality(docs, labels, **bounds)))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of no difference, null ids are not held out, repeated rows and ties get equal
    scores, very long texts are read whole, an empty table gives no rows, and other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
