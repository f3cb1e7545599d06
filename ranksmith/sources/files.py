"""Files as tables: validation, hashing, parsing by type, and partner payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted types by extension, their first bytes, and the limits of a batch.
TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
}
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}
MAX_FILE_BYTES, MAX_BATCH_FILES, MAX_BATCH_BYTES = 10 * 1024 * 1024, 50, 100 * 1024 * 1024


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, content, extension, mime and SHA-256 of the files under ``root``; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return files.withColumn("extension", ext).withColumn("mime", F.try_element_at(mime, F.col("extension"))).withColumn("file_hash", F.sha2("content", 256))


def inside(path: Column, root: str) -> Column:
    """Whether a path lies under ``root`` once its dots are followed; relative paths do not."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "")
    steps = F.filter(F.split(bare(path), "/"), lambda x: (x != "") & (x != "."))
    # a step up takes the last one away; one that leaves the top is kept and fits no root
    followed = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    top = [x for x in root.split("://")[-1].split("/") if x and x != "."]
    return F.coalesce(bare(path).startswith("/") & (F.size(followed) > len(top)) & (F.slice(followed, 1, max(1, len(top))) == F.array(*map(F.lit, top))), F.lit(False))


STORED = "path string, file_hash string, stored_path string, size long, error string"
CHUNK_BYTES = 1 << 20


def store_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each file's content under ``root`` by its SHA-256 and returns path, file_hash, stored_path, size and error.

    Executors write, to a folder that all of them share.  Equal contents share one file, so repeats and retried tasks write nothing
    new; a file appears under its name only when it is whole.  A null content has an error and no path.
    """

    def write(batches):
        import hashlib
        import os
        import uuid

        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if content is None:
                    out.append((path, None, None, None, "no content"))
                    continue
                view, digest = memoryview(content), hashlib.sha256()
                for i in range(0, len(view), CHUNK_BYTES):
                    digest.update(view[i : i + CHUNK_BYTES])
                name = digest.hexdigest()
                suffix = os.path.splitext(path or "")[1].lower()
                target = os.path.join(root, name[:2], name + (suffix if suffix[1:].isalnum() else ""))
                error = None
                try:
                    if not os.path.exists(target):
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        part = f"{target}.{uuid.uuid4().hex}.part"
                        with open(part, "wb") as f:
                            for i in range(0, len(view), CHUNK_BYTES):
                                f.write(view[i : i + CHUNK_BYTES])
                        os.replace(part, target)
                except OSError as e:
                    target, error = None, f"{type(e).__name__}: {e}"
                out.append((path, name, target, len(view), error))
            yield pd.DataFrame(out, columns=["path", "file_hash", "stored_path", "size", "error"])

    return files.select("path", "content").mapInPandas(write, STORED)


def read_stored(spark: SparkSession, stored: DataFrame, root: str, column: str = "stored_path") -> DataFrame:
    """``stored`` with ``content``, and ``error`` where the path lies outside ``root`` or no file is there; executors read."""
    safe = stored.withColumn("_inside", inside(F.col(column), root))

    @F.pandas_udf("content binary, error string")
    def load(paths, allowed):
        import os

        import pandas as pd

        out = []
        for path, ok in zip(paths, allowed, strict=True):
            if not ok or not os.path.realpath(path).startswith(os.path.realpath(root) + os.sep):
                out.append((None, "path is outside the storage root"))
            elif not os.path.isfile(path):
                out.append((None, "no such file"))
            else:
                with open(path, "rb") as f:
                    out.append((f.read(), None))
        return pd.DataFrame(out, columns=["content", "error"])

    names = [c for c in stored.columns if c not in ("content", "error")]
    return safe.withColumn("_read", load(F.col(column), F.col("_inside"))).select(*names, "_read.content", "_read.error")


def validation_error(extension: Column, length: Column, content: Column) -> Column:
    """First rule that a file breaks, or null."""
    signature = F.lit(True)
    for ext, magic in MAGIC.items():
        signature = F.when(extension == ext, F.substring(content, 1, len(magic)) == F.lit(magic)).otherwise(signature)
    return (
        F.when(~extension.isin(*TYPES), "unsupported type")
        .when(length == 0, "empty file")
        .when(length > MAX_FILE_BYTES, "file too large")
        .when(~signature, "content does not match type")
    )


def validated(files: DataFrame) -> DataFrame:
    return files.withColumn("error", validation_error(F.col("extension"), F.col("length"), F.col("content")))


def batch_error(files: DataFrame) -> DataFrame:
    """One row: number of files, bytes, and the batch rule that they break, if any."""
    n, size = F.col("n_files"), F.col("n_bytes")
    total = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    return total.withColumn("error", F.when(n == 0, "no files").when(n > MAX_BATCH_FILES, "too many files").when(size > MAX_BATCH_BYTES, "batch too large"))


PARSED = T.StructType([T.StructField(n, t) for n, t in (("text", T.StringType()), ("page_count", T.IntegerType()), ("engine", T.StringType()), ("error", T.StringType()))])


def _parse_txt(content: bytes) -> tuple[str, int]:
    return content.decode("utf-8"), 1


def _parse_docx(content: bytes) -> tuple[str, int]:
    """Paragraphs, then table rows with cells joined by bars; a cell repeated by merging counts once."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [said(p) for p in body.findall(f"{w}p")]
    for row in body.iter(f"{w}tr"):
        cells = [said(c).strip() for c in row.findall(f"{w}tc")]
        lines.append(" | ".join(c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])))
    return "\n".join(x for x in lines if x.strip()), 1


#: Parsers by type; callers may add theirs (a PDF library, an OCR engine).
PARSERS = {TYPES["txt"]: ("text", _parse_txt), TYPES["docx"]: ("docx-xml", _parse_docx)}


def register_parser(mime: str, engine: str, parse) -> None:
    PARSERS[mime] = (engine, parse)


def parsed(files: DataFrame) -> DataFrame:
    """Adds ``parsed`` = struct<text, page_count, engine, error>; a file that cannot be read keeps its row and says why."""
    parsers = dict(PARSERS)

    @F.pandas_udf(PARSED)
    def run(mimes, contents):
        import pandas as pd

        out = []
        for m, c in zip(mimes, contents, strict=True):
            if m not in parsers:
                out.append((None, None, None, f"no parser for {m}"))
                continue
            engine, parse = parsers[m]
            try:
                text, pages = parse(bytes(c))
                out.append((text, pages, engine, None))
            except Exception as e:  # noqa: BLE001  a bad file must not end the batch
                out.append((None, None, engine, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=PARSED.fieldNames())

    return files.withColumn("parsed", run(F.col("mime"), F.col("content")))


def split_by_error(files: DataFrame, column: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, bad)"""
    return files.where(F.col(column).isNull()), files.where(F.col(column).isNotNull())


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def status_payload(raw: DataFrame, json: str = "payload") -> DataFrame:
    """Partner statuses: several spellings of the score, fractions scaled, states in capitals, roll-up flags."""
    from ranksmith.functions.scoring import rescale_fraction
    from ranksmith.operators.extraction import first_spelling

    score = first_spelling(F.col(json), ["$.composite_score", "$.compositescore", "$.compositeScore", "$.score"]).cast("double")
    status = F.upper(F.get_json_object(json, "$.status"))
    out = raw.withColumn("composite_score", rescale_fraction(score)).withColumn("status", status)
    return out.withColumn("is_submitted", F.coalesce(status.isin("SUBMITTED", "GRADED"), F.lit(False))).withColumn("is_graded", F.coalesce(status == "GRADED", F.lit(False)))


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    """Name, type and nullability of a catalogue table's columns."""
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "name string, type string, nullable boolean")
