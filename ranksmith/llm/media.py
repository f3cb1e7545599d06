"""Media columns by signature: find magic bytes, confirm them by structure, correct declared types, carve what is embedded.

An Aho-Corasick automaton locates every known signature of a blob in one pass.
A hit is only a suspicion: a validator of that format has to walk its headers or
chunks and report the exact length before the hit counts.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

UNKNOWN = "application/octet-stream"
#: Payloads are padded to a positive multiple of this many bytes with this byte.
UNIT, PAD = 576, 255
SAMPLE_RATE = 8000

# The signatures that public format descriptions name.
SIGNATURES = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
    b"PK\x03\x04": "application/zip",
    b"%PDF-": "application/pdf",
    b"\x1f\x8b\x08": "application/gzip",
    b"II*\x00": "image/tiff",
    b"MM\x00*": "image/tiff",
}


@dataclass(frozen=True)
class Segment:
    mime: str
    start: int
    length: int


class Blob(bytes):
    """A blob that finds the places of a marker once, however many hits ask for them."""

    def places(self, marker: bytes) -> list[int]:
        known = self.__dict__.setdefault("known", {})
        if marker not in known:
            known[marker], at = [], self.find(marker)
            while at >= 0:
                known[marker].append(at)
                at = self.find(marker, at + 1)
        return known[marker]

    def next(self, marker: bytes, start: int) -> int:
        """First place of ``marker`` at or after ``start``, or -1."""
        found = self.places(marker)
        k = bisect_left(found, start)
        return found[k] if k < len(found) else -1

    def refuted(self, kind: str) -> bytearray:
        """Marks of the places from which a chain of ``kind`` is known not to end, two for each byte."""
        known = self.__dict__.setdefault("known", {})
        if kind not in known:
            known[kind] = bytearray(2 * len(self) + 2)
        return known[kind]

    def archives(self) -> dict[int, int]:
        """Start and end of the ZIP archives that the end records declare; of several with one start the first."""
        known = self.__dict__.setdefault("known", {})
        if "archives" not in known:
            known["archives"] = out = {}
            for end in self.places(b"PK\x05\x06"):
                if end + 22 <= len(self):
                    size, offset, note = struct.unpack_from("<IIH", self, end + 12)
                    start = end - size - offset
                    if start >= 0 and self[end - size : end - size + 4] == b"PK\x01\x02" and end + 22 + note <= len(self):
                        out.setdefault(start, end + 22 + note)
        return known["archives"]


def _riff(b: bytes, i: int) -> tuple[str, int] | None:
    """RIFF: the form names WAVE, WEBP or AVI; chunks must tile the declared length."""
    if i + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, i + 4)
    mime = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    end = i + 8 + size
    if mime is None or end > len(b):
        return None
    at, seen = i + 12, set()
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, at)
        seen.add(name)
        at += 8 + n + (n & 1)
    if at not in (end, end + 1) or mime == "audio/wav" and not {b"fmt ", b"data"} <= seen:
        return None
    return mime, size + 8


def _png(b: bytes, i: int) -> tuple[str, int] | None:
    """PNG: IHDR first, checksums right, IEND last."""
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, at)
        end = at + 12 + n
        if end > len(b) or first and n != 13 or not name.isalpha() or first != (name == b"IHDR") or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        if name == b"IEND":
            return "image/png", end - i
        at, first = end, False
    return None


def _jpeg(b: bytes, i: int) -> tuple[str, int] | None:
    """JPEG: marker segments up to the scan, then the end marker."""
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind, n = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if n < 2 or kind in (0x00, 0xFF):
            return None
        at += 2 + n
        if kind == 0xDA:
            end = b.next(b"\xff\xd9", at)
            return ("image/jpeg", end + 2 - i) if end >= 0 else None
    return None


def _gif(b: Blob, i: int) -> tuple[str, int] | None:
    """GIF: screen descriptor, then blocks of extensions and images up to the trailer; a place that led nowhere is not walked from again."""
    if i + 13 > len(b):
        return None
    flags = b[i + 10]
    at, inside, dead, path = i + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0, b.refuted("gif"), []
    while at < len(b) and not dead[2 * at + inside]:
        path.append(2 * at + inside)
        if inside:
            at, inside = (at + b[at] + 1, 1) if b[at] else (at + 1, 0)
        elif b[at] == 0x3B:
            return "image/gif", at + 1 - i
        elif b[at] == 0x21:
            at, inside = at + 2, 1
        elif b[at] == 0x2C and at + 10 < len(b):
            local = b[at + 9]
            at, inside = at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0), 1
        else:
            break
    for p in path:
        dead[p] = 1
    return None


def _bmp(b: bytes, i: int) -> tuple[str, int] | None:
    if i + 30 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, i + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, i + 18)
    if zero or planes != 1 or header not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not 14 + header <= offset <= size or i + size > len(b):
        return None
    return ("image/bmp", size) if offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _gzip(b: Blob, i: int) -> tuple[str, int] | None:
    """GZIP: no reserved flag, and a stream that ends with the right checksum; what it unpacks to is dropped piece by piece."""
    if i + 18 > len(b) or b[i + 3] & 0xE0:
        return None
    # a stored name or comment ends with a zero byte, here within 4 KB
    if b[i + 3] & 0x18 and b.find(b"\0", i + 10, i + 10 + (1 << 12)) < 0:
        return None
    d, at, rest, step = zlib.decompressobj(31), i, b"", 1 << 12
    try:
        while not d.eof:
            if not rest:
                rest, at, step = b[at : at + step], at + step, min(2 * step, 1 << 16)
                if not rest:
                    return None
            d.decompress(rest, step)
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return "application/gzip", min(at, len(b)) - len(d.unused_data) - i


def _zip(b: Blob, i: int) -> tuple[str, int] | None:
    """ZIP: an end record whose directory offset leads back to this first entry."""
    end = b.archives().get(i)
    return ("application/zip", end - i) if end else None


def _pdf(b: Blob, i: int) -> tuple[str, int] | None:
    """PDF: a cross-reference pointer and, after it, the last end mark of the blob."""
    ends, at = b.places(b"%%EOF"), b.next(b"startxref", i)
    return ("application/pdf", ends[-1] + 5 - i) if ends and 0 <= at < ends[-1] else None


def _ogg(b: Blob, i: int) -> tuple[str, int] | None:
    """Ogg: consecutive pages; the stream ends with the page flagged so.  A page that led nowhere is not walked from again."""
    at, dead, path = i, b.refuted("ogg"), []
    while at + 27 <= len(b) and not dead[2 * at] and b[at : at + 4] == b"OggS" and b[at + 4] == 0:
        path.append(2 * at)
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            break
        if b[at + 5] & 4:
            return "audio/ogg", end - i
        at = end
    for p in path:
        dead[p] = 1
    return None


def _flac(b: bytes, i: int) -> tuple[str, int] | None:
    """FLAC: STREAMINFO of 34 bytes first; frames have no stored length, so the rest of the blob belongs to it."""
    return ("audio/flac", len(b) - i) if i + 42 <= len(b) and b[i + 4] & 0x7F == 0 and b[i + 5 : i + 8] == b"\x00\x00\x22" else None


def _tiff(b: bytes, i: int) -> tuple[str, int] | None:
    """TIFF: the first directory has to lie inside the blob; the file runs to its end."""
    o = "<" if b[i : i + 2] == b"II" else ">"
    if i + 8 > len(b):
        return None
    at = struct.unpack_from(o + "I", b, i + 4)[0]
    if at < 8 or i + at + 2 > len(b):
        return None
    n = struct.unpack_from(o + "H", b, i + at)[0]
    return ("image/tiff", len(b) - i) if 0 < n and i + at + 2 + 12 * n + 4 <= len(b) else None


VALIDATORS = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"\xff\xd8\xff": _jpeg,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"BM": _bmp,
    b"fLaC": _flac,
    b"OggS": _ogg,
    b"PK\x03\x04": _zip,
    b"%PDF-": _pdf,
    b"\x1f\x8b\x08": _gzip,
    b"II*\x00": _tiff,
    b"MM\x00*": _tiff,
}


def automaton():
    """Aho-Corasick automaton over all signatures; bytes are scanned as latin-1 characters."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in SIGNATURES:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(blob: bytes, auto) -> list[Segment]:
    """Validated segments in order of start, the outer ones first; segments inside another are kept as embedded media."""
    found, blob = [], Blob(blob)
    for last, magic in auto.iter(blob.decode("latin-1")):
        start = last - len(magic) + 1
        if hit := VALIDATORS[magic](blob, start):
            found.append(Segment(hit[0], start, hit[1]))
    return sorted(found, key=lambda s: (s.start, -s.length))


def wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """Mono PCM with one unsigned 8-bit sample for each payload byte."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(blob: bytes) -> bytes:
    """The data chunk of a validated WAVE blob."""
    at = 12
    while at + 8 <= len(blob):
        name, n = struct.unpack_from("<4sI", blob, at)
        if name == b"data":
            return blob[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


SEGMENTS = T.ArrayType(T.StructType([T.StructField("mime", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def sniffed(blob: Column, declared: Column) -> Column:
    """struct<mime, was_declared, segments>: the corrected type of a blob column and all carved segments.

    Null and empty blobs, and those without a validated segment at their start, keep the
    declared type (null: application/octet-stream).
    """
    kind = T.StructType([T.StructField("mime", T.StringType()), T.StructField("was_declared", T.BooleanType()), T.StructField("segments", SEGMENTS)])

    @F.pandas_udf(kind)
    def run(blobs, types):
        import pandas as pd

        auto, out = automaton(), []
        for b, t in zip(blobs, types, strict=True):
            found = sniff(b, auto) if b else []
            mime = found[0].mime if found and found[0].start == 0 else t or UNKNOWN
            out.append((mime, mime == t, [(s.mime, s.start, s.length) for s in found]))
        return pd.DataFrame(out, columns=["mime", "was_declared", "segments"])

    return run(blob, declared)


def carve(df: DataFrame, blob: str = "content", declared: str = "mime", prefix: str = "media") -> DataFrame:
    """One row for each validated segment: all input columns, and its type, place and bytes in ``<prefix>_*`` columns."""
    seen = df.withColumn(f"{prefix}_sniffed", sniffed(F.col(blob), F.col(declared)))
    s = F.col(f"{prefix}_segment")
    return (
        seen.withColumn(f"{prefix}_segment", F.explode(f"{prefix}_sniffed.segments"))
        .withColumn(f"{prefix}_mime", s["mime"])
        .withColumn(f"{prefix}_start", s["start"])
        .withColumn(f"{prefix}_bytes", F.expr(f"substring(`{blob}`, cast({prefix}_segment.start + 1 as int), cast({prefix}_segment.length as int))"))
        .drop(f"{prefix}_sniffed", f"{prefix}_segment")
    )


def encode_text(text: Column) -> Column:
    """UTF-8 bytes of a text column (null: empty), padded to whole units, as a WAVE blob."""

    @F.pandas_udf(T.BinaryType())
    def run(texts):
        import pandas as pd

        out = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            out.append(wav(raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))))
        return pd.Series(out)

    return run(text)


DIGEST = T.StructType(
    [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)


def media_digest(blob: Column, declared: Column) -> Column:
    """Sniff a stored blob, carve its outer segment, read its samples back and describe them.

    ``feature``: found type, number of embedded segments, least, greatest and mean sample and the
    count of sign changes around the middle value 128.
    """

    @F.pandas_udf(DIGEST)
    def run(blobs, types):
        import hashlib

        import numpy as np
        import pandas as pd

        auto, out = automaton(), []
        for b, t in zip(blobs, types, strict=True):
            b = bytes(b)
            found = sniff(b, auto)
            outer = found[0]
            payload = wav_samples(b[outer.start : outer.start + outer.length])
            x = np.frombuffer(payload, dtype=np.uint8)
            crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
            feature = f"{outer.mime};corrected={int(outer.mime != t)};embedded={len(found) - 1};min={x.min()};max={x.max()};mean={x.mean():.4f};crossings={crossings}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature))
        return pd.DataFrame(out, columns=DIGEST.fieldNames())

    return run(blob, declared)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes as a WAVE blob that was declared text/plain: sniffed, corrected, read back and described.

    Null texts count as empty, and an empty text is one unit of padding; texts of any length are stored whole; repeated
    rows and ties get equal values, null ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), encode_text(F.col("text")).alias("content"))
    return stored.select("doc_id", "n_bytes", media_digest(F.col("content"), F.lit("text/plain")).alias("d")).select("doc_id", "n_bytes", "d.*")
