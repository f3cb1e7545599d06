"""Token ids of whole documents in bit-packed files.

An id takes as many bits as the vocabulary needs.  A file is one Parquet part, written and committed by Spark, so any store and
any lost executor is covered; its rows are segments, self-contained byte strings:

    magic, bits, block ids, number of ids, of documents and of blocks     (header)
    id of each document, whether it has one, where its ids begin          (document table)
    byte offset of each block                                            (block table)
    blocks of 1024 ids, packed from the least significant bit upwards     (payload)

Blocks begin at whole bytes, so any range of ids is read by unpacking the blocks it touches.  Documents lie in ascending order of
their ids over files and segments and never cross a segment, which therefore is as long as ``SEGMENT_IDS`` or one document asks for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import byte_letters
from .common import free_name, shared_folder, small_batches, table
from .packing import CACHE_WORDS, WordEncoder, tokenizer_path

MAGIC = b"IDBITS01"
HEADER = "<8sIIQQQ"
#: Ids of a block: a multiple of 32, so that a full block of any width ends at a whole byte.
BLOCK_IDS = 1024
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
END_ID = 2
SEGMENT_ROWS = "file int, first long, n_ids long, content binary"


def width(vocabulary: int) -> int:
    """Least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids, bits: int) -> bytes:
    """Ids one after another, ``bits`` each, least significant bit first."""
    import numpy as np

    ids = np.asarray(ids, dtype=np.uint64)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 32)
    lanes = np.zeros(groups * 32, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, 32)
    words = np.zeros((groups, bits + 1), np.uint64)
    for j in range(32):
        w, shift = divmod(j * bits, 32)
        moved = lanes[:, j] << np.uint64(shift)
        words[:, w] |= moved & np.uint64(0xFFFFFFFF)
        words[:, w + 1] |= moved >> np.uint64(32)
    return words[:, :bits].astype("<u4").tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data, n: int, bits: int):
    """The first ``n`` ids of packed bytes as unsigned 32-bit numbers."""
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    groups = -(-n // 32)
    raw = np.zeros(groups * bits * 4, np.uint8)
    raw[: min(len(data), len(raw))] = np.frombuffer(data, np.uint8, min(len(data), len(raw)))
    words = np.zeros((groups, bits + 1), np.uint64)
    words[:, :bits] = raw.view("<u4").reshape(groups, bits)
    out = np.empty((groups, 32), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        w, shift = divmod(j * bits, 32)
        out[:, j] = ((words[:, w] | (words[:, w + 1] << np.uint64(32))) >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def segment(doc_ids: list, ids: list[bytes], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One segment of documents, whose ids come as unsigned 32-bit little-endian bytes."""
    import numpy as np

    if block % 32:
        raise ValueError("a block holds a multiple of 32 ids")
    flat = np.frombuffer(b"".join(ids), "<u4")
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    starts = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<u8")
    blocks = -(-len(flat) // block)
    offsets = np.minimum(np.arange(blocks + 1) * (block * bits // 8), -(-len(flat) * bits // 8)).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    head = struct.pack(HEADER, MAGIC, bits, block, len(flat), len(doc_ids), blocks)
    return b"".join((head, names.tobytes(), known.tobytes(), starts.tobytes(), offsets.tobytes(), pack_bits(flat, bits)))


class Segment:
    """A segment's tables, and its ids by range."""

    def __init__(self, content: bytes):
        import numpy as np

        magic, self.bits, self.block, self.n_ids, docs, blocks = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = struct.calcsize(HEADER)
        names = np.frombuffer(content, "<i8", docs, at)
        known = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        self.starts = np.frombuffer(content, "<u8", docs + 1, at + 9 * docs)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at + 17 * docs + 8)
        self.payload = memoryview(content)[at + 17 * docs + 8 + 8 * (blocks + 1) :]
        if len(self.payload) != int(self.offsets[-1]):
            raise ValueError("a segment is cut short")
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]

    def ids(self, start: int = 0, end: int | None = None):
        """Ids from ``start`` to before ``end``; only the blocks that hold them are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return unpack_bits(b"", 0, 32)
        a, b = start // self.block, -(-end // self.block)
        n = min(b * self.block, self.n_ids) - a * self.block
        part = unpack_bits(self.payload[int(self.offsets[a]) : int(self.offsets[b])], n, self.bits)
        return part[start - a * self.block : end - a * self.block]


class Numbers(dict):
    """Numbers keys as they come; ``fresh`` holds those that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class ChunkEncoder(WordEncoder):
    """Ids of whole texts through a table of white-space-free chunks, each made of pre-tokens, which never hold white space.

    A chunk costs one look-up; its pre-tokens are cut only when it is new.  What holds for ``WordEncoder`` holds here.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.numbers, self.table, self.words = Numbers(), [], {}
        self.model = self.merges.model
        self.letters = {b: c for c, b in byte_letters().items()}

    def _learn(self, used: set[str]) -> None:
        """Every pre-token of ``used`` is in ``words`` afterwards; the model alone merges it, as the tokenizer's other steps are done."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        for w in used.difference(self.words):
            spelt = w if w.isascii() else "".join([self.letters[b] for b in w.encode()])
            self.words[w] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > CACHE_WORDS:
            self.numbers, self.table = Numbers(), []
        number, cut = self.numbers.__getitem__, []
        for raw in texts:
            t = raw.lower()
            special = "<" in t and self.special.search(t) is not None
            cut.append(None if special else list(map(number, t.split())) if self.SIMPLE.fullmatch(raw) else raw)
        if self.numbers.fresh:
            parts = [self.PRE.findall(c) for c in self.numbers.fresh]
            self._learn(set().union(*parts))
            ids = self.words.__getitem__
            self.table.extend([b"".join(map(ids, p)) for p in parts])
            self.numbers.fresh = []
        of = self.table.__getitem__

        def one(text, cut):
            if cut is None:
                return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            return self._words(cut) if isinstance(cut, str) else b"".join(map(of, cut))

        return [one(*x) for x in zip(texts, cut, strict=True)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes ``text`` of every document, appends ``end_id`` and writes the ids to files in ``folder``, ascending by ``doc_id``.

    Rows without an id come last; rows of one id are ordered by a hash of their texts, equal rows stay separate documents.
    Null texts count as empty and hold the end id alone; texts of any length are encoded whole.  Other columns are ignored.
    An empty table writes an empty folder.  Rows are dealt to files by ranges of id, hash and row, so nulls or one repeated id
    fill as many files as others do.
    """
    small_batches(docs.sparkSession)
    keys = ["doc_id", free_name(docs, "tie"), free_name(docs, "row")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn(keys[1], F.xxhash64(F.col("text").cast("binary"))).withColumn(keys[2], F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col(keys[1]), F.col(keys[2])]

    def write(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        enc, end = chunk_encoder(tokenizer), end_id.to_bytes(4, "little")
        bits = width(enc.merges.get_vocab_size())
        file, first, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pd.DataFrame({"file": np.array([file], np.int32), "first": [first], "n_ids": [held], "content": [segment(names, ids, bits)]})

        for pdf in batches:
            known = pdf["doc_id"].notna()
            texts = [t or "" for t in pdf["text"]]
            for i in range(0, len(texts), 256):
                for k, found in enumerate(enc.encode(texts[i : i + 256]), i):
                    names.append(int(pdf["doc_id"].iat[k]) if known.iat[k] else None)
                    ids.append(found + end)
                    held += len(ids[-1]) // 4
                    if held >= segment_ids:
                        yield row()
                        first, names, ids, held = first + held, [], [], 0
        if names:
            yield row()

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id crosses as text, so that a long next to nulls never becomes a double
    ranged = ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ranged.mapInPandas(write, SEGMENT_ROWS).write.parquet(folder)


def with_base(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``base``, the number of ids in all files before theirs.  One number of each file crosses the driver."""
    rows = spark.read.parquet(folder)
    sizes = sorted(rows.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for file, n in sizes:
        bases.append((file, total))
        total += n
    return rows.join(F.broadcast(spark.createDataFrame(bases, "file int, base long")), "file")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for base, first, content in zip(pdf["base"], pdf["first"], pdf["content"], strict=True):
                seg = Segment(content)
                raw, at = memoryview(seg.ids().tobytes()), [int(x) for x in seg.starts]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(seg.doc_ids, "Int64"),
                        "start": [base + first + a for a in at[:-1]],
                        "n_tokens": [b - a for a, b in zip(at, at[1:])],
                        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])],
                    }
                )

    found = with_base(spark, folder).select("base", "first", "content")
    return found.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, start: int, count: int) -> DataFrame:
    """(place, id) of the ids from ``start`` on: only segments that hold them are opened, and in these only their blocks."""
    at = F.col("base") + F.col("first")
    near = with_base(spark, folder).where((at < start + count) & (at + F.col("n_ids") > start)).select(at.alias("at"), "content")

    def read(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for at, content in zip(pdf["at"], pdf["content"], strict=True):
                a = max(0, start - at)
                ids = Segment(content).ids(a, start + count - at)
                yield pd.DataFrame({"place": np.arange(len(ids), dtype=np.int64) + at + a, "id": ids.astype(np.int64)})

    return near.mapInPandas(read, "place long, id long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number of tokens and checksum of every document's ids, read back from bit-packed files in the shared folder.

    Null, empty and very long texts, null and repeated ids, ties, empty tables and other columns are treated as ``write_tokens`` says.
    """
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_documents(spark, folder)
