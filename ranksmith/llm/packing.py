"""Best-fit packing under several capacities at once.

Token ids are counted per document, documents longer than a sequence are cut, and the
pieces are packed by vector best fit: a bin is eligible if its residual tokens, document
count and attention cost all allow the piece, and among eligible bins the one with the
best weighted dot product (or the least residual norm) wins.

Pieces are dealt to shards of bounded size by a hash of their document; each shard is
packed by itself, in order of falling length, so a shard leaves at most a few bins
part-filled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Documents to a shard on average; one part-filled sequence in about a quarter as many.
SHARD_DOCS = 16384
#: Entries of a worker's two cache generations together.
CACHE_WORDS = 400_000
END_ID = 1


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold; ``attention`` bounds the sum of squared piece lengths."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096


class WordEncoder:
    """Ids of whole texts through a cache of pre-tokens.

    The tokenizer composes, lower-cases, cuts a text into pre-tokens (letter runs, single
    digits, runs of other signs, contractions) and merges inside a pre-token only.  For text
    of ASCII and composed Latin-1 letters the first steps are done here, so each distinct
    pre-token meets the tokenizer's merges once.  Any other word goes to the unchanged
    tokenizer as it is, and so does any whole text that holds the name of a special token.
    """

    SIMPLE = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self._whole = path, None
        self.merges = Tokenizer.from_file(path)
        names = [t.content.lower() for t in self.merges.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.merges.encode_special_tokens = True
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    @property
    def whole(self):
        """The unchanged tokenizer, loaded at the first word that needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _learn(self, used: set[str]) -> None:
        """Every pre-token of ``used`` is in the cache afterwards; a full cache ages, and what is used again moves up."""
        fresh = used.difference(self.cache)
        if not fresh:
            return
        if len(self.cache) + len(fresh) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
            fresh = used
        known = fresh.intersection(self.older)
        self.cache.update({w: self.older[w] for w in known})
        fresh = list(fresh.difference(known))
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            for w, e in zip(part, self.merges.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[w] = array("I", e.ids).tobytes()

    def _words(self, text: str) -> bytes:
        out = []
        for w in text.translate(_SPACES).split(" "):
            if w:
                if w not in self.odd:
                    if len(self.odd) > CACHE_WORDS // 8:
                        self.odd = {}
                    self.odd[w] = array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()
                out.append(self.odd[w])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit bytes, little-endian."""
        special = [self.special.search(t.lower()) is not None for t in texts]
        cut = [self.PRE.findall(t.lower()) if not s and self.SIMPLE.fullmatch(t) else None for t, s in zip(texts, special, strict=True)]
        self._learn(set().union(*(c for c in cut if c)))
        get = self.cache.__getitem__

        def ids(text, cut, special):
            if special:
                return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            return self._words(text) if cut is None else b"".join(map(get, cut))

        return [ids(*x) for x in zip(texts, cut, special, strict=True)]


_SPACES = {c: " " for c in b"\t\n\x0b\x0c\r"}
PIECE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in ("piece", "start", "length", "ids_crc32")]))


def pieces(text, path: str, tokens: int):
    """Array of a text column's pieces; null counts as empty, and an empty text still has its end id."""
    # imported here, as that module builds on this one
    from .token_files import chunk_encoder

    @F.pandas_udf(PIECE)
    def run(texts):
        import pandas as pd

        enc, out = chunk_encoder(path), []
        end = END_ID.to_bytes(4, "little")
        texts = [t or "" for t in texts]
        for i in range(0, len(texts), 256):
            for ids in enc.encode(texts[i : i + 256]):
                ids += end
                step = 4 * tokens
                out.append([{"piece": k, "start": a // 4, "length": (min(a + step, len(ids)) - a) // 4, "ids_crc32": zlib.crc32(ids[a : a + step])} for k, a in enumerate(range(0, len(ids), step))])
        return pd.Series(out)

    return run(text)


def vector_best_fit(lengths, cap: Capacity, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)):
    """Bin and offset of each piece, longest first.

    ``dot``: greatest weighted dot product of a piece's share of each capacity with the bin's
    used share, so the fullest bin in what the piece needs wins; ``norm``: least weighted norm
    of what would be left.  Ties go to the oldest bin.
    """
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    caps = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    w = np.array(weights)
    room = np.empty((1024, 3))
    ids = np.empty(1024, np.int64)
    n = made = 0
    least = int(lengths.min()) if len(lengths) else 0
    for at in order:
        need_tokens = int(lengths[at])
        need = np.array([need_tokens, 1, need_tokens * need_tokens], dtype=np.float64)
        if (need > caps).any():
            raise ValueError(f"a piece of {need_tokens} tokens exceeds the capacities")
        fits = np.flatnonzero((room[:n] >= need).all(axis=1)) if n else ()
        if len(fits):
            left = room[fits]
            if rule == "dot":
                best = int(np.argmax(((1 - left / caps) * (need / caps)) @ w))
            else:
                best = int(np.argmin((((left - need) / caps) ** 2) @ w))
            slot = int(fits[best])
        else:
            if n == len(room):
                room, ids = np.concatenate((room, np.empty_like(room))), np.concatenate((ids, np.empty_like(ids)))
            slot, n = n, n + 1
            room[slot], ids[slot] = caps, made
            made += 1
        bins[at], offsets[at] = ids[slot], cap.tokens - int(room[slot, 0])
        room[slot] -= need
        if room[slot, 0] < least or room[slot, 1] < 1 or room[slot, 2] < least * least:
            keep = n - 1
            room[slot : keep] = room[slot + 1 : n]
            ids[slot : keep] = ids[slot + 1 : n]
            n = keep
    return bins, offsets


def pack(docs: DataFrame, path: str, cap: Capacity = Capacity(), rule: str = "dot", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every document of ``docs``.

    Null texts count as empty, empty ones are one piece with the end id alone, texts of any length are cut into pieces;
    repeated rows and null ids are packed like others, each row by itself; other columns are ignored.  An empty table
    gives an empty result.  Pieces are dealt to shards by id, content and place, so null or repeated ids do not pile up.
    """
    n_docs = docs.count()
    shards = max(1, -(-n_docs // shard_docs))
    cut = docs.select("doc_id", F.explode(pieces(F.col("text"), path, cap.tokens)).alias("p")).select("doc_id", "p.*")
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "piece", "length", "ids_crc32"), F.lit(shards)))

    def one(key, pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = vector_best_fit(pdf["length"].to_numpy(), cap, rule)
        pdf["sequence_id"] = int(key[0]) * (1 << 32) + bins
        pdf["offset"] = offsets
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return dealt.groupBy("shard").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    The contract asks for as few sequences as that one limit allows, so the document and attention capacities stand at
    values that 4096 tokens imply; ``pack`` takes tighter ones.  Null, empty and very long texts, ties, repeated rows,
    empty tables and other columns are treated as ``pack`` says.
    """
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
