"""Which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the bytes of a text.  Their ends make elementary intervals: the union of both end arrays; the owners of an
interval, found by binary search, are one overlap; an end that both share closes a group, and a group's tokens are each other's
counterparts.  How often an id pair is linked is counted over the whole corpus, and each document is told what its links count for.

Neither tokenizer joins what stands before a blank or a line break with what follows, unless white space stands before it.  So a text
is a sequence of chunks, and each chunk is aligned once for a shard of some hundred documents.
Where that does not hold for a text or a tokenizer, the whole text is one chunk.

A shard numbers its distinct id pairs, and each of its documents is a row with the numbers of its pairs and how often it links them, so
no row is longer than its document.  Pairs are summed over all shards, and what a shard needs of the sums is joined back to its
documents, so nothing of corpus size is ever broadcast.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Characters of text after which a shard is closed.
SHARD_CHARS = 1 << 21
#: Different chunks after which it is closed too: each costs a worker about 1 KB while they are aligned.
SHARD_CHUNKS = 1 << 17
#: Characters that one call of a tokenizer receives, but for longer chunks.
CALL_CHARS = 1 << 14
MODES = ("end", "overlap", "group")
#: Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK = re.compile(r"[ \n]*[^ \n]+(?:[ \n]+\Z)?|[ \n]+")
#: White space besides blank and line break: texts that hold it stay whole.
OTHER_SPACE = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if chr(c) != "\n"]
#: What makes a chunk more than one piece of white space and what follows it.
RUNS = ("  ", " \n", "\n ", "\n\n", "\x00")
#: Begins the key of a chunk that is encoded by itself.
LONE = "\x00"


def elementary(ends_a, ends_b):
    """(owner of A, owner of B, closes) of each elementary interval of two rising end arrays with one last end.

    An interval is one overlap of its owners; ``closes`` is true where both sides end.
    """
    import numpy as np

    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def pairs_of(a, b, closes, mode: str):
    """Token places (of A, of B) that are linked, by ``elementary`` intervals and in rising order: those that end together, that overlap, or that share a group."""
    import numpy as np

    if mode == "end":
        return a[closes], b[closes]
    if mode == "overlap":
        return a, b
    last_a, last_b = a[closes], b[closes]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    product = n_a * n_b
    group = np.repeat(np.arange(len(product)), product)
    within = np.arange(int(product.sum())) - np.repeat(np.cumsum(product) - product, product)
    return (last_a - n_a + 1)[group] + within // n_b[group], (last_b - n_b + 1)[group] + within % n_b[group]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns the chunks of many texts at once."""

    def __init__(self, byte_path: str, piece_path: str):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.quick = self._ranked(byte_path)
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        dec = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.comma, self.bar, self.semicolon = dec + ",", dec + "|", dec + ";"
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.by_chunk = not any("\n" in p or " " in p or "▁" in p.lstrip("▁") for p in pieces)

    def _ranked(self, path: str):
        """The byte-level tokenizer by ranks, several times faster, where the file's merges have rising ids; else None.

        It serves calls of bounded length; longer texts go to the tokenizer itself, whose time stays in proportion to them.
        """
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split, merges, vocab = model["pre_tokenizer"], model["model"]["merges"], model["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        plain = model["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not plain or merged != sorted(set(merged)) or any(len(self.bytes_a[i]) != 1 for i in range(merged[0])):
            return None
        ranks = {self.bytes_a[i]: i for i in [*range(merged[0]), *merged]}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def keys(self, text: str) -> list[str]:
        """Chunks of a text with a blank before it, which both tokenizers cut by themselves, as keys.

        A key is its chunk without the one blank that begins it; one that begins with a line break is its chunk, and ``LONE``
        goes before a chunk that must not be encoded next to others.
        """
        if not self.by_chunk or any(c in text for c in OTHER_SPACE[: 8 if text.isascii() else None]):
            return [f"{LONE} {text}"]
        if text[0] not in " \n" and text[-1] not in " \n" and not any(r in text for r in RUNS):
            return text.replace("\n", " \n").split(" ")
        return [LONE + c if c[-1] in " \n" or c[1:2] == LONE or c[:2] == " \n" else c if c[0] == "\n" else c[1:] for c in CHUNK.findall(" " + text)]

    @staticmethod
    def chunk(key: str) -> str:
        return key[1:] if key[0] == LONE else key if key[0] == "\n" else " " + key

    def _encode(self, texts: list[str]):
        """(ids of A, ids of B) of texts that begin with white space, or None where bytes are lost."""
        import numpy as np

        out = []
        # a letter goes before, to be taken away again: the second tokenizer would put a blank before white space
        short = self.quick is not None and max(map(len, texts)) <= 2 * CALL_CHARS
        if short:
            a = [self.quick.encode_ordinary(" x" + t) for t in texts]
        else:
            a = [e.ids for e in self.a.encode_batch_fast([" x" + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(["x" + t for t in texts], num_threads=1)
        for t, x, y in zip(texts, a, b, strict=True):
            want = (" x" + t).encode()
            if b"".join(map(self.bytes_a.__getitem__, x)) != want or b"".join(map(self.bytes_b.__getitem__, y)) != want:
                out.append(None)
                continue
            x, y = np.array(x), np.array(y)
            skip_a, skip_b = (int(np.searchsorted(np.cumsum(n[i]), 2)) + 1 for n, i in ((self.len_a, x), (self.len_b, y)))
            out.append((x[skip_a:], y[skip_b:]))
        return out

    def tokens(self, keys: list[str]):
        """Ids of all chunks in a row, the order of the chunks, their bytes, and which keep them: (ids of A, ids of B, order, lengths, kept)."""
        import numpy as np

        chunks, calls, lone, call, held = list(map(self.chunk, keys)), [], [], [], 0
        for k, c in enumerate(chunks):
            if keys[k][0] == LONE or len(c) > CALL_CHARS:
                lone.append([k])
                continue
            call.append(k)
            held += len(c)
            if held > CALL_CHARS:
                calls.append(call)
                call, held = [], 0
        if call:
            calls.append(call)
        kept, found = np.ones(len(chunks), bool), []
        calls += lone
        for i in range(0, len(calls), 64):
            part = calls[i : i + 64]
            encoded = self._encode(["".join(chunks[k] for k in call) for call in part])
            for call, e in zip(part, encoded, strict=True):
                if e is None and len(call) > 1:
                    found += [([k], one) for k, one in zip(call, self._encode([chunks[k] for k in call]), strict=True)]
                else:
                    found.append((call, e))
        order, ids = [], []
        for call, e in found:
            if e is None:
                kept[call[0]] = False
            else:
                order += call
                ids.append(e)
        lengths = np.zeros(len(chunks), np.int64)
        lengths[order] = [len(chunks[k].encode()) for k in order]
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *(x for x, _ in ids)]), np.concatenate([empty, *(y for _, y in ids)]), np.array(order, np.int64), lengths, kept

    def align(self, keys: list[str], mode: str):
        """Counts, group texts and linked id pairs of chunks; a chunk that loses bytes has none and is not kept."""
        import numpy as np

        n = len(keys)
        a, b, order, lengths, kept = self.tokens(keys)
        ends_a, ends_b, edges = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), np.cumsum(lengths[order])
        owner_a, owner_b = (np.searchsorted(edges, e) for e in (ends_a, ends_b))
        x, y, closes = elementary(ends_a, ends_b)
        last_a, last_b = x[closes], y[closes]
        counts = np.zeros((4, n), np.int64)
        link_a, link_b = pairs_of(x, y, closes, mode)
        link_chunk = owner_a[link_a]
        for row, owner in enumerate((owner_a, owner_b, owner_a[last_a], link_chunk)):
            counts[row, order] = np.bincount(owner, minlength=len(order)) if len(order) else 0
        # ids of A and then of B, group by group, as text
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        ends_group_a, ends_group_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_group_a[last_a], ends_group_b[last_b] = True, True
        parts = np.concatenate([np.where(ends_group_a, self.bar[a], self.comma[a]), np.where(ends_group_b, self.semicolon[b], self.comma[b])])
        parts = parts[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        tokens = (counts[0] + counts[1])[order]
        edge = np.concatenate([[0], np.cumsum(tokens)]).tolist()
        texts = [""] * n
        for k, i, j in zip(order.tolist(), edge, edge[1:]):
            texts[k] = "".join(parts[i:j])
        return counts, texts, order[link_chunk], a[link_a], b[link_b], kept


class Places(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker process, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    if (byte_path, piece_path) not in _ALIGNERS:
        _ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _ALIGNERS[byte_path, piece_path]


#: Columns of a document's result; ``link`` holds the numbers of its id pairs, signed 32-bit little-endian, and ``times`` how often it
#: links each, 64-bit, which only Python reads.  The first document of a shard also has the shard's pairs and their counts there.
DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
SHARDS = "shard string, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link binary, times binary, a array<int>, b array<int>, n array<long>"


def shard_rows(docs: DataFrame, byte_path: str, piece_path: str, mode: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row for each document, in shards of about ``shard_chars`` characters or ``SHARD_CHUNKS`` chunks."""

    def close(name, found, places, aligned):
        """A shard's rows from its documents' (id, chunk numbers) and its chunks."""
        import numpy as np
        import pandas as pd

        counts, texts, link_chunk, a, b, kept = aligned.align(list(places), mode)
        by_chunk = np.argsort(link_chunk, kind="stable")
        pair, link = np.unique((a[by_chunk].astype(np.int64) << 32) | b[by_chunk], return_inverse=True)
        size = np.bincount(link_chunk, minlength=len(places))
        start = np.cumsum(size) - size
        n = np.zeros(len(pair), np.int64)
        docs = []
        for doc, numbers in found:
            if not len(numbers) or not kept[numbers].all():
                docs.append((doc, 0, 0, 0, 0, "", b"", b""))
                continue
            sha = hashlib.sha256("".join([texts[k] for k in numbers.tolist()])[:-1].encode()).hexdigest()
            used, uses = np.unique(numbers, return_counts=True)
            held = size[used]
            places_of = np.repeat(start[used] - np.cumsum(held) + held, held) + np.arange(held.sum())
            times = np.bincount(link[places_of], np.repeat(uses, held), len(pair)).astype(np.int64)
            n += times
            own = np.flatnonzero(times)
            docs.append((doc, *(counts[:, used] @ uses).tolist(), sha, own.astype("<i4").tobytes(), times[own].astype("<i8").tobytes()))
        row = {c: list(v) for c, v in zip((*DOC, "link", "times"), zip(*docs, strict=True), strict=True)}
        rest = [None] * (len(docs) - 1)
        row |= {"a": [pair >> 32, *rest], "b": [pair & 0xFFFFFFFF, *rest], "n": [n, *rest]}
        return pd.DataFrame({"shard": name} | row)

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        aligned, task = aligner(byte_path, piece_path), TaskContext.get().partitionId()
        found, places, held, shards = [], Places(), 0, 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                keys = aligned.keys(text) if text else []
                found.append((doc, np.fromiter(map(places.__getitem__, keys), np.int32, len(keys))))
                held += len(text or "") + 64
                if held >= shard_chars or len(places) >= SHARD_CHUNKS:
                    rows = close(f"{task}-{shards}", found, places, aligned)
                    found, places, held, shards = [], Places(), 0, shards + 1
                    yield rows
        if found:
            yield close(f"{task}-{shards}", found, places, aligned)

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, SHARDS)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, mode: str = "end", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``mode`` says which tokens are linked: those whose ranges end together, overlap, or lie in one group.  Texts that are null, empty
    or lose bytes in a tokenizer have zeros and an empty hash and count for nothing; texts of any length are aligned whole.  Null
    and repeated ids and repeated rows are separate documents; of pairs with equal counts all are best; other columns are ignored;
    an empty table gives an empty result.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    small_batches(docs.sparkSession)
    shards = stored(shard_rows(docs, byte_path, piece_path, mode, shard_chars))
    pairs = shards.select(F.col("shard").alias("of"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("of", "at", "p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count")).where("count > 0")
    # both uses of the counts read one table
    counts = stored(counts)
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    judged = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))
    needed = pairs.where("n > 0").select("of", "at", "a", "b").join(judged, ["a", "b"]).select("of", "at", "count", "is_best")

    def finish(key, rows, found):
        import numpy as np
        import pandas as pd

        link, times = np.frombuffer(b"".join(rows["link"]), "<i4"), np.frombuffer(b"".join(rows["times"]), "<i8")
        ends = np.cumsum([len(x) // 4 for x in rows["link"]])
        starts = np.concatenate([[0], ends[:-1]])
        docs = rows[list(DOC)].copy()
        for name, column in (("n_best", "is_best"), ("count_sum", "count")):
            value = np.zeros(link.max(initial=-1) + 1, np.int64)
            value[found["at"].to_numpy()] = found[column].to_numpy()
            summed = np.concatenate([[0], np.cumsum(value[link] * times)])
            docs[name] = summed[ends] - summed[starts]
        docs["doc_id"] = pd.array([int(d) if d is not None else None for d in docs["doc_id"]], "Int64")
        return docs[NAMES]

    return shards.select("shard", *DOC, "link", "times").groupBy("shard").cogroup(needed.groupBy("of")).applyInPandas(finish, SCHEMA)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in NAMES)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the byte-level and the piece tokens of all documents; links are tokens whose ranges end together.

    Null, empty and very long texts, ties, repeated rows, empty tables and other columns are treated as ``align_documents`` says.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
