"""How far the sources of a language differ in their words, by mergeable radix tries.

Each partition counts its terms and writes them as byte tries, one for each language, whose leaves count the documents that hold the
term and its occurrences by source.  A trie is written as a walk in byte order, which is the order of UTF-8: every leaf tells how many
bytes it shares with the leaf before it, and the bytes that follow.  A partition's terms are put in that order and give their walk without
nodes, which only merging needs.  Walks are cut into runs, runs are dealt to prefix ranges of about equal size, and each range merges its
runs into one trie and keeps the terms of enough documents.  A second walk over the merged tries adds up, for each pair of sources, what
the terms differ by, and streams the candidates of each source in tie order.

Shares are exact: with n occurrences of all kept terms and V kept terms, a term of count c has 1 + floor(10^9 (c + 1) / (n + V)).
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import defaultdict
from itertools import chain, count, pairwise

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored, table

UNIT = 10**9
#: Leaves of a run, and counted entries (of a term and a source) after which a partition writes its tries and begins anew.
RUN_LEAVES, ENTRIES = 1024, 1 << 20
#: Bytes of texts that stand in terms together; a longer text stands alone.
TEXT_BYTES = 4 << 20
#: Bytes of runs that one range merges, on average.
RANGE_BYTES = 8 << 20
#: Entries of the table of shares that is held at a time.
BLOCK = 1 << 21
MIN_DOCS, TOP = 3, 200

#: Letters of ASCII in lower case and all bytes beyond ASCII stay; every other byte parts terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, repeats included."""
    return text.translate(TERM_BYTES).split()


class Trie:
    """Radix trie of byte strings.  A node is [label, children by first byte, documents, occurrences by source or None]."""

    def __init__(self):
        self.root = [b"", {}, 0, None]

    def merge(self, walk) -> None:
        """Adds the leaves of a rising walk of (bytes shared with the leaf before, bytes that follow, documents, occurrences).

        The place of the last leaf is kept, so what a leaf shares with it is not walked again.
        """
        path, term = [(self.root, 0)], b""
        for shared, suffix, docs, counts in walk:
            term = term[:shared] + suffix
            while path[-1][1] > shared:
                path.pop()
            node, at = path[-1]
            while at < len(term):
                kid = node[1].get(term[at])
                if kid is None:
                    kid = node[1][term[at]] = [term[at:], {}, 0, None]
                    at = len(term)
                elif term.startswith(kid[0], at):
                    at += len(kid[0])
                else:
                    kid, at = self._split(node, kid, term, at)
                node = kid
                path.append((node, at))
            node[2] += docs
            if node[3] is None:
                node[3] = dict(counts)
            else:
                for source, n in counts.items():
                    node[3][source] = node[3].get(source, 0) + n

    @staticmethod
    def _split(node, kid, term, at):
        """A node for what ``kid``'s label shares with the term, and the depth where it ends."""
        label, k = kid[0], 1
        while k < len(label) and at + k < len(term) and label[k] == term[at + k]:
            k += 1
        upper = [label[:k], {label[k]: kid}, 0, None]
        kid[0] = label[k:]
        node[1][label[0]] = upper
        return upper, at + k

    def walk(self):
        """All leaves in byte order, as ``merge`` takes them."""
        todo, path, shared = [(self.root, 0)], bytearray(), 0
        while todo:
            node, depth = todo.pop()
            shared = min(shared, depth)
            del path[depth:]
            path += node[0]
            if node[3] is not None:
                yield shared, bytes(path[shared:]), node[2], node[3]
                shared = len(path)
            todo.extend((node[1][b], len(path)) for b in sorted(node[1], reverse=True))


def runs(walk, starts_new):
    """(first term, last term, leaves) of runs of a walk; a run begins where ``starts_new(term, leaves so far)`` says, with its first term in full."""
    leaves, term, first = [], b"", b""
    for shared, suffix, docs, counts in walk:
        before, term = term, term[:shared] + suffix
        if leaves and starts_new(term, len(leaves)):
            yield first, before, leaves
            leaves = []
        if not leaves:
            first, shared, suffix = term, 0, term
        leaves.append((shared, suffix, docs, counts))
    if leaves:
        yield first, term, leaves


def packed(leaves) -> bytes:
    return pickle.dumps(tuple(map(list, zip(*leaves, strict=True))), protocol=5)


def unpacked(body: bytes):
    return zip(*pickle.loads(body), strict=True)


def shared_bytes(rising: list[bytes]) -> list[int]:
    """How many bytes each term shares with the term before it."""
    out, before = [], b""
    for term in rising:
        k, most = 0, min(len(before), len(term))
        while k < most and before[k] == term[k]:
            k += 1
        out.append(k)
        before = term
    return out


class Counts:
    """Documents and occurrences by source of the terms of a language.

    A term has a number; an entry is (number << 32 | place of the source, occurrences).  Entries of the same key stand side by side
    until ``compact`` adds them up.
    """

    def __init__(self):
        import numpy as np

        self.terms, self.sources = defaultdict(count().__next__), defaultdict(count().__next__)
        self.docs, self.entries = np.zeros(0, np.int64), []

    def add(self, sources, texts) -> int:
        """Counts documents; the number of entries that this takes."""
        import numpy as np

        found = [terms(text) for text in texts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        place = np.fromiter(map(self.sources.__getitem__, sources), np.int64, len(found))
        term = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(found)), np.int64, size.sum())
        del found
        once = np.unique(np.repeat(np.arange(len(size)) << 32, size) | term) & 0xFFFFFFFF
        docs = np.bincount(once, minlength=len(self.terms))
        docs[: len(self.docs)] += self.docs
        self.docs = docs
        self.entries.append(np.unique(term << 32 | np.repeat(place, size), return_counts=True))
        return len(self.entries[-1][0])

    def compact(self):
        """The entries with rising keys, every key once."""
        import numpy as np

        keys, n = map(np.concatenate, zip(*self.entries, strict=True))
        at = np.argsort(keys, kind="stable")
        keys, n = keys[at], n[at]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.entries = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        return self.entries[0]

    def runs(self, most: int):
        """(first term, last term, run of at most ``most`` leaves) of the walk of the terms' trie."""
        import numpy as np

        rising, names = sorted(self.terms), list(self.sources)
        number = np.fromiter(map(self.terms.__getitem__, rising), np.int64, len(rising))
        rank = np.empty_like(number)
        rank[number] = np.arange(len(rising))
        keys, n = self.compact()
        at = np.argsort(rank[keys >> 32], kind="stable")
        sources, n = [names[k] for k in (keys[at] & 0xFFFFFFFF).tolist()], n[at].tolist()
        ends = [0, *np.cumsum(np.bincount(keys >> 32, minlength=len(rising))[number]).tolist()]
        docs = self.docs[number].tolist()
        for i in range(0, len(rising), most):
            part = rising[i : i + most]
            shared, places = shared_bytes(part), pairwise(ends[i : i + most + 1])
            leaves = ((k, t[k:], d, dict(zip(sources[a:b], n[a:b], strict=True))) for k, t, d, (a, b) in zip(shared, part, docs[i : i + most], places, strict=True))
            yield part[0], part[-1], packed(leaves)


RUN = "lang string, first binary, last binary, size long, body binary"


def partial_tries(docs: DataFrame) -> DataFrame:
    """Runs of the tries of each partition of (lang, source, text in UTF-8)."""

    def written(counted):
        import pandas as pd

        for lang, found in counted.items():
            out = [(lang, first, last, len(run), run) for first, last, run in found.runs(RUN_LEAVES)]
            if out:
                yield pd.DataFrame(out, columns=["lang", "first", "last", "size", "body"])

    def run(batches):
        counted: dict[str, Counts] = {}
        held = 0
        for pdf in batches:
            piece = pdf["text"].map(len).cumsum() // TEXT_BYTES
            for (_, lang), part in pdf.groupby([piece, "lang"], sort=False):
                held += counted.setdefault(lang, Counts()).add(part["source"], part["text"])
                # twice the bound is let stand before equal keys are added up, which therefore stays rare
                if held > 2 * ENTRIES:
                    held = sum(len(found.compact()[0]) for found in counted.values())
                    if held > ENTRIES:
                        yield from written(counted)
                        counted, held = {}, 0
        yield from written(counted)

    return docs.mapInPandas(run, RUN)


def range_starts(tries: DataFrame) -> list[tuple[bytes, bytes]]:
    """(lang, term) at which prefix ranges begin, rising: one for each ``RANGE_BYTES`` of runs crosses the driver."""
    total = tries.agg(F.sum("size")).first()[0] or 0
    n = -(-total // RANGE_BYTES)
    if n < 2:
        return []
    key = F.struct(F.col("lang").cast("binary").alias("lang"), "first")
    spread = tries.select(key.alias("k")).repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted((bytes(r.k.lang), bytes(r.k.first)) for r in spread.collect())


def dealt(tries: DataFrame, starts: list[tuple[bytes, bytes]]) -> DataFrame:
    """Runs with the number of their range; a run that crosses a start is cut there."""

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for lang, first, last, body in zip(pdf["lang"], pdf["first"], pdf["last"], pdf["body"], strict=True):
                name = lang.encode()
                k = bisect_right(starts, (name, first))
                if k == bisect_right(starts, (name, last)):
                    out.append((lang, k, body))
                    continue
                place = [k]

                def crosses(term, _, name=name, place=place):
                    now = bisect_right(starts, (name, term))
                    moved, place[0] = now != place[0], now
                    return moved

                out += [(lang, bisect_right(starts, (name, a)), packed(part)) for a, _, part in runs(unpacked(body), crosses)]
            yield pd.DataFrame(out, columns=["lang", "range", "body"])

    return tries.select("lang", "first", "last", "body").mapInPandas(cut, "lang string, range int, body binary")


def merged_tries(tries: DataFrame, starts: list[tuple[bytes, bytes]], min_docs: int) -> DataFrame:
    """Kept leaves of each language's range, their number, and the occurrences by source."""

    def merge(key, pdf):
        import pandas as pd

        trie = Trie()
        for body in pdf["body"]:
            trie.merge(unpacked(body))
        n: dict[str, int] = {}
        term, last, kept = b"", b"", []
        for shared, suffix, docs, counts in trie.walk():
            term = term[:shared] + suffix
            if docs >= min_docs:
                kept.append((term, counts))
                for source, c in counts.items():
                    n[source] = n.get(source, 0) + c
        body = pickle.dumps(kept, protocol=5)
        return pd.DataFrame({"lang": [key[0]], "range": [key[1]], "v": [len(kept)], "sources": [list(n)], "n": [list(n.values())], "body": [body]})

    return dealt(tries, starts).groupBy("lang", "range").applyInPandas(merge, "lang string, range int, v long, sources array<string>, n array<long>, body binary")


def share(count, n: int, v: int):
    """1 + floor(10^9 (count + 1) / (n + v)) of an array of counts, exactly."""
    import numpy as np

    if len(count) and int(count.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // (n + v) for c in count], np.int64)
    return 1 + UNIT * (count + 1) // (n + v)


def judged(kept: DataFrame, langs: DataFrame, ranges: int, top: int) -> DataFrame:
    """The sums of every pair of sources, and each source's ``top`` terms, for groups of neighbouring ranges.

    Kept leaves are far fewer than counted ones, so ranges are put together again to about ``RANGE_BYTES`` of what was kept.
    """
    size = kept.agg(F.sum(F.length("body"))).first()[0] or 0
    groups = min(ranges, max(1, -(-size // RANGE_BYTES)))

    def judge(key, pdf):
        import numpy as np
        import pandas as pd

        lang, v, sources, n = key[0], int(pdf["v"].iat[0]), list(pdf["sources"].iat[0]), [int(x) for x in pdf["n"].iat[0]]
        place = {s: k for k, s in enumerate(sources)}
        total, width = sum(n), len(sources)
        sums, best = np.zeros((width, width), np.int64), [[] for _ in sources]
        step = max(1, BLOCK // width)
        for body in pdf.sort_values("range")["body"]:
            leaves = pickle.loads(body)
            for i in range(0, len(leaves), step):
                part = leaves[i : i + step]
                counts = np.zeros((len(part), width), np.int64)
                at = [(r, place[s], c) for r, (_, by_source) in enumerate(part) for s, c in by_source.items()]
                rows, columns, values = map(np.array, zip(*at, strict=True))
                counts[rows, columns] = values
                p = np.column_stack([share(counts[:, k], n[k], v) for k in range(width)])
                q = share(counts.sum(axis=1), total, v)
                for k in range(width):
                    other = p[:, k : k + 1]
                    sums[:, k] += ((p - other) ** 2 // other).sum(axis=0)
                    more = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
                    value = (p[more, k] - q[more]) ** 2 // q[more]
                    first = np.argsort(-value, kind="stable")[:top]
                    best[k] += [(part[more[j]][0], int(value[j])) for j in first]
                    if len(best[k]) > top:
                        best[k] = sorted(best[k], key=lambda x: (-x[1], x[0]))[:top]
        out = [("pair", s, t, int(sums[a, b])) for a, s in enumerate(sources) for b, t in enumerate(sources) if a != b]
        out += [("term", s, term.decode(), f) for s, found in zip(sources, best, strict=True) for term, f in found]
        pdf = pd.DataFrame(out, columns=["part", "source", "item", "value"])
        pdf.insert(0, "lang", lang)
        return pdf

    group = F.floor(F.col("range") * groups / F.lit(ranges)).cast("int")
    near = kept.where("v > 0").select("lang", "range", group.alias("group"), "body").join(langs, "lang")
    return near.groupBy("lang", "group").applyInPandas(judge, "lang string, part string, source string, item string, value long")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's words are from those of every other source and of the language.

    Null text, language and source count as empty; an empty text holds no term, but its source takes part; texts of any length are
    read whole; every row is a document, whatever its id; equal values are ranked by the bytes of their items; other columns are
    ignored; an empty table gives an empty result.  A term costs one entry of a partition's trie for each of its sources, however
    often it occurs, so no common term and no large source weighs on one task.
    """
    small_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    tries = stored(partial_tries(rows))
    starts = range_starts(tries)
    kept = stored(merged_tries(tries, starts, min_docs))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "n")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(counted, ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    langs = groups.join(kept.groupBy("lang").agg(F.sum("v").alias("v")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("g.source").alias("sources"), F.col("g.n").alias("n"))
    langs = stored(langs)
    found = stored(judged(kept, langs, len(starts) + 1, top))

    # a language without kept terms has pairs of value 0
    bare = langs.where("v = 0").select("lang", "sources", F.explode("sources").alias("source")).select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare.withColumn("value", F.lit(0).cast("long")))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [d.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(best)) for part, d in (("pair", pairs), ("term", found.where("part = 'term'").drop("part")))]
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(*names).unionByName(ranked[1].where(F.col("rank") <= top).select(*names))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and the terms that mark each source of all documents.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns are treated as ``source_divergence`` says.
    """
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
keep AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v FROM keep GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT c.* FROM c JOIN keep USING (lang, term)),
size AS (SELECT g.lang, g.source, coalesce(sum(kc.n), 0) AS total FROM g LEFT JOIN kc ON g.lang = kc.lang AND g.source = kc.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, keep.term, coalesce(kc.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(kc.n, 0) + 1)) // (s.total + v.v) AS p
      FROM size s JOIN keep ON s.lang = keep.lang JOIN v ON s.lang = v.lang LEFT JOIN kc ON kc.lang = s.lang AND kc.source = s.source AND kc.term = keep.term),
q AS (SELECT p.lang, p.term, 1 + (1000000000::HUGEINT * (sum(p.n) + 1)) // (any_value(t.total) + any_value(v.v)) AS q
      FROM p JOIN (SELECT lang, sum(total) AS total FROM size GROUP BY lang) t ON p.lang = t.lang JOIN v ON p.lang = v.lang GROUP BY p.lang, p.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
marks AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every_pair
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM marks)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
