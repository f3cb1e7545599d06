"""SimHash near-deduplication by a self-join of a binary trie.

Fingerprints that differ in at most ``budget`` bits agree fully in one of ``budget + 1``
parts, so each is dealt once for each part, with that part turned to its top bits.  Rows with
the same part form a trie below it, and a walk over pairs of its nodes adds up differing
bits and stops where they exceed the budget.  A part shared by very many fingerprints is
split again by the parts of its remaining bits, so no group grows with the data.

Inside a group only a spanning forest of the links leaves the task; components are then
joined by rounds of star contraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, cut_lineage, keyed, stored, table

SEED = 42
#: Rows dealt to one task, and the most with one part before its remaining bits split them.
BUCKET_ROWS, GROUP_ROWS = 40_000, 20_000
#: Near copies: 32-bit slices compared within 3 bits, twelve of them; all 384 bits then tell which pairs to verify.
SLICES, SLICE_BITS, SLICE_BUDGET = 12, 32, 3
#: Nodes of a block of a cluster and sets that one task holds, on average.
BLOCK_NODES, BUCKET_SETS = 512, 2000


def shingle_hashes(text: str | None, width: int, seed: int = SEED):
    """XXH64 of each run of ``width`` words (ASCII lower case), repeats included; fewer words give one hash, none an empty array."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    if width == 3 and len(words) >= 3:
        return np.fromiter((h(b"%b %b %b" % t, seed) for t in zip(words, words[1:], words[2:])), np.uint64, n)
    return np.fromiter((h(b" ".join(words[i : i + width]), seed) for i in range(n)), np.uint64, n)


def majority_bits(hashes) -> int:
    """The 64 bits set in over half of the hashes, as an unsigned number; 0 for none."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text, width: int = 3):
    """64-bit fingerprint of a text column as a signed long."""

    @F.pandas_udf(T.LongType())
    def run(texts):
        import numpy as np
        import pandas as pd

        return pd.Series(np.array([majority_bits(shingle_hashes(t, width)) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def sketch(text, width: int = 5, words: int = SLICES * SLICE_BITS // 64):
    """``words`` independent 64-bit fingerprints of the set of shingles, as bytes, a digest that only equal sets share, and the set's size."""

    @F.pandas_udf("sketch binary, same binary, size long")
    def run(texts):
        import hashlib

        import numpy as np
        import pandas as pd

        odd = np.uint64(0x9E3779B97F4A7C15)  # a multiplier that mixes well: 2^64 over the golden ratio
        out, same, size = [], [], []
        for t in texts:
            h, prints = np.unique(shingle_hashes(t, width)), []
            size.append(len(h))
            same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            for _ in range(words):
                prints.append(majority_bits(h))
                h = (h ^ (h >> np.uint64(31))) * odd
                h = (h ^ (h >> np.uint64(29))) * odd
                h ^= h >> np.uint64(32)
            out.append(np.array(prints, np.uint64).tobytes())
        return pd.DataFrame({"sketch": out, "same": same, "size": size})

    return run(text)


def shingle_set(text, width: int = 5):
    """The sorted hashes of the set of shingles, eight bytes each, and their digest as in ``sketch``."""

    @F.pandas_udf("shingles binary, same binary")
    def run(texts):
        import hashlib

        import numpy as np
        import pandas as pd

        sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in texts]
        return pd.DataFrame({"shingles": sets, "same": [hashlib.blake2b(h, digest_size=16).digest() for h in sets]})

    return run(text)


def jaccard(x, y) -> float:
    """Share of common members of two arrays of distinct hashes."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified_links(members: DataFrame, similarity: float, limit: int, block: int = BLOCK_NODES, bucket: int = BUCKET_SETS) -> DataFrame:
    """(u, v) that link the nodes of each cluster whose sets have a Jaccard similarity of ``similarity`` or more.

    members: node, cluster, sketch, size, shingles.  A cluster's nodes fall into blocks by hash and every two blocks meet once, so a
    set travels once for each block of its cluster.  Of two blocks, pairs whose sketches differ in at most ``limit`` bits and whose
    sizes allow it are compared, the closest first, unless others have joined them already; only the links
    that joined something leave the task.
    """
    counts = members.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).where("n > 1")
    counts = stored(counts)
    total = counts.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    placed = members.join(counts.drop("n"), "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "sketch", "size", "shingles")
    met = met.withColumn("bucket", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(max(1, -(-int(total) // bucket)))))

    def run(pdf):
        import numpy as np
        import pandas as pd

        found = []
        for (_, i, j), part in pdf.groupby(["cluster", "i", "j"], sort=False):
            node, size = part["node"].to_numpy(), part["size"].to_numpy()
            sketches = np.frombuffer(b"".join(part["sketch"]), np.uint64).reshape(len(part), -1)
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            first = part["own"].to_numpy() == i
            left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if i < j else (np.arange(len(part)), np.arange(len(part)))
            if not len(left) or not len(right):
                continue
            d = np.bitwise_count(sketches[left][:, None] ^ sketches[right][None]).sum(axis=2, dtype=np.int64)
            near = (d <= limit) & (np.minimum(size[left][:, None], size[right][None]) >= similarity * np.maximum(size[left][:, None], size[right][None]))
            if i == j:
                near &= left[:, None] < right[None]
            a, b = np.nonzero(near)
            by = np.argsort(d[a, b], kind="stable")
            root = list(range(len(part)))

            def top(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for u, v in zip(left[a[by]].tolist(), right[b[by]].tolist()):
                x, y = top(u), top(v)
                if x != y and jaccard(sets[u], sets[v]) >= similarity:
                    root[max(x, y)] = min(x, y)
                    found.append((max(node[u], node[v]), min(node[u], node[v])))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return met.groupBy("bucket").applyInPandas(run, "u long, v long")


class Forest:
    """Least-index labels of the pairs joined so far, and the pairs that joined two labels."""

    def __init__(self, n: int):
        import numpy as np

        self.label = np.arange(n)
        self.joined: list = []

    def join(self, a, b) -> None:
        import numpy as np

        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            np.minimum.at(label, high, low)
            won = np.flatnonzero(label[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.joined.append((a[won], b[won]))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def trie_forest(values, starts, ends, bits: int, budget: int, near=None, leaf: int = 64, batch: int = 1 << 16, block: int = 400, label=None) -> Forest:
    """Joins all pairs of ``values`` inside each [start, end) run that differ in at most ``budget`` of the low ``bits`` bits.

    ``values`` is sorted inside a run.  Pairs of trie nodes are kept as index ranges with the bits in which
    they differ so far; small ones are compared value by value.  ``near(a, b)`` may reject pairs.
    Rows of one ``label`` (the least index of its rows) count as joined from the start.
    """
    import numpy as np

    forest = Forest(len(values))
    if label is not None:
        forest.label = label.copy()

    def link(a, b):
        ok = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (forest.label[a] != forest.label[b])
        a, b = a[ok], b[ok]
        if near is not None and len(a):
            ok = near(a, b)
            a, b = a[ok], b[ok]
        forest.join(a, b)

    def compare(a0, a1, b0, b1):
        # blocks of bounded size: equal values have no nodes below them, however many they are
        na, nb = -(-(a1 - a0) // block), -(-(b1 - b0) // block)
        which = np.repeat(np.arange(len(na)), na * nb)
        k = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x0, y0 = a0[which] + k // nb[which] * block, b0[which] + k % nb[which] * block
        a0, a1, b0, b1 = x0, np.minimum(x0 + block, a1[which]), y0, np.minimum(y0 + block, b1[which])
        once = b1 > a0  # of a node paired with itself one half is enough
        a0, a1, b0, b1 = a0[once], a1[once], b0[once], b1[once]
        nb = b1 - b0
        size = (a1 - a0) * nb
        for i in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // 200_000)) + 1):
            i = i[apart(a0[i], a1[i], b0[i], b1[i])]
            if not len(i):
                continue
            which = np.repeat(i, size[i])
            k = np.arange(len(which)) - np.repeat(np.cumsum(size[i]) - size[i], size[i])
            a, b = a0[which] + k // nb[which], b0[which] + k % nb[which]
            ok = (a < b) & (forest.label[a] != forest.label[b])
            link(a[ok], b[ok])

    def block_ends():
        """For each row the end of the run of rows, in order, that already have its label."""
        change = np.concatenate((np.flatnonzero(np.diff(forest.label)) + 1, [len(values)]))
        return change[np.searchsorted(change, np.arange(len(values)), side="right")]

    def apart(a0, a1, b0, b1):
        """Pairs of ranges of rows that do not all have one label already."""
        until = block_ends()
        return (forest.label[a0] != forest.label[b0]) | (until[a0] < a1) | (until[b0] < b1)

    starts, ends = np.asarray(starts), np.asarray(ends)
    if not len(starts):
        return forest
    # rows beside each other, and each row and its run's first: most links of a dense group, in linear time
    inside = np.concatenate([np.arange(s + 1, e) for s, e in zip(starts, ends, strict=True)])
    link(inside - 1, inside)
    link(np.repeat(starts, ends - starts - 1), inside)
    stack = [(starts, ends, starts, ends, np.zeros(len(starts), np.int64), bits - 1)]
    while stack:
        a0, a1, b0, b1, err, d = stack.pop()
        # pairs of nodes whose rows are all joined already have nothing to add
        open_ = apart(a0, a1, b0, b1)
        a0, a1, b0, b1, err = (x[open_] for x in (a0, a1, b0, b1, err))
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (d < 0)
        if small.any():
            compare(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if len(a0) > batch:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, err)) + (d,), tuple(x[half:] for x in (a0, a1, b0, b1, err)) + (d,)]
            continue
        bit = np.uint64(1) << np.uint64(d)

        def middle(lo, hi):
            """First index whose bit d is set: a binary search in all ranges at once."""
            lo, hi = lo.copy(), hi.copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                m = (lo + hi) // 2
                one = (values[np.minimum(m, len(values) - 1)] & bit) != 0
                hi = np.where(open_ & one, m, hi)
                lo = np.where(open_ & ~one, m + 1, lo)

        am = middle(a0, a1)
        same = a0 == b0
        bm = np.where(same, am, middle(b0, b1))
        pairs = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        cols = [[], [], [], [], []]
        for p0, p1, q0, q1, e, only in pairs:
            ok = (p0 < p1) & (q0 < q1) & (e <= budget)
            if only is not None:
                ok &= only
            for c, x in zip(cols, (p0, p1, q0, q1, e), strict=True):
                c.append(x[ok])
        stack.append(tuple(np.concatenate(c) for c in cols) + (d - 1,))
    return forest


def _deal(rows: DataFrame, bits: int, budget: int) -> DataFrame:
    """Each row once for each part of its bits below ``prefix``, that part turned to the top of them."""
    out = None
    rest = F.lit(bits) - F.col("prefix")
    for j in range(budget + 1):
        width = F.floor(rest / (budget + 1)).cast("int") + F.when(rest % (budget + 1) > j, 1).otherwise(0)
        skipped = F.floor(rest / (budget + 1)).cast("int") * j + F.least(F.lit(j), rest % (budget + 1))
        # shift counts are 1 to 64 in total; a mask of the low ``rest`` bits without overflow
        low = F.when(rest >= 64, F.lit(-1).cast("long")).otherwise(F.expr(f"shiftleft(1L, cast({bits} - prefix as int)) - 1L"))
        v = F.col("value")
        under = v.bitwiseAND(low)
        turned = F.when(skipped == 0, under).otherwise(F.call_function("shiftleft", under, skipped).bitwiseAND(low).bitwiseOR(F.call_function("shiftrightunsigned", under, rest - skipped)))
        one = rows.withColumn("next", v.bitwiseAND(F.bitwise_not(low)).bitwiseOR(turned)).withColumn("prefix", F.col("prefix") + width).withColumn("tag", F.col("tag") * (budget + 1) + j).withColumn("value", F.col("next")).drop("next")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("part", F.call_function("shiftrightunsigned", F.col("value"), F.lit(bits) - F.col("prefix")))


def hamming_forest(items: DataFrame, bits: int = 64, budget: int = 2, sketch_limit: int | None = None, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS, share: float = 0) -> DataFrame:
    """Edges (u, v) of a spanning forest of the links between rows (node long, tag long, value long[, sketch binary, size long, label long]) of one tag.

    Rows link if their values differ in at most ``budget`` of ``bits`` bits and, with a ``sketch_limit``, if their
    sketches differ in no more bits than that and the lesser size is at least ``share`` of the greater.  ``node`` is unique within a tag.  Every edge is such a link.  Rows of
    one ``label`` count as linked already.
    """
    rows = _deal(items.withColumn("prefix", F.lit(0)), bits, budget)
    ready, level = [], 0
    while True:
        sizes = rows.groupBy("tag", "prefix", "part").agg(F.count("*").alias("n"))
        hot = cut_lineage(sizes.where(F.col("n") > group_rows).select("tag", "prefix", "part"))
        # below 2 more bits for each part nothing is left to split by: equal values stay together
        n_hot = hot.count() if level < 3 else 0
        if not n_hot:
            ready.append(rows)
            break
        ready.append(rows.join(hot, ["tag", "prefix", "part"], "left_anti"))
        # stored, so that no level is derived again for the next one's counts
        rows = stored(_deal(rows.join(hot, ["tag", "prefix", "part"], "left_semi").drop("part"), bits, budget))
        level += 1
    dealt = ready[0]
    for r in ready[1:]:
        dealt = dealt.unionByName(r)
    buckets = max(1, -(-items.count() * (budget + 1) // bucket_rows))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("tag", "prefix", "part"), F.lit(buckets)))

    def link(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["tag", "prefix", "value", "node"], kind="stable")
        value = pdf["value"].to_numpy().view(np.uint64)
        node = pdf["node"].to_numpy()
        tag, prefix = pdf["tag"].to_numpy(), pdf["prefix"].to_numpy()
        part = pdf["part"].to_numpy()
        near, label = None, None
        if "label" in pdf:
            label = pd.DataFrame({"label": pdf["label"].to_numpy(), "at": np.arange(len(pdf))}).groupby("label")["at"].transform("min").to_numpy()
        if sketch_limit is not None:
            s = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)

            size = pdf["size"].to_numpy() if share else None

            def near(a, b):
                ok = np.bitwise_count(s[a] ^ s[b]).sum(axis=1, dtype=np.int64) <= sketch_limit
                if share:  # sets of too unequal size cannot be similar
                    ok &= np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b])
                return ok

        cut = np.flatnonzero((np.diff(tag) != 0) | (np.diff(prefix) != 0) | (np.diff(part) != 0)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(pdf)]))
        # the signed order of values equals the unsigned one inside a run but where the sign bit itself varies
        many = ends - starts > 1
        forest = trie_forest(value, starts[many], ends[many], bits - int(prefix.min()), budget, near, label=label)
        a, b = (node[np.concatenate([f[i] for f in forest.joined] or [np.empty(0, np.int64)])] for i in (0, 1))
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return dealt.groupBy("bucket").applyInPandas(link, "u long, v long").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots, root being the least node reachable.

    Rounds of large-star and small-star contraction until the edges stand still; each is a grouped
    least value and a join, so no neighbour list is ever gathered.
    """
    e = cut_lineage(edges.distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut_lineage(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct())


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) for every row of ``docs``.

    Null and empty texts and those without words have fingerprint 0 and link like others; texts of any length are
    read whole; repeated rows and null ids keep their own rows, and a component of null ids only has a null
    component_id; other columns are ignored; an empty table gives an empty result.
    """
    prints = cut_lineage(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = hamming_forest(nodes.select(F.col("fp").alias("node"), F.lit(0).cast("long").alias("tag"), F.col("fp").alias("value")), 64, budget)
    roots = components(edges)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(firsts, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Standard errors of a sketch's estimate by which a pair may miss the similarity and still be verified: 93 of 100 pairs at exactly 0.8 do.
MARGIN = 1.5


def near_copy_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and group_id (least doc_id of the group) of every document with words, grouped as ``leave_first_of_groups`` does."""
    rows, doc, tie = keyed(docs)
    grouped = _near_groups(rows.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), "text"), width, similarity)
    return grouped.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.nullif("first.doc", F.lit(NO_ID)).alias("group_id"))


def leave_first_of_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of an earlier one: the first of each group stays.

    Order is by ``doc_id``, null last, then by a hash of the text; rows equal in both stay or go together.  Null and empty
    texts and those without words stay.
    """
    rows, doc, tie = keyed(docs)
    grouped = _near_groups(rows.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), "text"), width, similarity)
    gone = grouped.where(F.struct("doc", "tie") != F.col("first")).select(F.col("doc").alias(doc), F.col("tie").alias(tie))
    return rows.join(gone, [doc, tie], "left_anti").select(*docs.columns)


def _near_groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc, tie and ``first``, the least (doc, tie) of the group: single linkage of sets of word shingles with a Jaccard similarity of ``similarity`` or more.

    SimHash sketches only propose pairs: the share of differing bits estimates the angle between two sets.  A trie
    join of the sketches' slices, which agree within a few bits, gathers sets whose sketches look similar enough, ``MARGIN``
    standard errors allowed, into clusters; it emits a forest of them, not their pairs.  Inside a cluster pairs count only if the sets themselves are
    similar enough.  Texts without words take no part.
    """
    import math

    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = SLICES * SLICE_BITS
    limit = math.ceil(share * bits + MARGIN * math.sqrt(share * (1 - share) * bits))
    worded = docs.where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) != "")
    sketched = cut_lineage(worded.select("doc", "tie", sketch(F.col("text"), width).alias("s")).select("doc", "tie", "s.sketch", "s.size", F.xxhash64("s.same").alias("node")))
    nodes = cut_lineage(sketched.groupBy("node").agg(F.min("sketch").alias("sketch"), F.min("size").alias("size")))
    digits = SLICE_BITS // 4
    text = F.hex("sketch")

    def slices(of: DataFrame) -> DataFrame:
        cut = F.array(*[F.conv(F.substring(text, 1 + i * digits, digits), 16, 10).cast("long") for i in range(SLICES)])
        return of.select("*", F.posexplode(cut).alias("tag", "value")).withColumn("tag", F.col("tag").cast("long"))

    forest = hamming_forest(slices(nodes), SLICE_BITS, SLICE_BUDGET, limit, share=similarity)
    loose = stored(components(forest))
    clusters = stored(loose.select("node", F.col("root").alias("cluster")).unionByName(loose.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()))
    # one text of each node in a cluster gives its set
    picked = sketched.join(clusters, "node").groupBy("node", "cluster").agg(F.min(F.struct("doc", "tie")).alias("first")).select("cluster", "first.*")
    texts = worded.join(picked, ["doc", "tie"]).select("cluster", shingle_set(F.col("text"), width).alias("s"))
    sets = texts.select("cluster", F.xxhash64("s.same").alias("node"), "s.shingles").dropDuplicates(["node"])
    members = stored(sets.join(nodes, "node").select("node", "cluster", "sketch", "size", "shingles"))
    roots = components(verified_links(members, similarity, limit))
    labelled = sketched.join(roots, "node", "left").select("doc", "tie", F.coalesce("root", "node").alias("label"))
    known = cut_lineage(labelled)
    return known.join(known.groupBy("label").agg(F.min(F.struct("doc", "tie")).alias("first")), "label").select("doc", "tie", "first")


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; nulls, empty and long texts, ties, repeats and empty tables as ``simhash_components`` says."""
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
