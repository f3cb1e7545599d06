"""Suffix arrays by induced sorting, and exact removal of repeated passages across documents.

Induced sorting: suffixes are classed as smaller (S) or larger (L) than their right
neighbour; the substrings between leftmost S suffixes are sorted and named, the string of
names is sorted recursively, and the whole array is induced from it in two linear scans.
The scans run bucket by bucket on arrays; recursion levels with many names run value by value.

Across documents, content-defined anchors decide what has to be compared: of the 28-byte
strings in each 100-byte window the one with the least hash is its anchor, so equal windows
have equal anchors.  Windows of consecutive starts with one anchor form a segment.  Segments
with equal bytes need no comparison beyond their hashes; differing segments around one anchor
value go, once each, to a shard whose suffix array and permuted common prefixes find the
windows that they share.  An anchor with very many differing segments is narrowed first: its
segments are halved by where the anchor lies in their windows and dealt by the longer context that
all windows of a half have in common, until the groups are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, keyed, new_name, stored, table

LENGTH = 100
ANCHOR = 28
#: Bytes of documents hashed at a time, and of segments in one shard.
CHUNK, SHARD_BYTES = 1 << 19, 1 << 19
#: Differing segments of one anchor or context that meet in one shard; more are narrowed.
ANCHOR_SEGMENTS = 20_000
#: A segment with over this share of all occurrences meets its first one by a broadcast of at most as many rows.
HOT_SHARE = 50_000


def _types(s):
    """True where the suffix is smaller than its right neighbour; the last one (the sentinel) is."""
    import numpy as np

    n = len(s)
    sign = np.empty(n, np.int8)
    sign[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    sign[-1] = 1
    known = np.where(sign != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    return sign[nearest] > 0


def _induce(s, small, lms_order, sigma: int):
    """Suffix array with all other suffixes induced from the order of the leftmost S suffixes."""
    import numpy as np

    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    end = np.cumsum(counts)
    start = end - counts
    sa = np.full(n, -1, np.int64)
    # leftmost S suffixes at the ends of their buckets
    c = s[lms_order]
    per = np.bincount(c, minlength=sigma)
    by = np.argsort(c, kind="stable")
    base = end - per
    sa[base[c[by]] + np.arange(len(by)) - (np.cumsum(per) - per)[c[by]]] = lms_order[by]

    def put(items, fill, step):
        """Writes items into their buckets, in order, from ``fill`` on (step 1) or before it (step -1)."""
        ch = s[items]
        by = np.argsort(ch, kind="stable")
        items, ch = items[by], ch[by]
        first = np.concatenate(([True], ch[1:] != ch[:-1]))
        at = np.flatnonzero(first)
        rank = np.arange(len(ch)) - np.repeat(at, np.diff(np.concatenate((at, [len(ch)]))))
        sa[fill[ch] + rank if step > 0 else fill[ch] - 1 - rank] = items
        fill[ch[at]] += step * np.diff(np.concatenate((at, [len(ch)])))

    buckets = np.flatnonzero(counts)
    head = start.copy()
    for b in buckets:
        done = start[b]
        while done < head[b]:  # larger suffixes of this bucket, also those that it adds to itself
            items, done = sa[done : head[b]], head[b]
            left = items[items > 0] - 1
            left = left[~small[left]]
            if len(left):
                put(left, head, 1)
        if per[b]:
            left = sa[base[b] : end[b]] - 1
            left = left[left >= 0]
            left = left[~small[left]]
            if len(left):
                put(left, head, 1)
    tail = end.copy()
    for b in buckets[::-1]:
        done = end[b]
        while True:  # smaller suffixes, from the end; they overwrite the leftmost ones put there at first
            if done > tail[b]:
                items, done = sa[tail[b] : done][::-1], tail[b]
                left = items[items > 0] - 1
                left = left[small[left]]
                if len(left):
                    put(left, tail, -1)
            else:
                break
        items = sa[start[b] : head[b]][::-1]
        left = items[items > 0] - 1
        left = left[small[left]]
        if len(left):
            put(left, tail, -1)
    sa[0] = n - 1
    return sa


def _induce_by_value(s, small, lms_order, sigma: int):
    """The same scans one suffix at a time, for alphabets with too many buckets to treat as arrays."""
    import numpy as np

    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    end = np.cumsum(counts).tolist()
    head = (np.cumsum(counts) - counts).tolist()
    t, typ = s.tolist(), small.tolist()
    sa = [-1] * n
    tail = end[:]
    for i in lms_order.tolist()[::-1]:
        tail[t[i]] -= 1
        sa[tail[t[i]]] = i
    for k in range(n):
        j = sa[k] - 1
        if j >= 0 and not typ[j]:
            c = t[j]
            sa[head[c]] = j
            head[c] += 1
    tail = end
    for k in range(n - 1, -1, -1):
        j = sa[k] - 1
        if j >= 0 and typ[j]:
            c = t[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(s, sigma: int | None = None):
    """Suffix array of an integer array that ends in its only, smallest value 0."""
    import numpy as np

    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    sigma = int(s.max()) + 1 if sigma is None else sigma
    induce = _induce if sigma <= 2048 and n >= 2048 else _induce_by_value
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(s, small, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: equal neighbours in this order are equal substrings up to the next leftmost S suffix
    nxt = np.full(n, n - 1)
    nxt[lms[:-1]] = lms[1:]
    length = nxt - np.arange(n) + 1
    a, b = order[:-1], order[1:]
    differ = length[a] != length[b]
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):
        open_ = open_[length[a[open_]] > k]
        unequal = s[a[open_] + k] != s[b[open_] + k]
        differ[open_[unequal]] = True
        open_ = open_[~unequal]
        k += 1
    names = np.concatenate(([0], np.cumsum(differ)))
    if names[-1] + 1 < len(lms):
        name_of = np.empty(n, np.int64)
        name_of[order] = names
        order = lms[suffix_array(name_of[lms], int(names[-1]) + 1)]
    return induce(s, small, order, sigma)


def permuted_lcp(s, sa, cap: int, stride: int = 16):
    """Common prefix, up to ``cap``, of each suffix with its predecessor in the array, in text order.

    A suffix shares at most one character less with its predecessor than the suffix before it in the text.
    So every ``stride``-th prefix is measured from nothing and gives a lower bound from which those behind it go on;
    four characters are compared at a time, for all open suffixes at once.
    """
    import numpy as np

    n = len(s)
    prev = np.full(n, n - 1)
    prev[sa[1:]] = sa[:-1]
    padded = np.concatenate((s.astype(np.uint64), np.zeros(cap + 8, np.uint64)))
    words = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    length = np.zeros(n, np.int64)

    def extend(i):
        while len(i):
            x = words[i + length[i]] ^ words[prev[i] + length[i]]
            same = x == 0
            length[i] += np.where(same, 4, np.bitwise_count((x & -x) - np.uint64(1)) >> 4)
            i = i[same & (length[i] < cap)]

    start = int(sa[0])
    at = np.arange(n)
    rest = at[(at % stride != 0) & (at != start)]
    extend(at[(at % stride == 0) & (at != start)])
    np.minimum(length, cap, out=length)
    length[rest] = np.maximum(length[rest - rest % stride] - rest % stride, 0)
    extend(rest)
    return np.minimum(length, cap)


def repeated_windows(parts: list[bytes], order, length: int = LENGTH):
    """(part, offset) of every ``length``-byte window that also occurs at a smaller place in these parts.

    ``order``: columns (document, ..., start) of the parts, the most significant first.
    """
    import numpy as np

    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    s = np.concatenate((text, [0]))
    sa = suffix_array(s, 258)
    lcp = permuted_lcp(s, sa, length)[sa]
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(text)) - np.repeat(ends - sizes, sizes + 1)
    valid = np.concatenate((offset + length <= sizes[part], [False]))
    group = np.cumsum(lcp < length)
    at = np.flatnonzero(valid[sa])
    pos, group = sa[at], group[at]
    *docs, starts = (np.asarray(c) for c in order)
    by = np.lexsort((starts[part[pos]] + offset[pos], *(c[part[pos]] for c in docs[::-1]), group))
    pos, group = pos[by], group[by]
    p = pos[np.concatenate(([False], group[1:] == group[:-1]))]
    return part[p], offset[p]


def _anchor_hashes(data, anchor: int):
    """Hashes of all strings of ``anchor`` bytes, and keys whose least is the anchor of a window: least hash, leftmost among equals."""
    import numpy as np

    h, hashes, width = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), {}, 1
    h ^= h >> np.uint64(31)
    hashes[1] = h
    while width * 2 <= anchor:
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + h[width:]
        width *= 2
        hashes[width] = h
    have = width
    for part in sorted((k for k in hashes if k < width), reverse=True):
        if have + part <= anchor:
            m = min(len(h), len(hashes[part]) - have)
            h = h[:m] * np.uint64(0xA0761D6478BD642F + 2 * part) + hashes[part][have : have + m]
            have += part
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    # the low bits hold the position
    return h, (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)


def anchored_segments(data, bounds, length: int = LENGTH, anchor: int = ANCHOR):
    """Segments of a byte array that holds documents at ``bounds``: arrays (first window, last window, anchor hash)."""
    import numpy as np

    n, w = len(data), length - anchor + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, np.empty(0, np.uint64)
    h, m = _anchor_hashes(data, anchor)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (w - span)], m[w - span :]) if w > span else m
    at = (m & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int64)
    lo, hi = bounds[:-1], bounds[1:] - length + 1
    ok = hi > lo
    np.add.at(valid, lo[ok], 1)
    np.add.at(valid, hi[ok], -1)
    v = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(v):
        return empty, empty, np.empty(0, np.uint64)
    new = np.concatenate(([True], (np.diff(v) != 1) | (np.diff(at[v]) != 0)))
    new |= np.isin(v, lo)  # a document that begins right where the last window before it ended
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(v) - 1]))
    return v[first], v[last], h[at[v[first]]]


def _chunks(batches, limit: int, length: int):
    """(ids and ties, first byte of each piece in its document, bytes, bounds): whole documents up to ``limit`` bytes, longer ones in overlapping pieces."""
    import numpy as np

    ids, firsts, parts, size = [], [], [], 0

    def flush():
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return np.array(ids, np.int64).reshape(-1, 2), np.array(firsts, np.int64), np.frombuffer(b"".join(parts), np.uint8), bounds

    for batch in batches:
        for doc, tie, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if text is None or len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, limit):
                piece = text[at : at + limit + length - 1]
                ids.append((doc, tie))
                firsts.append(at)
                parts.append(piece)
                size += len(piece)
                if size >= limit:
                    yield flush()
                    ids, firsts, parts, size = [], [], [], 0
    if parts:
        yield flush()


def _segments(bodies: DataFrame, length: int, anchor: int, full: bool) -> DataFrame:
    """full: (h, s, doc, tie, lo, n) of every segment, h and s being hashes of anchor and bytes; else (h, c), counts of anchors by chunk."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for ids, firsts, data, bounds in _chunks(batches, CHUNK, length):
            first, last, h = anchored_segments(data, bounds, length, anchor)
            if not len(first):
                continue
            if not full:
                h, c = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])
                continue
            view = memoryview(data)
            s = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
            of = np.searchsorted(bounds, first, side="right") - 1
            columns = [h.view(np.int64), s.view(np.int64), ids[of, 0], ids[of, 1], first - bounds[of] + firsts[of], (last - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "s", "doc", "tie", "lo", "n"])

    return bodies.mapInArrow(run, "h long, s long, doc long, tie long, lo long, n int" if full else "h long, c long")


SPAN = "doc long, tie long, start long, end long"
PLACE = ["doc", "tie", "lo"]


def repeated_spans(bodies: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """(doc, tie, start, end) byte spans, possibly overlapping, that windows of ``length`` bytes cover which also start earlier, from (doc, tie, body)."""
    # stored, so that the join deals out both its sides and can split an anchor with very many segments
    often = stored(_segments(bodies, length, anchor, False).groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"))
    segments = stored(_segments(bodies, length, anchor, True).join(often, "h", "left_semi"))
    kinds = stored(segments.groupBy("h", "s").agg(F.min(F.struct(*PLACE)).alias("rep"), F.max("n").alias("n"), F.count("*").alias("c")))

    # equal segments: all but the first occurrence go as a whole.  The most common ones, few by their very share, are
    # sent to the segments; the others meet them in a join in which no key has many rows.
    occurrences = kinds.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    several = kinds.where("c > 1").select("h", "s", "rep", "c")
    hot = F.col("c") * HOT_SHARE > int(occurrences)
    common, rare = (several.where(x).drop("c") for x in (hot, ~hot))
    equal = segments.join(F.broadcast(common), ["h", "s"]).unionByName(segments.join(F.broadcast(common), ["h", "s"], "left_anti").join(rare, ["h", "s"]))
    equal = equal.where(F.struct(*PLACE) != F.col("rep")).select("doc", "tie", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + length).alias("end"))

    # differing segments around one anchor value: one of each is compared
    crowd = kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    rivals = stored(kinds.join(crowd, "h").select("h", "k", "rep.*", "n"))
    total, most = rivals.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    if not total:
        return equal
    wanted = rivals.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "k", "lo", "n")).alias("at"))
    bytes_of = F.expr(f"substring(body, cast(x.lo + 1 as int), x.n + {length})")
    held = wanted.join(bodies, ["doc", "tie"]).select("doc", "tie", "body", F.explode("at").alias("x"))
    dealt = held.select(F.col("x.h").alias("key"), "x.k", "doc", "tie", "x.lo", bytes_of.alias("part"))
    equals, small = None, dealt.drop("k")
    if most > anchor_segments:
        narrow, equals = _narrowed(dealt.where(F.col("k") > anchor_segments).drop("k"), length, anchor, anchor_segments)
        small = dealt.where(F.col("k") <= anchor_segments).drop("k").unionByName(narrow)
    shards = max(1, -(-int(total) // shard_bytes))

    def compare(pdf):
        import numpy as np
        import pandas as pd

        # a repeated row brings its segments again
        pdf = pdf.drop_duplicates(["key", *PLACE])
        doc, tie, lo = (pdf[c].to_numpy() for c in PLACE)
        part, offset = repeated_windows(pdf["part"].tolist(), (doc, tie, lo), length)
        by = np.lexsort((offset, part))
        part, offset = part[by], offset[by]
        if not len(part):
            return pd.DataFrame({c: [] for c in ("doc", "tie", "start", "end")})
        first = np.flatnonzero(np.concatenate(([True], (np.diff(part) != 0) | (np.diff(offset) != 1))))
        last = np.concatenate((first[1:] - 1, [len(part) - 1]))
        return pd.DataFrame({"doc": doc[part[first]], "tie": tie[part[first]], "start": lo[part[first]] + offset[first], "end": lo[part[last]] + offset[last] + length})

    spans = equal.unionByName(small.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(compare, SPAN))
    return spans if equals is None else spans.unionByName(equals)


def _narrowed(parts: DataFrame, length: int, anchor: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Splits the segments (key, doc, tie, lo, part) of very common anchors into groups of at most ``limit``; also the spans of windows too common for that.

    A window's anchor lies 0 to ``length - anchor`` bytes after its start.  Each round halves that range: a segment's windows of
    one half share the bytes around the anchor that all of them cover, and these become the new key.  Equal windows
    have equal anchors at equal places, so they stay together.  At the end a key is one window; its occurrences are equal
    and need no comparison but that of their places.
    """
    row = "key long, p0 int, p1 int, at int, doc long, tie long, lo long, part binary"

    def find(pdfs):
        import numpy as np

        for pdf in pdfs:
            # the anchor of a segment's first window is that of all
            at = [int(np.argmin(_anchor_hashes(np.frombuffer(b, np.uint8)[:length], anchor)[1])) for b in pdf["part"]]
            yield pdf.assign(p0=0, p1=length - anchor, at=at)[["key", "p0", "p1", "at", *PLACE, "part"]]

    def halve(pdfs):
        import pandas as pd
        import xxhash

        for pdf in pdfs:
            out = []
            for key, p0, p1, at, doc, tie, lo, part in pdf.itertuples(index=False, name=None):
                mid = (p0 + p1) // 2
                for a, e in ((p0, mid), (mid + 1, p1)):
                    # windows that start ``p`` bytes before the anchor, a <= p <= e, and lie in the part
                    lo_p, hi_p = max(a, at + length - len(part)), min(e, at)
                    if lo_p > hi_p:
                        continue
                    context = part[max(at - a, 0) : at + length - e]
                    new = xxhash.xxh3_64_intdigest(context, seed=(key ^ a * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                    out.append((new - (1 << 64) if new >> 63 else new, a, e, hi_p, doc, tie, lo + at - hi_p, part[at - hi_p : at - lo_p + length]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in row.split(", ")])

    found, crowded = [], parts.mapInPandas(find, row)
    width = length - anchor + 1
    while True:
        rows = stored(crowded.mapInPandas(halve, row))
        width = (width + 1) // 2
        many = stored(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key"))
        found.append(rows.join(many, "key", "left_anti").select("key", *PLACE, "part"))
        crowded = rows.join(many, "key", "left_semi")
        if width == 1 or not many.limit(1).count():
            break
    small = found[0]
    for f in found[1:]:
        small = small.unionByName(f)
    place = F.struct(*PLACE)
    windows = crowded.select(F.md5("part").alias("w"), place.alias("place"))
    first = windows.groupBy("w").agg(F.min("place").alias("rep"))
    later = windows.join(first, "w").where("place <> rep").select("place.*")
    return small, later.select("doc", "tie", F.col("lo").alias("start"), (F.col("lo") + length).alias("end"))


REMOVED = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary>"


def cut_spans(body, spans):
    """struct<n_bytes, n_removed, n_spans, kept> of a binary column without an array of (start, end) spans; null body counts as empty."""

    @F.pandas_udf(REMOVED)
    def run(bodies, places):
        import pandas as pd

        out = []
        for b, at in zip(bodies, places, strict=True):
            b, runs = b or b"", []
            for x in sorted((x["start"], x["end"]) for x in at) if at is not None and len(at) else ():
                if runs and x[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x[1])
                else:
                    runs.append([x[0], x[1]])
            kept, done = [], 0
            for a, e in runs:
                kept.append(b[done:a])
                done = e
            kept.append(b[done:])
            kept = b"".join(kept)
            out.append((len(b), len(b) - len(kept), len(runs), kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return run(body, spans)


def remove_repeats(docs: DataFrame, out: str = "repeat", **settings) -> DataFrame:
    """All rows and columns of ``docs`` plus struct<n_bytes, n_removed, n_spans, kept> in column ``out``, which must be new.

    Documents are ordered by ``doc_id``, null last.  Rows of one id (or none) with different texts are different documents, in
    order of a hash of the text; rows equal in id and text are one document, which does not repeat itself.
    Null texts count as empty, texts of fewer than ``length`` bytes stay whole, longer ones of any size are read whole;
    an empty table gives an empty result.  What is gathered for a document is bounded by its own text.
    """
    new_name(docs, out)
    rows, doc, tie = keyed(docs)
    bodies = rows.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), F.col("text").cast("binary").alias("body"))
    found = repeated_spans(bodies, **settings).groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    a, b, spans = (free_name(rows, c) for c in ("span_doc", "span_tie", "spans"))
    joined = rows.join(found.toDF(a, b, spans), (F.col(doc) == F.col(a)) & (F.col(tie) == F.col(b)), "left")
    return joined.withColumn(out, cut_spans(F.col("text").cast("binary"), F.col(spans))).drop(a, b, spans, doc, tie)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; nulls, empty and long texts, ties, repeated rows, empty tables as ``remove_repeats`` says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "repeat.n_bytes", "repeat.n_removed", "repeat.n_spans", F.sha2("repeat.kept", 256).alias("kept_sha256"))
