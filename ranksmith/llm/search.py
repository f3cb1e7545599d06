"""Exact top-k inner products by a dual-tree search over cover trees.

Every vector becomes integers floor(256 * x).  A bounded sample of rows serves as the top level of one
cover tree over all data: each row goes to the block of its nearest pivot, and a block's covering radius is measured.
Queries form blocks in the same way.  Each query block first searches the data block around its own pivot, which gives
every query a k-th score; then query blocks meet only those data blocks whose best possible inner product
reaches the worst k-th score of the block's queries.  Inside a pair of blocks both sides get cover trees, and
the walk goes over pairs of their nodes under the same bound.

Blocks are cut to a fixed number of rows, so no task and no group grows with the data.  Of equal vectors only the k + 1
least ids can be among anyone's k best, and equal queries share one search, so a very common vector costs no more than a rare one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import stored, table

K, SCALE = 5, 256
#: Most queries that meet a data block at a time, and rows of a data block, on average.
QUERY_ROWS, TREE_ROWS = 2048, 8192
#: Rows of a leaf of the query trees and of the data trees.
QUERY_LEAF, LEAF = 4, 16
#: Rows drawn as pivots, at most.
PIVOTS = 256


class CoverTree:
    """Levels of centres chosen farthest first: the rows of a node lie within its radius of its centre, and the centres of
    its children lie further apart than the greatest distance left to the nearest of them.

    A level halves the radius, or comes as near to that as four times the square root of the node's rows allows in centres.
    ``points`` and ``ids`` are put in the tree's order, in which each node's rows are one range.
    """

    def __init__(self, points, ids, leaf: int = LEAF):
        import numpy as np

        self.radius, self.start, self.end, self.first, self.count = [], [], [], [], []
        centres, order = [], np.arange(len(points))
        norms = np.einsum("ij,ij->i", points, points)

        def distance(rows, c):
            d = norms[rows] + norms[c] - 2.0 * (points[rows] @ points[c])
            return np.sqrt(np.maximum(d, 0.0))

        def add(a, e, c, d):
            self.radius.append(float(d.max()))
            self.start.append(a)
            self.end.append(e)
            self.first.append(0)
            self.count.append(0)
            centres.append(c)
            todo.append((len(centres) - 1, d))

        todo: list = []
        if len(points):
            add(0, len(points), 0, distance(order, 0))
        while todo:
            me, d = todo.pop()
            a, e = self.start[me], self.end[me]
            if e - a <= leaf or self.radius[me] == 0:
                continue
            rows, cover, most = order[a:e].copy(), self.radius[me] / 2, 4 * int((e - a) ** 0.5)
            near, owner, chosen = d.copy(), np.zeros(e - a, np.int64), [centres[me]]
            while near.max() > cover and len(chosen) < most:
                far = int(near.argmax())
                new = distance(rows, rows[far])
                new[far] = 0.0
                closer = new < near
                near[closer], owner[closer] = new[closer], len(chosen)
                chosen.append(int(rows[far]))
            by = np.argsort(owner, kind="stable")
            order[a:e], near, owner = rows[by], near[by], owner[by]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [e - a]))
            self.first[me], self.count[me] = len(centres), len(cut) - 1
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                add(a + i, a + j, chosen[int(owner[i])], near[i:j])
        self.centres = points[centres] if centres else points[:0]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        self.points, self.ids = points[order], ids[order]
        for name in ("radius", "start", "end", "first", "count"):
            setattr(self, name, np.array(getattr(self, name)))


def best_possible(centre_product, q_radius, q_norm, d_radius, d_norm):
    """The greatest inner product that two balls allow, with room for rounding."""
    return (centre_product + q_radius * d_norm + d_radius * q_norm + q_radius * d_radius) * (1 + 1e-9) + 1e-3


def dual_tree_topk(queries: CoverTree, data: CoverTree, best_score, best_id, k: int, batch: int = 1 << 15, step: int = 32) -> int:
    """Merges ``data`` into the k best of every query, in the order of ``queries``: arrays best_score and best_id (queries x k), best first.

    Ties go to the smaller id, so a pair of nodes is kept when its bound equals the worst k-th score of the node's
    queries.  Returns the number of pairs of rows that were scored.
    """
    import numpy as np

    if not len(queries.points) or not len(data.points):
        return 0
    scored = 0
    spans = np.column_stack([queries.start, queries.end]).ravel()

    def worst():
        """For each query node the least k-th score among its rows."""
        kth = np.append(best_score[:, k - 1], np.inf)
        return np.minimum.reduceat(kth, spans)[::2]

    def bounds(q, d):
        products = np.einsum("ij,ij->i", queries.centres[q], data.centres[d])
        return best_possible(products, queries.radius[q], queries.norm[q], data.radius[d], data.norm[d])

    def base(q: int, leaves) -> None:
        nonlocal scored
        a, e = queries.start[q], queries.end[q]
        rows = np.concatenate([np.arange(data.start[d], data.end[d]) for d in leaves])
        scores = queries.points[a:e] @ data.points[rows].T
        scored += scores.size
        some = np.flatnonzero((scores >= best_score[a:e, k - 1][:, None]).any(axis=0))
        if not len(some):
            return
        all_scores = np.concatenate((best_score[a:e], scores[:, some]), axis=1)
        all_ids = np.concatenate((best_id[a:e], np.broadcast_to(data.ids[rows[some]], (e - a, len(some)))), axis=1)
        by = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best_score[a:e], best_id[a:e] = np.take_along_axis(all_scores, by, 1), np.take_along_axis(all_ids, by, 1)

    def children(tree: CoverTree, nodes):
        """Position in ``nodes`` and node of all their children."""
        n = tree.count[nodes]
        which = np.repeat(np.arange(len(nodes)), n)
        return which, tree.first[nodes][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)

    # every leaf of queries goes down to the most promising leaf of data first: that gives k-th scores to prune by
    leaves = np.flatnonzero(queries.count == 0)
    at = np.zeros(len(leaves), np.int64)
    while True:
        inner = np.flatnonzero(data.count[at] > 0)
        if not len(inner):
            break
        which, kids = children(data, at[inner])
        value = bounds(leaves[inner][which], kids)
        by = np.lexsort((value, which))
        last = np.append(np.flatnonzero(np.diff(which[by])), len(by) - 1)
        at[inner] = kids[by[last]]
    for q, d in zip(leaves.tolist(), at.tolist(), strict=True):
        base(q, [d])
    seen = dict(zip(leaves.tolist(), at.tolist(), strict=True))

    found = []
    low = worst()
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        q, d = stack.pop()
        if len(q) > batch:
            half = len(q) // 2
            stack += [(q[:half], d[:half]), (q[half:], d[half:])]
            continue
        value = bounds(q, d)
        keep = value >= low[q]
        q, d, value = q[keep], d[keep], value[keep]
        q_leaf, d_leaf = queries.count[q] == 0, data.count[d] == 0
        end = q_leaf & d_leaf
        found.append((q[end], d[end], value[end]))
        down = ~end & (q_leaf | ~d_leaf & (data.radius[d] >= queries.radius[q]))
        side = ~end & ~down
        for part, tree, nodes in ((down, data, d), (side, queries, q)):
            if part.any():
                which, kids = children(tree, nodes[part])
                stack.append((q[part][which], kids) if tree is data else (kids, d[part][which]))
    q, d, value = (np.concatenate([f[i] for f in found]) for i in range(3))
    by = np.lexsort((-value, q))
    q, d, value = q[by], d[by], value[by]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1, [len(q)])) if len(q) else np.zeros(1, np.int64)
    for a, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        node = int(q[a])
        rows = slice(queries.start[node], queries.end[node])
        for i in range(a, e, step):  # the best bounds first, so most leaves are met by a better k-th score
            part = slice(i, min(i + step, e))
            open_ = d[part][(value[part] >= best_score[rows, k - 1].min()) & (d[part] != seen[node])]
            if not len(open_):
                if value[i] < best_score[rows, k - 1].min():
                    break
                continue
            base(node, open_.tolist())
    return scored


def quantised(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows whose vector is whole and finite, as arrays of longs floor(scale * x); the rest take no part."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).withColumn(vector, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def _placed(rows: DataFrame, pivots: dict) -> DataFrame:
    """``rows`` (id, v) with dim, pivot (of those of its length the nearest) and distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            flat, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
            start = np.concatenate(([0], np.cumsum(size)))
            pivot, distance = np.zeros(len(size), np.int32), np.zeros(len(size))
            for dim in np.unique(size).tolist():
                mine = np.flatnonzero(size == dim)
                x = flat[(start[mine][:, None] + np.arange(dim)[None, :])]
                p = sent.value[dim]
                square = (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
                pivot[mine] = square.argmin(axis=1)
                diff = x - p[pivot[mine]]
                distance[mine] = np.sqrt((diff * diff).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(pivot), pa.array(distance)], names=["id", "v", "dim", "pivot", "distance"])

    return rows.mapInArrow(run, "id long, v array<long>, dim int, pivot int, distance double")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = K, query_rows: int = QUERY_ROWS, tree_rows: int = TREE_ROWS, pivots: int = PIVOTS, pairs=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` greatest inner products over all other rows, ties to the smaller id.

    Vectors of unequal length are compared in their own length only.  Of rows with one id the one with the greatest vector counts;
    rows of a null id, null vectors and vectors with null or non-finite components take no part; other columns are
    ignored; an empty table gives an empty result.  Only ``pivots`` rows of each length reach the driver.
    ``pairs``: an accumulator for the number of pairs of rows that are scored.
    """
    import numpy as np
    import pyarrow as pa

    query = F.coalesce(is_query, F.lit(False))
    ready = quantised(vectors.select(F.col(id_col).cast("long").alias("id"), query.alias("is_query"), F.col(vector).alias("v")), "v").where(F.col("id").isNotNull())
    ready = stored(ready.groupBy("id").agg(F.max("is_query").alias("is_query"), F.max("v").alias("v")))
    same = W.partitionBy("v").orderBy("id")
    offered = ready.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("id", "v")
    asked = ready.where("is_query").groupBy("v").agg(F.min("id").alias("id")).select("id", "v")

    draw = W.partitionBy(F.size("v")).orderBy(F.xxhash64(F.lit("pivot"), "id"), "id")
    drawn: dict = {}
    # no more pivots than there are blocks to fill
    pivots = max(1, min(pivots, -(-ready.count() // tree_rows)))
    for r in ready.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= pivots).select("id", "v").orderBy("id").collect():
        drawn.setdefault(len(r.v), []).append(r.v)
    drawn = {dim: np.array(v, np.float64).reshape(len(v), dim) for dim, v in drawn.items()}
    queries, data = (_blocks(stored(_placed(rows, drawn)), size, of) for rows, size, of in ((asked, query_rows, "q"), (offered, tree_rows, "d")))

    q_key, d_key = ["dim", "q_pivot", "q_part"], ["dim", "d_pivot", "d_part"]
    # the first meeting: each query block with one data block around the same pivot
    home = queries.select(*q_key, F.col("q_pivot").alias("d_pivot"), F.lit(0).alias("d_part"), F.col("q_part").alias("chunk"), "id", "v", F.lit(None).cast("double").alias("kth"))
    near = stored(_searched(home, data, k + 1, d_key, pairs))
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") > k)
    queries = stored(queries.join(kth, F.col("id") == F.col("query_id"), "left").select(*q_key, "id", "v", "distance", F.col("low").cast("double").alias("kth")))
    q_blocks = queries.groupBy(*q_key).agg(F.max("distance").alias("q_radius"), F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("low"), F.count("*").alias("n"))
    d_blocks = data.groupBy(*d_key).agg(F.max("distance").alias("d_radius"))
    columns: dict = {c: [] for c in ("dim", "q_pivot", "d_pivot", "product", "q_norm", "d_norm")}
    for dim, v in drawn.items():
        n, norm = len(v), np.sqrt((v * v).sum(1))
        for c, x in zip(columns, (np.full(n * n, dim, np.int32), np.repeat(np.arange(n, dtype=np.int32), n), np.tile(np.arange(n, dtype=np.int32), n), (v @ v.T).ravel(), np.repeat(norm, n), np.tile(norm, n)), strict=True):
            columns[c].append(x)
    if not drawn:
        return near.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    products = vectors.sparkSession.createDataFrame(pa.table({c: np.concatenate(x) for c, x in columns.items()}))
    meet = stored(_meetings(q_blocks, d_blocks, products, query_rows))
    far = _searched(queries.join(meet, q_key).select(*d_key, "chunk", "id", "v", "kth"), data, k + 1, d_key, pairs)

    every = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = near.unionByName(far).withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k + 1).select(F.col("query_id").alias("id"), "vec_id", "score")
    # each query takes its vector's results but for itself
    members = ready.where("is_query").select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", "id")
    out = members.join(best, "id").where("vec_id <> query_id").withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(placed: DataFrame, size: int, side: str) -> DataFrame:
    """Rows with ``<side>_pivot`` and ``<side>_part``: a pivot with many rows has several blocks.  The counts are one row for each pivot."""
    counts = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(side), "id"), F.col("parts")).cast("int")
    return placed.join(F.broadcast(counts), ["dim", "pivot"]).select("dim", F.col("pivot").alias(f"{side}_pivot"), part.alias(f"{side}_part"), "id", "v", "distance")


def _meetings(q_blocks: DataFrame, d_blocks: DataFrame, products: DataFrame, query_rows: int) -> DataFrame:
    """Pairs of blocks that the bound leaves, but for those that have met, and ``chunk``: the query blocks of one data block come in chunks.

    Pivots are compared first, by the greatest radius around each, then the blocks around them.
    """
    bound = best_possible(F.col("product"), F.col("q_radius"), F.col("q_norm"), F.col("d_radius"), F.col("d_norm"))
    widest = d_blocks.groupBy("dim", "d_pivot").agg(F.max("d_radius").alias("d_radius"))
    left = q_blocks.join(F.broadcast(products), ["dim", "q_pivot"]).join(F.broadcast(widest), ["dim", "d_pivot"]).where(bound >= F.col("low")).drop("d_radius")
    met = (F.col("q_pivot") == F.col("d_pivot")) & (F.col("d_part") == 0)
    pairs = left.join(d_blocks, ["dim", "d_pivot"]).where((bound >= F.col("low")) & ~met)
    upto = W.partitionBy("dim", "d_pivot", "d_part").orderBy("q_pivot", "q_part").rowsBetween(W.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / query_rows).cast("int")
    return pairs.select("dim", "q_pivot", "q_part", "d_pivot", "d_part", chunk.alias("chunk"))


def _searched(asked: DataFrame, data: DataFrame, k: int, key: list[str], pairs) -> DataFrame:
    """Each query's k best of the data blocks that it meets: both sides of a meeting get their cover trees, then the walk."""

    def run(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, d = (CoverTree(np.stack(side["v"].to_list()).astype(np.float64), side["id"].to_numpy(), leaf) for side, leaf in ((left, QUERY_LEAF), (right, LEAF)))
        none = np.iinfo(np.int64).max
        score, near = np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), none)
        # a known k-th score, less a half so that equal ones with smaller ids come through, stands for k rows without ids
        known = left.set_index("id")["kth"].reindex(q.ids).to_numpy(dtype=np.float64)
        score[:] = np.where(np.isnan(known), -np.inf, known - 0.5)[:, None]
        n = dual_tree_topk(q, d, score, near, k)
        if pairs is not None:
            pairs.add(n)
        there = near < none
        ids = np.repeat(q.ids, k).reshape(score.shape)
        return pd.DataFrame({"query_id": ids[there], "vec_id": near[there], "score": score[there].astype(np.int64)})

    key = [*key, "chunk"]
    wanted = asked.select(*key).distinct().toDF(*(f"w_{c}" for c in key))
    offered = data.join(wanted, [F.col(c) == F.col(f"w_{c}") for c in key[:-1]]).select(*(F.col(f"w_{c}").alias(c) for c in key), "id", "v")
    return asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50; nulls, repeats, ties and empty tables as ``top_k`` says."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
