"""Exact top-k search by inner product with M-trees.

The vectors are dealt into shards of a bounded size; each shard is bulk-loaded into an M-tree of
paged nodes whose entries hold a pivot, a covering radius, the distance to the parent's pivot, the
largest norm and the smallest id below. A query descends best-first by an upper bound of the inner
product, which follows from the Euclidean metric: <q,y> = (|q|^2 + |y|^2 - d(q,y)^2) / 2, and
d(q,y) >= d(q,p) - r for all y within r of the pivot p. The stored parent distances bound d(q,p)
from below before it is computed. Each shard gives its k best for each query, and the k best of
these are the result, so it is exact.

Queries are dealt out in blocks of a bounded size as well. Vectors that are null or empty, or hold
null or non-finite components, take no part; vectors meet only those of the same length. Ties go
to the smaller id. A query's own row is left out by its id, and so are other rows with that id.
Components beyond 2**31 after scaling are outside the operator's range. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE, FANOUT = 192, 16


@dataclass
class Node:
    """rows: pivots of the children, or the vectors of a leaf (children is None). apart: distances to this node's pivot."""

    rows: np.ndarray
    apart: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    least: np.ndarray
    children: list[Node] | None = None


def build(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, pivot: np.ndarray) -> Node:
    """x: float vectors; norms: their squares, exact; pivot: that of the node to make."""
    apart = np.sqrt(((x - pivot) ** 2).sum(1))
    if len(x) <= PAGE:
        return Node(x, apart, np.zeros(len(x)), norms, ids)
    pivots = [int(apart.argmax())]  # each next one is the farthest from those before it
    nearest = ((x - x[pivots[0]]) ** 2).sum(1)
    near = np.zeros(len(x), int)
    while len(pivots) < FANOUT and nearest.max() > 0:
        pivots.append(int(nearest.argmax()))
        d = ((x - x[pivots[-1]]) ** 2).sum(1)
        closer = d < nearest
        near[closer], nearest[closer] = len(pivots) - 1, d[closer]
    if len(pivots) == 1:  # equal vectors: pages by id
        order = np.argsort(ids, kind="stable")
        groups = [order[k : k + PAGE] for k in range(0, len(order), PAGE)]
        if len(groups) > FANOUT:
            groups = np.array_split(order, FANOUT)
    else:
        groups = [np.flatnonzero(near == k) for k in range(len(pivots))]
    heads = [x[pivots[k]] if len(pivots) > 1 else x[g[0]] for k, g in enumerate(groups)]
    rows = np.stack(heads)
    radii = np.array([np.sqrt(((x[g] - h) ** 2).sum(1).max()) for g, h in zip(groups, heads, strict=True)])
    children = [build(x[g], norms[g], ids[g], h) for g, h in zip(groups, heads, strict=True)]
    return Node(rows, np.sqrt(((rows - pivot) ** 2).sum(1)), radii, np.array([norms[g].max() for g in groups]), np.array([ids[g].min() for g in groups]), children)


def search(root: Node, pivot: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) among ids other than own; ties to the smaller id."""
    qq = float(q @ q)
    best: list[tuple[float, int]] = []  # a heap of (score, -id): the worst first
    heap: list[tuple[float, int, int, Node, float]] = [(-np.inf, 0, 0, root, float(np.sqrt(((q - pivot) ** 2).sum())))]
    count = 0
    while heap:
        bound, least, _, node, to_pivot = heapq.heappop(heap)
        worst = best[0] if len(best) == k else (-np.inf, 0)
        if -bound < worst[0]:
            break
        if -bound == worst[0] and least > -worst[1]:
            continue
        # the triangle inequality with the stored distances, before any new distance
        low = np.maximum(np.abs(to_pivot - node.apart) - node.radii, 0)
        bounds = np.floor((qq + node.norms - low * low) / 2 * (1 + 1e-9) + 0.5)
        some = np.flatnonzero(bounds >= worst[0])
        if not len(some):
            continue
        dots = node.rows[some] @ q
        if node.children is None:
            for s, i in zip(dots.tolist(), node.least[some].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            continue
        pp = (node.rows[some] ** 2).sum(1)
        d = np.sqrt(np.maximum(qq + pp - 2 * dots, 0))
        low = np.maximum(d - node.radii[some] - 1e-6, 0)
        bounds = np.minimum(bounds[some], np.floor((qq + node.norms[some] - low * low) / 2 * (1 + 1e-9) + 0.5))
        bounds = np.minimum(bounds, np.floor(dots + np.sqrt(qq) * node.radii[some] * (1 + 1e-9) + 0.5))
        for b, n, c, e in zip(bounds.tolist(), some.tolist(), node.least[some].tolist(), d.tolist(), strict=True):
            if b >= worst[0]:
                count += 1
                heapq.heappush(heap, (-b, c, count, node.children[n], e))
    return sorted(((int(s), -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def search_shard(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """All queries of one block against one shard. Integer scores are exact in doubles up to 2**53; beyond it, whole numbers are used."""
    rows, asked = group[group["query"] == 0], group[group["query"] == 1]
    out: list[tuple[int, int, int]] = []
    for size, part in asked.groupby(asked["vec"].map(len)):
        ours = rows[rows["vec"].map(len) == size]
        if ours.empty:
            continue
        v, q = np.array(list(ours["vec"]), "int64"), np.array(list(part["vec"]), "int64")
        ids, asks = ours["vec_id"].to_numpy(), part["vec_id"].to_numpy()
        if float(np.abs(v).max()) * float(np.abs(q).max()) * size * 4 >= 2**53:
            for own, scores in zip(asks, (q.astype(object) @ v.astype(object).T), strict=True):
                found = sorted(((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != own))[:k]
                out += [(own, i, -s) for s, i in found]
            continue
        x = v.astype(float)
        pivot = x[0]
        root = build(x, (v * v).sum(1).astype(float), ids, pivot)
        for own, y in zip(asks.tolist(), q.astype(float), strict=True):
            out += [(own, i, s) for s, i in search(root, pivot, y, own, k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 2_048, block_rows: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best others.

    Components become floor(scale * x), scores are integer inner products."""
    vec = F.transform(F.col(embedding), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), vec).alias("vec")).where("vec is not null and vec_id is not null and size(vec) > 0")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates()
    n = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n[0] // shard_rows)), max(1, -(-n[1] // block_rows))
    spread = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # by rows, not ids, so that no id, however often it is repeated, fills a shard
    data = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), all_of(blocks).alias("block"), F.lit(0).alias("query"), "vec_id", "vec")
    asks = asked.select(all_of(shards).alias("shard"), spread(blocks, 2).alias("block"), F.lit(1).alias("query"), "vec_id", "vec")
    found = data.union(asks).groupBy("shard", "block").applyInPandas(lambda g: search_shard(g, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
