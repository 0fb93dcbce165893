"""Exact top-k search by inner product with one KD-tree per shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by hash. Each shard is a tree of median splits along the widest side;
its nodes, with tight bounding boxes, are one row of the index table, which is written once. A query goes down from the
root and always opens the box with the best bound (the largest inner product that a point of the box can have), until the
best bound falls below the query's k-th score. Queries come in blocks of bounded size, each broadcast to all shards. The first shard of each
dimension and kind is searched first, and the k-th score found there is where the search of all other shards starts.

Vectors are whole numbers, floor(``scale`` * x); scores are exact. Vectors with a component of ``LARGEST`` and more lie in
shards of their own; where sums may pass 53 bits the products are taken in 64-bit integers, and beyond in Python's.

Defined cases: a vector that is null, empty, or holds a null or a component that is not finite takes no part, neither does
a row with a null id; a score beyond 64 bits is shown as the nearest number that fits, but ranked by up to 38 digits; only vectors of the query's length are its candidates; rows with the query's id are its own and no
candidates; equal scores are ranked by id, and equal ids by nothing else as they rank alike; a query row that is repeated is
asked once; a query with fewer candidates has fewer rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenorline.llm.runtime import broadcast_if_small, cut

K = 10
SCALE = 1024
SHARD_ROWS = 8192
LEAF_ROWS = 256
QUERY_BLOCK = 16_384
GROUP = 128  # queries that walk a shard together
LARGEST = 1 << 28  # scaled components of this size and more are stored as doubles, which hold them exactly
LONG = 1 << 63
DIGITS = 10**38 - 1
MOST = sys.float_info.max

INDEX = "dim int, wide boolean, shard int, ids binary, vectors binary, nodes binary, low binary, high binary"
FOUND = "query_id long, query_key long, vec_id long, score long, exact decimal(38,0)"  # exact only where score is cut


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    whole = lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(F.greatest(F.least(v, F.lit(MOST)), F.lit(-MOST)))
    x = F.transform("embedding", lambda v: whole(scaled(v)))
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return rows.where(usable).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))


def nodes_of(points: np.ndarray, leaf_rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points, and per node its first and last place in it and its children (-1 for a leaf). Node 0 is the root.

    Splits are by rank, so equal points never stop them.
    """
    leaf_rows = LEAF_ROWS if leaf_rows is None else leaf_rows
    order, nodes, todo = np.arange(len(points)), [[0, len(points), -1, -1]], [0]
    while todo:
        node = todo.pop()
        a, b = nodes[node][:2]
        if b - a <= leaf_rows:
            continue
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(axis=0).astype(float) - own.min(axis=0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
        nodes[node][2:] = len(nodes), len(nodes) + 1
        todo += nodes[node][2:]
        nodes += [[a, a + half, -1, -1], [a + half, b, -1, -1]]
    return order, np.array(nodes, np.int32)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    wide = bool(rows["wide"].iloc[0])
    points = np.array(rows["vector"].tolist(), np.float64).astype(np.float64 if wide else np.int32)
    order, nodes = nodes_of(points)
    points = points[order]
    low, high = (np.stack([f(points[a:b], axis=0) for a, b in nodes[:, :2]]) for f in (np.min, np.max))
    packed = [x.tobytes() for x in (rows["vec_id"].to_numpy(np.int64)[order], points, nodes, low, high)]
    return pd.DataFrame([[rows["dim"].iloc[0], wide, rows["shard"].iloc[0], *packed]], columns=[c.split()[0] for c in INDEX.split(", ")])


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index of (vec_id, vector): a row per shard. Shard 0 of each kind is one that is searched first."""
    kind = F.size("vector").alias("dim"), F.exists("vector", lambda v: F.abs(v) >= float(LARGEST)).alias("wide")
    sizes = vectors.groupBy(*kind).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int")
    placed = vectors.select("vec_id", "vector", *kind).join(broadcast_if_small(cut(sizes, "kd-sizes")), ["dim", "wide"]).select("dim", "wide", shard.alias("shard"), "vec_id", "vector")
    return cut(placed.groupBy("dim", "wide", "shard").applyInPandas(_build, INDEX), "kd-index")


def _integers(x: np.ndarray, kind) -> np.ndarray:
    """Whole numbers, given as doubles or integers, in the arithmetic ``kind``."""
    if kind is not object:
        return x.astype(kind)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


class Tree:
    def __init__(self, row: dict):
        dim, kind = row["dim"], np.float64 if row["wide"] else np.int32
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.points = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 4)
        self.low, self.high = (np.frombuffer(row[c], kind).reshape(-1, dim) for c in ("low", "high"))

    def search(self, queries: np.ndarray, own: np.ndarray, kth: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        """The best (score, id) per query among those that reach ``kth``. Each query opens its best box; those at one box open it together."""
        size = lambda x: max(abs(int(x.max())), abs(int(x.min())))
        largest = size(queries) * size(self.points) * queries.shape[1]
        kind = np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object  # exact each way, the first is the fastest
        none = -np.inf if kind is np.float64 else -(1 << 63) if kind is np.int64 else -largest - 1
        queries, points, low, high = (_integers(x, kind) for x in (queries, self.points, self.low, self.high))
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        # a k-th score beyond what this shard can reach closes the shard for the query
        reached = np.array([none if x is None or x < -largest else x for x in (None if x is None else min(x, largest + 1) for x in kth)], kind)
        found: list[list[tuple[int, int]]] = [[] for _ in own]
        bound = np.full((len(queries), len(self.nodes)), none, kind)
        bound[:, 0] = above @ high[0] + below @ low[0]
        every = np.arange(len(queries))
        while True:
            best = bound.argmax(axis=1)
            value = bound[every, best]
            open_ = np.flatnonzero((value > none) & (value >= reached))
            if not len(open_):
                return found
            for node in np.unique(best[open_]):
                asking = open_[best[open_] == node]
                bound[asking, node] = none
                a, b, *children = self.nodes[node].tolist()
                if children[0] >= 0:
                    for child in children:
                        bound[asking, child] = above[asking] @ high[child] + below[asking] @ low[child]
                    continue
                scores = queries[asking] @ points[a:b].T
                take = (scores >= reached[asking][:, None]) & (self.ids[a:b][None, :] != own[asking][:, None])
                for q, row, some in zip(asking.tolist(), scores, take):
                    if some.any():
                        new = zip((-row[some]).tolist(), self.ids[a:b][some].tolist())
                        found[q] = sorted([*found[q], *new])[:k]
                        if len(found[q]) == k:
                            reached[q] = max(reached[q], -found[q][-1][0])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, vectors, kth = shared.value
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                mine = np.array([q for q, v in enumerate(vectors) if len(v) == row["dim"]], np.int64)
                out = []
                for start in range(0, len(mine), GROUP):
                    group = mine[start:start + GROUP]
                    found = tree.search(np.stack([vectors[q] for q in group]), ids[group], [kth[q] for q in group], k)
                    out += [(int(ids[q]), int(keys[q]), i, -int(s)) for q, best in zip(group, found) for s, i in best]
                if out:
                    columns = [pa.array(c, pa.int64()) for c in zip(*((*r[:3], min(max(r[3], -LONG), LONG - 1)) for r in out))]
                    exact = [None if -LONG <= r[3] < LONG else Decimal(min(max(r[3], -DIGITS), DIGITS)) for r in out]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(exact, pa.decimal128(38, 0))], names)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.coalesce("exact", F.col("score").cast("decimal(38,0)")).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for each row that ``is_query`` holds for."""
    vectors = cut(whole_vectors(rows, scale), "vectors")
    index = build_index(vectors)
    key = F.xxhash64("vector")
    asked = cut(vectors.where(is_query).select("vec_id", key.alias("query_key"), "vector").distinct(), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    context = rows.sparkSession.sparkContext
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(blocks)) == block).collect()
        ids, keys = (np.array([r[c] for r in own], np.int64) for c in ("vec_id", "query_key"))
        queries = [np.array(r.vector, np.float64) for r in own]
        start = [None] * len(own)
        shared = context.broadcast((ids, keys, queries, start))
        first = cut(index.where("shard = 0").mapInArrow(_search(shared, k), FOUND), "first")
        reached = {(r.query_id, r.query_key): r.score if r.exact is None else int(r.exact) for r in ranked(first, k).where(F.col("rank") == k).collect()}
        start = [reached.get(q) for q in zip(ids.tolist(), keys.tolist())]
        shared = context.broadcast((ids, keys, queries, start))
        rest = index.where("shard > 0").repartition("dim", "wide", "shard").mapInArrow(_search(shared, k), FOUND)
        parts.append(first.unionByName(rest))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
