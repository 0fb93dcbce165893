"""Approximate nearest neighbours by inner product: probed lists, scanned a block of rotated dimensions at a time.

Vectors are rotated at random (two rounds of random signs and a Hartley transform, which keep lengths and inner products) and dealt
to the lists of the nearest of some centres; each list is cut into chunks, stored with one array per block of dimensions. A query probes the lists
whose centres have the largest inner product with it. With ``kth`` the query's k-th best score so far, a candidate x
can only help if |q - x|^2 <= |q|^2 + |x|^2 - 2 kth. After each block of dimensions the partial distance is tested against that: under a random
rotation the share of a squared distance that lies in d of D dimensions has mean d / D and a known variance, so candidates whose
partial distance is more than ``SIGMAS`` deviations too large are abandoned. The few that are left are scored exactly, on the original
vectors. A query scans a quarter of its lists first; the k-th score found there is where the others start.

The centres are fitted on at most ``SAMPLE`` vectors, chosen by hash, and so is the number of lists to probe: the least that finds
``TARGET`` of the neighbours that vectors of the sample have in it. All vectors are indexed. Equal vectors are searched and stored once, with their first k + 1 ids, as no
query can have more of them among its k nearest (one may be its own); so one vector that holds a third of all rows is one row here.

Defined cases: a vector that is null, empty or zero, or holds a null or a component that is not finite takes no part, neither does a row with a null
id; only vectors of the query's length are its candidates; rows with the query's id are no candidates; equal scores are ranked by id; a
query row that is repeated gives one result, as do the copies of a candidate row; scores beyond the range of doubles rank as infinite, those that are no number last; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenorline.llm.runtime import broadcast_if_small, cut

K = 20
SAMPLE = 16_384
MOST_LISTS = 2048
CELLS = 1 << 22  # components that sample and centres hold at most, so that they may be broadcast
TARGET = 0.97
ROUNDS = 8
COLUMNS = 16  # dimensions of a block
CHUNK_ROWS = 1024
CHUNK_QUERIES = 4096
TOGETHER = 512  # queries that scan a chunk together
SIGMAS = 2.5
SLACK = 1e-5  # relative; partial distances are sums of single precision

INDEXED = "dim int, list int, chunk int, ids binary, vectors binary, rotated binary, norms binary, size int"
FOUND = "query long, ids array<long>, score double"


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    some = F.exists("vector", lambda v: v != 0.0)
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where(finite & some)


def rotate(points: np.ndarray) -> np.ndarray:
    """Rows under a fixed random orthogonal map of their dimension."""
    dim = points.shape[1]
    signs = np.random.default_rng(dim).choice((-1.0, 1.0), (2, dim))
    for k in range(2):
        spectrum = np.fft.fft(points * signs[k], axis=1)
        points = (spectrum.real - spectrum.imag) / np.sqrt(dim)
    return points


def centres_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by a few rounds of k-means from a seeded choice of the sample."""
    centres = sample[np.random.default_rng(len(sample)).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(axis=1) / 2
    return np.concatenate([np.argmax(points[a:a + 1024] @ centres.T - half, axis=1) for a in range(0, len(points), 1024)])


def probes_of(sample: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET, asked: int = 256) -> int:
    """The least number of lists in which sample vectors find ``target`` of their ``k`` best of the sample."""
    queries = np.arange(min(asked, len(sample)))
    scores = sample[queries] @ sample.T
    scores[queries, queries] = -np.inf
    best = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :min(k, len(sample) - 1)] if len(sample) > 1 else np.zeros((len(queries), 0), np.int64)
    order = np.argsort(-(sample[queries] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, centres)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else 1


def fit(vectors: DataFrame, k: int) -> dict[int, tuple[np.ndarray, int, float]]:
    """Per dimension the centres, the lists to probe and the scale of the fitted sample. Dimensions that the sample lacks, or that are too large, have one list."""
    total, cells = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    # On average half of what the bounds allow; the order only settles which rows stay if chance gives more.
    rate = min(1.0, SAMPLE / 2 / max(1, total), CELLS / 2 / max(1, cells)) if max(total / SAMPLE, cells / CELLS) > 0.5 else 1.0
    hashed = F.xxhash64("vec_id", "vector")
    chosen = vectors.where(F.pmod(hashed, F.lit(1 << 30)) < int(rate * (1 << 30))).where(F.size("vector") <= CELLS // 64)
    rows = chosen.orderBy(hashed, "vec_id").limit(SAMPLE).select("vector").toPandas()
    model, left = {}, CELLS
    for dim, own in sorted(rows.groupby(rows["vector"].map(len)), key=lambda x: -len(x[1])):
        sample = np.stack(own["vector"].to_numpy())[:max(1, left // dim)]
        scale = float(np.abs(sample).max())
        sample = sample / scale
        lists = int(min(MOST_LISTS, max(1, round(total ** 0.5)), len(sample), max(1, left // 2 // dim)))
        centres = centres_of(sample, lists)
        model[int(dim)] = (centres, probes_of(sample, centres, k), scale)
        left -= lists * dim
        if left < 2 * dim:
            break
    return model


def _scaled(points: np.ndarray, scale: float) -> np.ndarray:
    """Points in the scale of the centres; components far beyond the sample are cut, which only moves them to another list."""
    return np.clip(points / scale, -1e15, 1e15)


def _assign(shared, lists_of: bool):
    """Batches with the list of each vector, or the lists that it probes, nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("vector")
            sizes = column.value_lengths().to_numpy()
            flat = column.flatten().to_numpy()
            at = np.cumsum(sizes) - sizes
            out: list = [[0] if lists_of else 0] * batch.num_rows
            for dim in np.unique(sizes).tolist():
                if dim not in model:
                    continue
                centres, probes, scale = model[dim]
                places = np.flatnonzero(sizes == dim)
                for a in range(0, len(places), 1024):
                    own = places[a:a + 1024]
                    points = _scaled(flat[at[own][:, None] + np.arange(dim)], scale)
                    got = np.argsort(-(points @ centres.T), axis=1, kind="stable")[:, :probes].tolist() if lists_of else nearest(points, centres).tolist()
                    for i, x in zip(own.tolist(), got):
                        out[i] = x
            kind = pa.list_(pa.int32()) if lists_of else pa.int32()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "lists" if lists_of else "list"])

    return run


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk: ids and original vectors by row, rotated vectors as one array per block of dimensions."""
    points = np.stack(rows["vector"].to_numpy())
    single = points.astype(np.float32)
    kept = single if np.array_equal(single.astype(np.float64), points) else points
    with np.errstate(over="ignore", invalid="ignore"):
        turned = rotate(points)
        turned = turned.astype(np.float32) if np.abs(points).max() < 1e15 else turned
        norms = (turned.astype(np.float64) ** 2).sum(axis=1)
    blocks = b"".join(np.ascontiguousarray(turned[:, a:a + COLUMNS]).tobytes() for a in range(0, points.shape[1], COLUMNS))
    ids = np.zeros((len(rows), int(rows["ids"].map(len).max())), np.int64)
    copies = np.fromiter(map(len, rows["ids"]), np.int64, len(rows))
    for i, own in enumerate(rows["ids"]):
        ids[i, :len(own)] = own
    head = np.concatenate((copies, ids.ravel()))
    first = rows.iloc[0]
    return pd.DataFrame([[first["dim"], first["list"], first["chunk"], head.tobytes(), kept.tobytes(), blocks, norms.tobytes(), len(rows)]], columns=[c.split()[0] for c in INDEXED.split(", ")])


def build_index(distinct: DataFrame, shared) -> DataFrame:
    """The written index of (ids, vector): a row per chunk of a list."""
    kept = distinct.select("ids", "vector")
    placed = cut(kept.mapInArrow(_assign(shared, False), "ids array<long>, vector array<double>, list int").withColumn("dim", F.size("vector")), "ann-placed")
    chunks = placed.groupBy("dim", "list").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("vector"), F.col("chunks")).cast("int")
    dealt = placed.join(broadcast_if_small(cut(chunks, "ann-chunks")), ["dim", "list"]).select("dim", "list", chunk.alias("chunk"), "ids", "vector")
    return cut(dealt.groupBy("dim", "list", "chunk").applyInPandas(_packed, INDEXED), "ann-index")


class Chunk:
    def __init__(self, row: dict):
        size, dim = row["size"], row["dim"]
        head = np.frombuffer(row["ids"], np.int64)
        self.copies, self.ids = head[:size], head[size:].reshape(size, -1)
        self.vectors = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * size * dim else np.float64).reshape(size, dim)
        self.norms = np.frombuffer(row["norms"], np.float64)
        kind = np.float32 if len(row["rotated"]) == 4 * size * dim else np.float64
        flat = np.frombuffer(row["rotated"], kind)
        self.blocks = [flat[a * size:min(dim, a + COLUMNS) * size].reshape(size, -1) for a in range(0, dim, COLUMNS)]
        self.dim = dim

    def scan(self, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query, candidate, score) of candidates that survive all tests and reach ``kth``, at most ``k`` + 1 of a query."""
        with np.errstate(over="ignore", invalid="ignore"):
            turned = rotate(queries)
            most = (turned ** 2).sum(axis=1)[:, None] + self.norms[None, :]
            most = most * (1 + SLACK) - 2 * kth[:, None]  # a candidate's squared distance may be no more
            q, x = None, None
            seen = 0
            for at, block in enumerate(self.blocks):
                own = turned[:, at * COLUMNS:at * COLUMNS + block.shape[1]].astype(block.dtype)
                seen += block.shape[1]
                share = seen / self.dim
                spread = 1 + SIGMAS * np.sqrt(2 * (1 - share) / (seen * (1 + 2 / self.dim)))
                if q is None:
                    partial = (own.astype(np.float64) ** 2).sum(axis=1)[:, None] + (block.astype(np.float64) ** 2).sum(axis=1)[None, :] - 2.0 * (own @ block.T)
                    q, x = np.nonzero(~(partial > share * spread * np.maximum(most, 0)))
                    partial, limit = partial[q, x], most[q, x]
                else:
                    partial = partial + ((own[q] - block[x]).astype(np.float64) ** 2).sum(axis=1)
                    alive = ~(partial > share * spread * np.maximum(limit, 0))
                    q, x, partial, limit = q[alive], x[alive], partial[alive], limit[alive]
            scores = np.concatenate([(queries[q[a:a + 65_536]] * self.vectors[x[a:a + 65_536]].astype(np.float64)).sum(axis=1) for a in range(0, len(q), 65_536)] or [np.zeros(0)])
        reached = ~(scores < kth[q])
        q, x, scores = q[reached], x[reached], scores[reached]
        order = np.lexsort((self.ids[x, 0], -np.where(np.isnan(scores), -np.inf, scores), q))
        q, x, scores = q[order], x[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank <= k
        return zip(q[top].tolist(), x[top].tolist(), scores[top].tolist())


def _answers(chunk: Chunk, asked: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, asked.num_rows, TOGETHER):
        own = asked.slice(a, TOGETHER)
        queries = np.stack(own.column("vector").to_numpy(zero_copy_only=False))
        keys = own.column("query").to_numpy()
        found = [(int(keys[q]), chunk.ids[x, :chunk.copies[x]].tolist(), s) for q, x, s in chunk.scan(queries, own.column("kth").to_numpy(), k)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.list_(pa.int64()), pa.float64()))], [c.split()[0] for c in FOUND.split(", ")])


def _scan(k: int):
    """Scan a sorted partition in which the chunk of each unit stands before its queries; a unit may span batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            chunks = np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            for a, b in zip([0, *chunks], [*chunks, batch.num_rows]):
                piece = batch.slice(a, b - a)
                if a in chunks and b > a:
                    chunk = Chunk(piece.slice(0, 1).to_pylist()[0])
                    piece = piece.slice(1)
                if piece.num_rows:
                    yield from _answers(chunk, piece, k)

    return run


def scan_lists(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``FOUND`` rows of (query, vector, kth, lists): the lists named are scanned, each chunk by groups of queries."""
    wanted = asked.select("query", "vector", "kth", F.size("vector").alias("dim"), F.explode("lists").alias("list"))
    groups = asked.select(F.size("vector").alias("dim"), F.explode("lists").alias("list")).groupBy("dim", "list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("groups"))
    groups = broadcast_if_small(cut(groups, "ann-groups"))
    chunks = broadcast_if_small(index.select("dim", "list", "chunk"))
    scanned = index.join(groups, ["dim", "list"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    wanted = wanted.join(groups, ["dim", "list"]).join(chunks, ["dim", "list"])
    wanted = wanted.withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int"))
    both = scanned.withColumn("kind", F.lit(0)).select(*[c.split()[0] for c in INDEXED.split(", ")], "group", "kind").unionByName(
        wanted.select("dim", "list", "chunk", "group", F.lit(1).alias("kind"), "query", "vector", "kth"), allowMissingColumns=True)
    unit = ["dim", "list", "chunk", "group"]
    return both.repartition(*unit).sortWithinPartitions(*unit, "kind").mapInArrow(_scan(k), FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query, best): the ``k`` + 1 best scores with their ids, in order."""
    value = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("query").orderBy(value.desc(), F.col("ids")[0])
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "ids", "score"))).alias("best"))


def search(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the about nearest ``k`` rows for each row whose ``vec_id`` ``is_query`` holds for."""
    vectors = cut(usable_vectors(rows), "ann-vectors")
    first_ids = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.distinct().withColumn("copy", F.row_number().over(first_ids)).where(F.col("copy") <= k + 1)
    distinct = cut(first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-distinct")
    shared = rows.sparkSession.sparkContext.broadcast(fit(distinct.select(F.col("ids")[0].alias("vec_id"), "vector"), k))
    index = build_index(distinct, shared)
    queries = vectors.where(is_query).distinct()
    asked = queries.groupBy("vector").agg(F.min("vec_id").alias("query"))
    asked = cut(asked.select("query", "vector").mapInArrow(_assign(shared, True), "query long, vector array<double>, lists array<int>"), "ann-asked")
    # At least one list of four comes first. What it finds bounds the tests in the others.
    ahead = F.ceil(F.size("lists") / 4).cast("int")
    none = F.lit(float("-inf"))
    begun = cut(best_of(scan_lists(index, asked.select("query", "vector", none.alias("kth"), F.slice("lists", F.lit(1), ahead).alias("lists")), k), k), "ann-begun")
    copies = F.aggregate("best", F.lit(0), lambda n, x: n + F.size(x.ids))
    reached = begun.select("query", F.when(copies > k, F.element_at("best", -1).score).alias("reached"))
    rest = asked.join(reached, "query", "left").select("query", "vector", F.coalesce("reached", none).alias("kth"), F.slice("lists", ahead + 1, F.size("lists")).alias("lists"))
    found = scan_lists(index, rest.where(F.size("lists") > 0), k)
    again = begun.select("query", F.explode("best").alias("b")).select("query", "b.ids", "b.score")
    best = best_of(found.unionByName(again), k).select("query", F.col("best"))
    flat = F.flatten(F.transform("best", lambda x: F.transform(x.ids, lambda i: F.struct(i.alias("vec_id"), x.score.alias("score")))))
    named = queries.join(asked.select("query", "vector"), "vector").select("vec_id", "query").withColumnRenamed("vec_id", "query_id").distinct()
    answered = named.join(best.select("query", flat.alias("all")), "query")
    # Equal scores are ranked by id across different vectors, too.
    value = lambda x: F.when(F.isnan(x.score), none).otherwise(x.score)
    own = F.sort_array(F.transform(F.filter("all", lambda x: x.vec_id != F.col("query_id")), lambda x: F.struct((-value(x)).alias("less"), x.vec_id.alias("vec_id"), x.score.alias("score"))))
    return answered.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")
