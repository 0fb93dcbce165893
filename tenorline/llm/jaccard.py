"""Join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning of candidate pairs.

1. Each text becomes the set of its ``WORDS``-word shingles (lower case; letters, digits, ``_`` and all characters beyond
   ASCII make words; a shorter text is one shingle). Texts with the same set are one *node*; copies cost nothing further.
2. A node has ``BANDS`` x ``ROWS`` MinHash values of 16 bits. Nodes that share a band's values meet in a bucket. At the
   threshold 0.8 a pair misses every bucket with probability 3e-6. Buckets with the same members are searched once.
3. Within a bucket MinHash values are compared ``STEP`` at a time. With m of n equal the similarity has the posterior
   Beta(m + 1, n - m + 1); a pair is dropped as soon as the probability of reaching the threshold is under ``TOLERANCE``.
4. The rest is verified on the whole shingle sets, exactly up to 64-bit hash collisions.

A bucket is cut into blocks of about ``BLOCK`` nodes, and pairs of blocks are the unit of work, so a bucket of any size is
spread over tasks, and no table has a row per pair: tasks pass on, per node, the list of its partners in the block. A pair
that meets in several buckets belongs to the first of its bands.

Defined cases: a text without words (null, empty, marks only) is similar to none and is its own class; a row with a null
``doc_id`` is searched like others; a class whose ids are all null has the class id null; equal rows count as copies of each
other; no rows give no rows. Other columns are ignored, or carried along by ``one_per_class``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorline.llm.grams import U64, distinct_per_text, grams, mix64, slices, text_bytes, tokens
from tenorline.llm.runtime import broadcast_if_small, cut

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 1024
PAIRS_AT_ONCE = 1 << 17
COLUMNS_AT_ONCE = 4096

_rng = np.random.Generator(np.random.PCG64(2024))
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | U64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text of a column, and how many each has."""
    data, at = text_bytes(column)
    return distinct_per_text(*grams(*tokens(data, at), words))


def nodes_of(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number per set of shingles."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros(len(sizes), U64)
    if len(shingles):
        out[sizes > 0] = mix64(np.add.reduceat(mix64(shingles ^ U64(0xA5A5A5A5A5A5A5A5)), starts) + sizes[sizes > 0].astype(U64))
    return out.view(np.int64)


def minhashes(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS whole numbers per non-empty set, each of ROWS MinHash values of 16 bits."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    values = np.zeros((len(starts), BANDS * ROWS), np.uint16)
    for k in range(BANDS * ROWS if len(starts) else 0):
        least = np.minimum.reduceat((shingles ^ _SHIFTS[k]) * _FACTORS[k], starts)
        values[:, k] = mix64(least) >> U64(48)
    return values.view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            shingles, sizes = shingle_sets(part.column("text"), words)
            empty = sizes == 0
            bands = np.zeros((len(sizes), BANDS), np.int64)
            bands[~empty] = minhashes(shingles, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(nodes_of(shingles, sizes), mask=empty), lists], ["doc_id", "text_hash", "node", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            shingles, sizes = shingle_sets(part.column("text"), words)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles[e - s:e].tobytes() for e, s in zip(ends, sizes)], pa.binary())], ["node", "shingles"])

    return run


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n compared values to the fewest equal ones at which P(similarity >= threshold) is not under ``tolerance``.

    With whole numbers the posterior tail is a binomial sum: P = P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _pairs(sides: list[np.ndarray], crossed: bool, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within one side, or across two, not too many at once."""
    left, right = (sides[0], sides[1]) if crossed else (sides[0], sides[0])
    step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
    for a in range(0, len(left), step):
        i, j = np.meshgrid(np.arange(a, min(a + step, len(left))), np.arange(len(right)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if not crossed:
            i, j = i[i < j], j[i < j]
        yield left[i] + base, right[j] + base


def _prune(least: dict[int, int]):
    """Rows (task, band, crossed, members) to rows (task, node, partners) of the pairs that pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            at = members.offsets.to_numpy()
            inner = members.values
            node, own = inner.field("node").to_numpy(), inner.field("own").to_numpy()
            bands = inner.field("bands").flatten().to_numpy().reshape(-1, BANDS) if len(inner) else np.zeros((0, BANDS), np.int64)
            values = np.ascontiguousarray(bands).view(np.uint16)
            task, band, crossed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "band", "crossed"))
            two = np.flatnonzero((np.diff(at) == 2) & ~crossed)
            chunks = [(at[two], at[two] + 1, two)]
            out: list[tuple] = []
            for r in range(batch.num_rows):
                if at[r + 1] - at[r] > 2 or crossed[r]:
                    places = np.arange(at[r + 1] - at[r])
                    sides = [places[own[at[r]:at[r + 1]] == s] for s in np.unique(own[at[r]:at[r + 1]])] if crossed[r] else [places]
                    if len(sides) == 1 + int(crossed[r]):
                        chunks.extend((i, j, np.full(len(i), r)) for i, j in _pairs(sides, bool(crossed[r]), at[r]))
                if sum(len(c[0]) for c in chunks) >= PAIRS_AT_ONCE or r == batch.num_rows - 1:
                    out.append(_passing(values, bands, band, *(np.concatenate(x) for x in zip(*chunks)), least))
                    chunks = [(np.zeros(0, np.int64),) * 3]
            if out:
                i, j, row = (np.concatenate(x) for x in zip(*out))
                if len(i):
                    yield _adjacency(task[row], node[i], node[j])

    return run


def _passing(values, bands, band, i, j, row, least):
    equal = np.zeros(len(i), np.int64)
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        equal = equal + (values[i, n - STEP:n] == values[j, n - STEP:n]).sum(axis=1)
        stay = equal >= least[n]
        i, j, row, equal = i[stay], j[stay], row[stay], equal[stay]
    if not len(i):
        return i, j, row
    first = (bands[i] == bands[j]).argmax(axis=1)
    here = first == band[row]
    return i[here], j[here], row[here]


def _adjacency(task: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A row per task and node of a pair; the pair is listed with its first node."""
    frame = pd.DataFrame({"task": task, "a": a, "b": b})
    lists = frame.groupby(["task", "a"], sort=False)["b"].agg(list).reset_index()
    ends = frame[["task", "b"]].drop_duplicates().rename(columns={"b": "a"})
    both = ends.merge(lists, on=["task", "a"], how="outer")
    partners = [x if isinstance(x, list) else [] for x in both["b"]]
    return pa.RecordBatch.from_arrays([pa.array(both["task"].to_numpy()), pa.array(both["a"].to_numpy()), pa.array(partners, pa.list_(pa.int64()))], ["task", "node", "partners"])


def _verify(threshold: float):
    share = Fraction(threshold).limit_denominator(10_000)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(s) for s in sets])
        place = {n: k for k, n in enumerate(rows["node"])}
        i = np.repeat(np.arange(len(rows)), [len(p) for p in rows["partners"]])
        j = np.array([place[b] for p in rows["partners"] for b in p], np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = uses[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(rows), len(rows)), np.float32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
            a, b = np.searchsorted(column, [c, c + COLUMNS_AT_ONCE])
            holds = np.zeros((len(rows), min(COLUMNS_AT_ONCE, int(column[-1]) + 1 - c)), np.float32)
            holds[owner[a:b], column[a:b] - c] = 1
            common += holds @ holds.T
        both = common[i, j].astype(np.int64)
        near = both * (share.denominator + share.numerator) >= share.numerator * (sizes[i] + sizes[j])
        i, j = i[near], j[near]
        copies = rows["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        return pd.DataFrame({"node": rows["node"], "links": links.astype(np.int64), "peer": _peers(rows["node"].to_numpy(), i, j)})[links > 0]

    return run


def _peers(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node another one of the same connected part, so that these links join the part and no node has many."""
    root = np.arange(len(node))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    peer = node.copy()
    order = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.append(True, root[order][1:] != root[order][:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        part = order[a:b]
        peer[part[1:]] = node[part[(np.arange(1, len(part)) - 1) // 2]]
    return peer


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, node, bands) per row of ``docs``."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(_sign(words), "doc_id long, text_hash long, node long, bands array<long>")


def candidate_tasks(nodes: DataFrame) -> DataFrame:
    """(task, band, crossed, members): pairs of blocks of buckets, with the MinHash values of their nodes."""
    bands = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    sizes = bands.groupBy("band", "value").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    buckets = cut(sizes.groupBy("n", "x", "y").agg(F.min(F.struct("band", "value")).alias("b")).select("b.band", "b.value", "n"), "buckets")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    inside = bands.join(buckets, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "node"), parts).cast("int"))
    spread = inside.select("node", "band", "value", "own", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    placed = spread.select("node", "band", "own", F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") != F.col("other")).alias("crossed"))
    # a node of a block that is paired with itself comes once; a node of two blocks that are paired comes with either
    member = F.struct("node", "own", "bands")
    return placed.join(nodes.select("node", "bands"), "node").groupBy("task", "band").agg(F.max("crossed").alias("crossed"), F.collect_list(member).alias("members")).where(F.size("members") > 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the ends of ``edges`` (node, peer): the least node of each connected part.

    Every round takes the least label among neighbours and then the label of that label, until nothing changes.
    """
    both = cut(edges.unionByName(edges.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).where("node != peer").distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.least(F.min("peer"), F.first("node")).alias("label")), "labels")
    while True:
        far = labels.select(F.col("node").alias("peer"), F.col("label").alias("far"))
        least = both.join(far, "peer").groupBy("node").agg(F.min("far").alias("far"))
        near = labels.join(least, "node").select("node", "label", F.least("label", "far").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        after = cut(near.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("jump", "next")).alias("label")), "labels")
        if after.where("old != label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, class_id and n_links per row of ``docs``.

    ``n_links`` counts the other rows whose similarity reaches the threshold; ``class_id`` is the smallest ``doc_id`` of all
    rows that are joined by links, directly or through others.
    """
    rows = cut(signed(docs, words), "signed")
    nodes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("bands").alias("bands")), "nodes")
    passed = cut(candidate_tasks(nodes).mapInArrow(_prune(least_matches(threshold)), "task long, node long, partners array<long>"), "passed")
    wanted = cut(passed.select("node").distinct().join(nodes, "node").select("node", "copies", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")), "wanted")
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    chosen = texts.join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash"))).select("node", "text").dropDuplicates(["node"])
    sets = chosen.mapInArrow(_sets(words), "node long, shingles binary")
    tasks = passed.join(sets, "node").join(wanted.select("node", "copies"), "node")
    verified = cut(tasks.groupBy("task").applyInPandas(_verify(threshold), "node long, links long, peer long"), "verified")
    labels = components(verified.select("node", "peer"))
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = cut(nodes.select("node", "copies", "first_id").join(linked, "node", "left").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    firsts = cut(known.groupBy("label").agg(F.min("first_id").alias("class_id")), "classes")
    classes = cut(known.join(firsts, "label").select("node", "class_id", "n_links"), "node-classes")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", "text_hash", "node").join(classes, "node", "left").select("doc_id", "text_hash", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links per row of ``docs``."""
    return similarity_classes(docs).drop("text_hash")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those of a class but one: the row of the smallest ``doc_id``.

    Rows with a null ``doc_id`` stay unless their class has a row with one; of equal rows one stays.
    """
    classes = similarity_classes(docs)
    out = cut(classes.where("doc_id IS NOT NULL AND class_id != doc_id OR doc_id IS NULL AND class_id IS NOT NULL").select(F.col("doc_id").alias("out_id"), F.col("text_hash").alias("out_hash")).distinct(), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("out_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("out_hash"))
    return docs.join(broadcast_if_small(out), same, "left_anti").dropDuplicates(["doc_id", "text"])
