"""Grouping of spelling variants: words that differ by exactly one inserted, deleted or replaced code point.

Two such words, of which the shorter has ``s`` code points, share their first or their last ``s // 2`` code points. So
words meet in units: one per ``s``, side and shared half. A unit is compared by dense tiles: blocks of ``BLOCK`` words in key order become
matrices of code points, padded once at the right and once at the left; block pairs are compared whole, and a pair is near
if its common prefix and common suffix together reach the longer length minus one. A pair that shares both halves counts
in the unit of its prefix only. Each word takes from a tile the number of its near words and the best of them, so no table
has a row per pair. Units of more than ``UNIT_WORDS`` words are dealt to tiles of two parts each, which are units of their own.

A word's form is its near word of largest count (ties: first in code-point order), if that count is at least ``RATIO`` times
its own. Counts at least double along forms, so there is no circle; roots are found by doubling the steps.

Defined cases: a null text has no words; a null id counts as an empty one where words are altered; repeated rows count
as often as they are there; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorline.llm.runtime import broadcast_if_small, cut

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALTERED = 97  # a run whose checksum this divides loses a code point
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
BLOCK = 128
TILE_CELLS = 1 << 22  # code points that a tile compares at most, so tiles of very long words are smaller
UNIT_WORDS = 8192

UNIT = ["shorter", "side", "half", "tile_a", "tile_b"]
PARTIAL = "word string, n_near long, other_n long, other string"


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters, some of which have lost a code point, with their occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("run", F.translate("run", UPPER, LOWER))
    checksum = F.crc32(F.concat_ws(":", "id", "run"))
    at = (checksum % F.length("run")).cast("int")
    rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(checksum % ALTERED == 0, rest).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _units(words: DataFrame, unit_words: int, least_length: int) -> DataFrame:
    """(``UNIT``, part, word, n): each word in every unit where a near word may be; crowded units as tiles of two parts."""
    length = F.length("word")
    half = lambda s: (s / 2).cast("int")
    sides = [F.struct(s.alias("shorter"), F.lit(side).alias("side"), part.alias("half"))
             for s in (length, length - 1) for side, part in ((0, F.substring(F.col("word"), F.lit(1), half(s))), (1, F.substring(F.col("word"), length - half(s) + 1, half(s))))]
    keyed = words.select("word", "n", F.explode(F.array(*sides)).alias("u")).select("u.*", "word", "n").where(F.col("shorter") >= least_length)
    crowded = (keyed.groupBy("shorter", "side", "half").agg(F.count("*").alias("words")).where(F.col("words") > unit_words)
               .select("shorter", "side", "half", F.ceil(F.col("words") / unit_words).cast("int").alias("parts")))
    crowded = broadcast_if_small(cut(crowded, "crowded-units"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = keyed.join(crowded, ["shorter", "side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.select("shorter", "side", "half", F.least("part", "with").alias("tile_a"), F.greatest("part", "with").alias("tile_b"), "part", "word", "n")


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words as a matrix padded at the right, one padded at the left, and the lengths."""
    left = np.array(words)
    width = left.dtype.itemsize // 4
    left = left.view(np.uint32).reshape(len(words), width)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    right = np.take_along_axis(left, (np.arange(width)[None, :] + sizes[:, None]) % width, axis=1)
    kind = np.uint8 if left.max(initial=0) < 256 else np.uint32
    return left.astype(kind), right[:, ::-1].astype(kind), sizes


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and each of ``b`` the number of leading columns that agree."""
    differ = a[:, None, :] != b[None, :, :]
    first = differ.argmax(axis=2)
    first[~differ[:, :, 0] & (first == 0)] = a.shape[1]
    return first


def near_pairs(words: list[str], unit: np.ndarray, shorter: int, side: np.ndarray, part: np.ndarray, crossed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs, each once, among words of ``shorter`` or one more code points in the order of their units."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, right, sizes = padded(words)
    n = len(sizes)
    block = max(1, min(BLOCK, int((TILE_CELLS / left.shape[1]) ** 0.5)))
    for a0 in range(0, n, block):
        a1 = min(n, a0 + block)
        for b0 in range(a0, n, block):
            if unit[b0] > unit[a1 - 1]:
                break
            b1 = min(n, b0 + block)
            total = common(left[a0:a1], left[b0:b1])
            prefix = total.copy()
            total += common(right[a0:a1], right[b0:b1])
            la, lb = sizes[a0:a1, None], sizes[None, b0:b1]
            ok = (total >= np.maximum(la, lb) - 1) & (np.minimum(la, lb) == shorter)
            ok &= unit[a0:a1, None] == unit[None, b0:b1]
            ok &= (side[a0:a1, None] == 0) | (prefix < shorter // 2)
            ok &= ~crossed[a0:a1, None] | (part[a0:a1, None] != part[None, b0:b1])
            if a0 == b0:
                ok &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            i, j = np.nonzero(ok)
            found_a.append(i + a0)
            found_b.append(j + b0)
    return np.concatenate(found_a), np.concatenate(found_b)


def _partials(table: pa.Table) -> pa.RecordBatch | None:
    words = table.column("word").to_pylist()
    counts = table.column("n").to_numpy()
    half = table.column("half").to_numpy(zero_copy_only=False)
    shorter, side, tile_a, tile_b, part = (table.column(c).to_numpy().astype(np.int64) for c in ("shorter", "side", "tile_a", "tile_b", "part"))
    new = np.ones(len(words), bool)
    # A table is in the order of ``UNIT``, so words of like length stand together.
    new[1:] = (half[1:] != half[:-1]) | (shorter[1:] != shorter[:-1]) | (side[1:] != side[:-1]) | (tile_a[1:] != tile_a[:-1]) | (tile_b[1:] != tile_b[:-1])
    unit, crossed = np.cumsum(new), tile_a != tile_b
    edges = [0, *(np.flatnonzero(shorter[1:] != shorter[:-1]) + 1).tolist(), len(words)]
    pairs = [(start, near_pairs(words[start:stop], unit[start:stop], int(shorter[start]), side[start:stop], part[start:stop], crossed[start:stop])) for start, stop in zip(edges[:-1], edges[1:])]
    a, b = (np.concatenate([start + found[k] for start, found in pairs]) for k in (0, 1))
    if not len(a):
        return None
    one, other = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.array(words)
    order = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    rank = np.lexsort((order[other], -counts[other], one))
    one, other = one[rank], other[rank]
    first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    near = np.diff(np.append(first, len(one)))
    best = other[first]
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in one[first]], pa.string()), pa.array(near, pa.int64()), pa.array(counts[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
                                      [c.split()[0] for c in PARTIAL.split(", ")])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of whole units; the last unit of a batch waits for its rest."""
    waiting: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in UNIT]
        last = tuple(k[batch.num_rows - 1].as_py() for k in keys)
        start = batch.num_rows - 1
        while start and tuple(k[start - 1].as_py() for k in keys) == last:
            start -= 1
        if start or (waiting and key != last):
            waiting.append(batch.slice(0, start))
            out = _partials(pa.Table.from_batches(waiting))
            waiting = []
            if out is not None:
                yield out
        waiting.append(batch.slice(start))
        key = last
    if waiting and (out := _partials(pa.Table.from_batches(waiting))) is not None:
        yield out


def near_words(words: DataFrame, unit_words: int = UNIT_WORDS, least_length: int = 1) -> DataFrame:
    """(word, n_near, other_n, other) of the distinct words of (word, n) that have a near word: how many, and the best of them. ``least_length`` is that of the shortest word."""
    units = _units(words, unit_words, least_length)
    partials = units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_scan, PARTIAL)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    return partials.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("other_n"), F.col("best.other").alias("other"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms. A round follows twice as many steps as the one before."""
    paths = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = cut(paths.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "paths")
        if not paths.where("moved").limit(1).count():
            return paths.drop("moved")
        paths = paths.drop("moved")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: float = RATIO, unit_words: int = UNIT_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (doc_id, text) that is long and frequent enough."""
    words = cut(count_words(docs, least_length, least_count), "words")
    near = near_words(words, unit_words, least_length)
    larger = F.col("other_n") >= ratio * F.col("n")
    named = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(larger, F.col("other")).alias("form"), F.when(larger, F.col("other_n")).alias("form_n")), "variants")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
