"""Phrase collocations per language: phrases of two and three words whose words come together more often than alone.

Texts are cut into pieces and words on their bytes, in slices, and n-grams are hashed with their language. A task counts the n-grams of
some slices and sends the counts on by hash partition. Each partition keeps a Misra-Gries summary: counts of at most ``capacity`` n-grams, where the
(capacity + 1)-th largest count is taken from all whenever there are more. The capacity is a multiple of the partition's mass divided
by the least count, and what is taken in all stays below the least count, so every frequent n-gram survives. Summaries merge, so a partition may take its counts in any order.
Survivors set bits in a map of fixed size. Words come first; pairs are only counted where both words survived, triples where both
pairs did. The last pass counts the survivors by their words, exactly, and drops what is not frequent after all, so neither the
summaries nor the maps change the result. (Phrases are told apart by 64-bit hashes within a task, by their text across tasks.)

A language may hold most rows: nothing is grouped by language alone but sums and the first ``top`` phrases, which every task cuts before they are sent.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count as often as they are there; a piece of one word has
no phrases; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenorline.llm.grams import U64, hashed_runs, mix64, slices, text_bytes
from tenorline.llm.runtime import broadcast_if_small, cut

LEAST = 10
TOP = 2000
INSIDE = 50  # percent of a phrase's occurrences that lie in a longer candidate from which on it is dropped
SCALE = 1_000_000
SLICE_BYTES = 1 << 20
CAPACITY_FACTOR = 4
HELD = 1 << 20  # counts that a task holds before it sends them on
HELD_PHRASES = 1 << 20  # and of phrases with their text, some 40 bytes each
PART_MASS = 4 << 20  # n-grams of a hash partition, so that its summary takes some dozen MB
BUCKETS = 64  # parts of a language that are ranked before its best are ranked together
LEAST_PARTS = 512
MOST_PART_BITS = 20
BITS = 27  # of a hash that choose a bit of the map: 16 MB, whatever the data
KEPT_BITS = 24  # of a hash that are sent beside its partition: few n-grams of a partition of bounded mass share them, and a shared one costs work only
MOST_COUNT = 255  # in a byte; larger counts are sent in several

BREAK, GAP, WORD = 0, 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[[9, 32]] = GAP
KIND[[10, 11, 12, 13, *map(ord, ".,;:!?")]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SUMMED = "part int, hashes binary, counts binary"
COUNTED = "lang string, size int, phrase string, n long"
COUNTED_SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
COUNTED_NAMES = COUNTED_SCHEMA.names


class Slice:
    """Words of a slice of texts: their hashes, bytes and n-grams. The end of a piece is the end of what may be a phrase."""

    def __init__(self, batch: pa.RecordBatch):
        raw, at = text_bytes(batch.column("text"), lower=False)
        self.data = LOWER[raw]
        kind = KIND[self.data]
        edge = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge[at[:-1][at[:-1] < len(kind)]] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(kind))[:len(begin)]
        wanted = kind[begin] == WORD
        self.begin, self.end = begin[wanted], end[wanted]
        self.text = np.searchsorted(at, self.begin, "right") - 1
        breaks = np.searchsorted(np.flatnonzero(kind == BREAK), self.begin)
        self.joined = (breaks[1:] == breaks[:-1]) & (self.text[1:] == self.text[:-1])
        langs = ["und" if x is None else x for x in batch.column("lang").to_pylist()]
        self.names, code = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = code[self.text]
        seeds = np.array([_seed(x) for x in self.names], U64)
        words = hashed_runs(self.data, self.begin, self.end)
        n = len(words)
        one = mix64(words * U64(0xD6E8FEB86659FD93) + seeds[self.lang])
        two = mix64(one[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])
        three = mix64(two[:max(0, n - 2)] * U64(0xD1B54A32D192ED03) + words[2:])
        self.hashes = [one, two, three]
        self.whole = [np.ones(n, bool), self.joined, self.joined[:-1] & self.joined[1:]]

    def phrases(self, first: np.ndarray, size: int) -> pa.Array:
        """Words joined by blanks, from each place of ``first`` on."""
        begins = [self.begin[first + k] for k in range(size)]
        lengths = [self.end[first + k] - begins[k] for k in range(size)]
        ends = np.cumsum(sum(lengths) + size - 1)
        at = ends - sum(lengths) - (size - 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        for begin, length in zip(begins, lengths):
            step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            out[np.repeat(at, length) + step] = self.data[np.repeat(begin, length) + step]
            at = at + length + 1
        offsets = np.append(0, ends).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])

    def possible(self, size: int, bits: np.ndarray | None) -> np.ndarray:
        """Places of the n-grams whose two shorter ones, or with ``size`` 1 all, are in the map."""
        ok = self.whole[size - 1]
        if bits is not None:
            shorter = self.whole[size - 2] & marked(bits, self.hashes[size - 2])
            ok = ok & shorter[:-1] & shorter[1:]
        return np.flatnonzero(ok)


def _seed(text: str) -> int:
    raw = np.frombuffer(text.encode() or b"\0", np.uint8)
    return int(hashed_runs(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0]) ^ len(text)


def marked(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether the map has the bit of each hash."""
    place = hashes >> U64(64 - BITS)
    return (bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), names)], [name for name, _ in names])


def _packed(held: list[tuple[np.ndarray, np.ndarray]], part_bits: int) -> pa.RecordBatch:
    """Counts by hash partition: the bits of a hash that follow those of its partition, and how often it came."""
    keys, counts = combined(*(np.concatenate(x) for x in zip(*held)))
    times = (counts - 1) // MOST_COUNT + 1
    last = np.cumsum(times) - 1
    rest = counts - (times - 1) * MOST_COUNT
    keys, counts = np.repeat(keys, times), np.full(int(times.sum()), MOST_COUNT)
    counts[last] = rest
    part = (keys >> U64(KEPT_BITS)).astype(np.int64)
    low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEPT_BITS // 8]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    counts = counts.astype(np.uint8)
    return _batch([(int(part[a]), low[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(first, np.append(first[1:], len(part)))], SUMMED)


def _summarize(size: int, part_bits: int, shared):
    """Counts of the n-grams of ``size`` words by partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, limit=SLICE_BYTES):
            s = Slice(batch)
            values = s.hashes[size - 1][s.possible(size, shared and shared.value)]
            if len(values):
                held.append(np.unique(values >> U64(64 - part_bits - KEPT_BITS), return_counts=True))
                n += len(held[-1][0])
            if n > HELD:
                yield _packed(held, part_bits)
                held, n = [], 0
        if held:
            yield _packed(held, part_bits)

    return run


class MisraGries:
    """A mergeable summary: counts that are too low by ``taken`` at most; whatever is not in it came ``taken`` times at most."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        keys, counts = combined(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        self.taken += taken
        if len(keys) > self.capacity:
            less = int(np.partition(counts, len(keys) - self.capacity - 1)[len(keys) - self.capacity - 1])
            counts = counts - less
            keys, counts = keys[counts > 0], counts[counts > 0]
            self.taken += less
        self.keys, self.counts = keys, counts

    def possible(self, least: int) -> np.ndarray:
        """Keys that may have come ``least`` times."""
        return self.keys[self.counts + self.taken >= least]


def _survivors(part_bits: int, least: int, factor: int):
    """The piece of the map that belongs to a hash partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mass = [], 0
        for batch in batches:
            for part, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "counts"))):
                rows.append((np.frombuffer(hashes, np.uint8).reshape(-1, KEPT_BITS // 8), np.frombuffer(counts, np.uint8)))
                mass += int(rows[-1][1].sum(dtype=np.int64))
        summary = MisraGries(factor * (mass // least + 1))
        waiting, held = [], 0
        for i, (low, counts) in enumerate(rows):
            keys = np.zeros((len(low), 8), np.uint8)
            keys[:, :KEPT_BITS // 8] = low
            waiting.append((keys.view("<u8")[:, 0].astype(U64), counts.astype(np.int64)))
            held += len(low)
            if held > summary.capacity or i == len(rows) - 1:
                summary.merge(*(np.concatenate(x) for x in zip(*waiting)))
                waiting, held = [], 0
        piece = np.zeros(1 << (BITS - part_bits), bool)
        piece[(summary.possible(least) >> U64(KEPT_BITS - (BITS - part_bits))).astype(np.int64)] = True
        yield _batch([(part, np.packbits(piece, bitorder="little").tobytes())], "part int, bits binary")

    return run


def _map(counted: DataFrame, part_bits: int, least: int) -> np.ndarray:
    """The map of the n-grams that may be frequent. Its size is fixed, so the driver may hold it."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (BITS - 3 - part_bits)
    for row in counted.groupBy("part").applyInArrow(_survivors(part_bits, least, CAPACITY_FACTOR), "part int, bits binary").collect():
        bits[row.part * size:(row.part + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bits


def _blobs(table: pa.Table) -> pa.RecordBatch:
    """Rows of a table by partition, in order, so that they compress well."""
    table = table.sort_by([(c, "ascending") for c in ("part", "lang", "size", "phrase")])
    part = table.column("part").to_numpy()
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    rows = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, COUNTED_SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(a, b - a).select(COUNTED_NAMES).combine_chunks())
        rows.append((int(part[a]), out.getvalue().to_pybytes()))
    return _batch(rows, "part int, rows binary")


def _summed(least: int):
    """Rows of blobs with equal words added up; those that come ``least`` times stay, and all of size 0."""
    def total(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(COUNTED_NAMES[:3]).aggregate([("n", "sum")]).rename_columns(COUNTED_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = [], 0
        for batch in batches:
            for blob in batch.column("rows"):
                tables.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                held += tables[-1].num_rows
                if held > HELD:
                    tables, held = [total(tables)], 0
        whole = total(tables).cast(COUNTED_SCHEMA)
        yield from whole.filter((pc.field("n") >= least) | (pc.field("size") == 0)).to_batches()

    return run


def _count(maps: list, part_bits: int):
    """Occurrences of the n-grams in the maps, and of all words as size 0, per task or some slices of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hashes in order with their counts, and in order of appearance their languages, sizes and words.
        seen, total, named, words = np.zeros(0, U64), np.zeros(0, np.int64), [], {}

        def flush() -> pa.RecordBatch:
            which = np.argsort(np.concatenate([k for k, *_ in named]), kind="stable")
            langs, sizes = (np.concatenate([x[i] for x in named])[which] for i in (1, 2))
            phrases = pa.concat_arrays([x[3] for x in named]).take(pa.array(which))
            return _blobs(pa.table([pa.array((seen >> U64(64 - part_bits)).astype(np.int32)), pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), phrases, pa.array(total, pa.int64())], ["part", *COUNTED_NAMES]))

        for batch in slices(batches, limit=SLICE_BYTES):
            s = Slice(batch)
            for k, n in enumerate(np.bincount(s.lang, minlength=len(s.names)).tolist()):
                if n:
                    words[str(s.names[k])] = words.get(str(s.names[k]), 0) + n
            for size in (1, 2, 3):
                places = s.possible(size, maps[size - 2].value if size > 1 else None)
                places = places[marked(maps[size - 1].value, s.hashes[size - 1][places])]
                keys, first, counts = np.unique(s.hashes[size - 1][places], return_index=True, return_counts=True)
                at = np.searchsorted(seen, keys)
                new = np.append(seen, U64(0))[at] != keys
                new |= at == len(seen)
                total[at[~new]] += counts[~new]
                if new.any():
                    seen, total = np.insert(seen, at[new], keys[new]), np.insert(total, at[new], counts[new])
                    first = places[first[new]]
                    named.append((keys[new], s.names[s.lang[first]], np.full(len(first), size, np.int8), s.phrases(first, size)))
            if len(seen) > HELD_PHRASES:
                yield flush()
                seen, total, named = np.zeros(0, U64), np.zeros(0, np.int64), []
        if named:
            yield flush()
        if words:
            parts = [int(_seed(lang) >> (64 - part_bits)) for lang in words]
            yield _blobs(pa.table([pa.array(parts, pa.int32()), pa.array(words, pa.string()), pa.array([0] * len(words), pa.int32()), pa.array([""] * len(words)), pa.array(words.values(), pa.int64())], ["part", *COUNTED_NAMES]))

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, n): n-grams of one to three words that come ``least`` times in their language, and as size 0 all its words."""
    texts = docs.select("text", "lang")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # n-grams of a size are at most as many as bytes
    part_bits = min(MOST_PART_BITS, max(LEAST_PARTS - 1, size // PART_MASS).bit_length())
    maps = []
    for size in (1, 2, 3):
        counted = texts.mapInArrow(_summarize(size, part_bits, maps[-1] if maps else None), SUMMED)
        maps.append(docs.sparkSession.sparkContext.broadcast(_map(counted, part_bits, least)))
    return texts.mapInArrow(_count(maps, part_bits), "part int, rows binary").groupBy("part").applyInArrow(_summed(least), COUNTED)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best ``top`` phrases of each language of (text, lang)."""
    found = cut(frequent_phrases(docs, least), "phrases")
    words = F.split("phrase", " ")
    longer = found.where("size = 3").select("lang", F.col("n").alias("in_longer"), F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("in_longer").alias("in_longer"))
    pairs = found.where("size = 2").join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("in_longer") < inside * F.col("n"), F.lit(True)))
    kept = pairs.select("lang", "size", "phrase", F.col("n").alias("a")).unionByName(found.where("size = 3").select("lang", "size", "phrase", F.col("n").alias("a")))
    part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    halves = F.struct(F.lit(1).alias("k"), part(1, 1).alias("left"), part(2, F.col("size") - 1).alias("right"))
    halves_3 = F.struct(F.lit(2).alias("k"), part(1, 2).alias("left"), part(3, 1).alias("right"))
    cuts = kept.withColumn("cut", F.explode(F.when(F.col("size") == 2, F.array(halves)).otherwise(F.array(halves, halves_3)))).select("lang", "phrase", "a", "cut.*")
    parts = broadcast_if_small(found.where("size IN (1, 2)").select("lang", "phrase", "n"))
    for side in ("left", "right"):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])), ["lang", side])
    wide = "decimal(38,0)"
    score = F.expr(f"CAST({SCALE} AS {wide}) * CAST(a AS {wide}) * CAST(a AS {wide}) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # The best of parts of a language first, so that no task ranks more than some thousands of rows for each part.
    best_first = (F.col("low.score").desc(), F.col("a").desc(), "phrase")
    dealt = scored.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best_first))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", "n")
    return ranked.join(broadcast_if_small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")
