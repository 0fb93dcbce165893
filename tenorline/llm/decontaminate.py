"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared in lower case, as UTF-8 bytes, with every run of other characters than letters, marks and
digits as one blank; characters of any script are told apart by their Unicode category. An
item of m bytes leaks into a text if some region of the text is within ``budget(m)`` edits of the whole item. Each
edit destroys at most q of the item's m - q + 1 q-grams, so such a region shares m - q + 1 - q * budget of them with the
item, all on diagonals (place in the text minus place in the item) that differ by at most the budget. Shared q-grams are
counted in overlapping bands of diagonals of twice that width; bands that reach the bound are verified by banded alignment.

The items are taken in blocks of at most ``BLOCK_CHARS`` characters, each a broadcast of bounded size; every text meets
every block. Within a task a slice of texts is compared at once, and postings are counted ``POSTINGS`` at a time; bands that lie behind
are verified or dropped before the next ones, so memory is bounded by the slice, the block and that.

Defined cases: a null or empty text leaks nothing; an item that is null or normalizes to nothing never matches; one that
normalizes to fewer than ``Q`` bytes has no q-gram and leaks where a text holds it whole between blanks; an item longer than a block is a block of its own; items with equal texts all match; equal rows
are reported each; a null ``doc_id`` or ``item_id`` is reported as null. Other columns are ignored, or carried along by
``clean_documents``. Of several regions the one with the fewest edits, then the first, is reported.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorline.llm.grams import CLASS, U64, WORD, mix64, slices, text_bytes

Q = 12
ERROR_RATE = 0.05
BLOCK_CHARS = 1 << 20
SIEVE_BITS = 20
POSTINGS = 1 << 20
MATCH = "array<struct<item_id: bigint, edits: int, start: bigint, stop: bigint>>"
BLANK = 32


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item: ``rate`` of its length, and few enough that the q-gram bound is positive."""
    return max(0, min(int(length * rate), (length - Q) // Q))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether each code point is a letter, a mark or a digit."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)])


def in_words(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter, a mark or a digit."""
    word = (CLASS[data] == WORD) & (data != ord("_"))
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        code = padded[lead] & (0x7F >> size)
        for k in (1, 2, 3):
            code = np.where(size > k, code << 6 | padded[lead + k] & 0x3F, code)
        other = ~word_characters()[code]
        for k in range(4):
            word[lead[other & (size > k)] + k] = False
    return word


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized bytes of all texts, where each text begins, and the place of each byte in the lower-case bytes.

    Every text is followed by Q blanks, which no item holds, so no q-gram of an item crosses two texts.
    """
    data, at = text_bytes(column)
    word = in_words(data)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = word.copy()
    if len(data):
        opens = np.zeros(len(data), bool)  # the first other byte after a word, in the same text
        opens[1:] = ~word[1:] & word[:-1] & (text[1:] == text[:-1])
        keep |= opens
    place = np.flatnonzero(keep)
    sizes = np.bincount(text[place], minlength=len(at) - 1)
    begin = np.concatenate(([0], np.cumsum(sizes + Q)))
    out = np.full(begin[-1], BLANK, np.uint8)
    target = np.arange(len(place)) + np.repeat(np.arange(len(sizes)) * Q, sizes)
    out[target] = np.where(word[place], data[place], BLANK)
    source = np.zeros(begin[-1], np.int64)
    source[target] = place
    return out, begin, source


def qgrams(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each place on."""
    if len(data) < Q:
        return np.zeros(0, U64)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[:len(data) - 4].copy().view("<u8").ravel()
    return eight[:-4] * U64(0x9E3779B97F4A7C15) + eight[4:]


class Items:
    """A block of benchmark items with the postings of their q-grams."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        data, begin, _ = normalized(pa.array([t or "" for _, t in rows], pa.large_string()))
        self.ids, self.texts, grams, item, place = [], [], [], [], []
        self.short: dict[bytes, list[int | None]] = {}
        for (item_id, _), a, b in zip(rows, begin[:-1], begin[1:]):
            text = bytes(data[a:b]).rstrip()
            if 0 < len(text) < Q:
                self.short.setdefault(text, []).append(item_id)
            elif text:
                own = qgrams(np.frombuffer(text, np.uint8))
                grams.append(own)
                item.append(np.full(len(own), len(self.ids), np.int64))
                place.append(np.arange(len(own)))
                self.ids.append(item_id)
                self.texts.append(text)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t)) for t in self.texts], np.int64)
        self.least = self.size - Q + 1 - Q * self.edits
        flat = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (mix64(grams) >> U64(64 - SIEVE_BITS)).astype(np.int64)

    def bands(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands of ``data`` that hold enough shared q-grams."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.grams) or len(data) < Q:
            return none
        grams = qgrams(data)
        at = np.flatnonzero(self.sieve[self._slot(grams)])
        slot = np.searchsorted(self.grams, grams[at])
        slot[slot == len(self.grams)] = 0
        real = self.grams[slot] == grams[at]
        at, slot = at[real], slot[real]
        if not len(at):
            return none
        many = self.count[slot]
        longest, wide = int(self.size.max()), len(data) + int(self.size.max()) + 2
        parts = np.searchsorted(np.cumsum(many), np.arange(POSTINGS, int(many.sum()) + POSTINGS, POSTINGS))
        keys = counts = np.zeros(0, np.int64)
        found, start = [], 0
        for stop in np.unique(np.minimum(parts + 1, len(at))):
            own, places = slot[start:stop], at[start:stop]
            n = many[start:stop]
            posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[own], n)
            item = self.item[posting]
            diagonal = np.repeat(places, n) - self.place[posting] + longest
            new, n = np.unique(item * wide + diagonal // (self.edits[item] + 1), return_counts=True)
            keys, where = np.unique(np.concatenate((keys, new)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)
            width = self.edits[keys // wide] + 1
            # later places have diagonals from here on, so this band and the next are complete
            done = (keys % wide + 2) * width <= places[-1] - self.size[keys // wide] + longest if stop < len(at) else np.ones(len(keys), bool)
            following = np.zeros(len(keys), np.int64)
            following[:-1] = np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
            found.append(keys[done & (counts + following >= self.least[keys // wide])])
            keys, counts, start = keys[~done], counts[~done], stop
        keys = np.sort(np.concatenate(found))
        item = keys // wide
        return item, keys % wide * (self.edits[item] + 1) - longest

    def short_leaks(self, data: np.ndarray, begin: np.ndarray) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item_id, 0, start, stop) of the first place where a text holds an item without a q-gram whole between blanks."""
        out = []
        if not self.short:
            return out
        blank = data == BLANK
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        for m in sorted({len(t) for t in self.short}):  # fewer than Q lengths; a text is followed by Q blanks
            at = starts[starts + m < len(data)]
            at, seen = at[blank[at + m]], set()
            windows = np.lib.stride_tricks.sliding_window_view(data, m)[at] if len(at) else np.zeros((0, m), np.uint8)
            texts = np.searchsorted(begin, at, "right") - 1
            for place, text, window in zip(at.tolist(), texts.tolist(), np.ascontiguousarray(windows).view(f"V{m}").ravel()):
                key = bytes(window)
                if key in self.short and (text, key) not in seen:
                    seen.add((text, key))
                    out += [(text, item_id, 0, place, place + m) for item_id in self.short[key]]
        return out


def align(item: np.ndarray, text: np.ndarray, width: int) -> tuple[int, int]:
    """Fewest edits of the whole ``item`` against a region of ``text`` that starts in its first ``width`` places, and the region's end.

    One row of the table per character of the item; only diagonals 0 to ``width`` are kept.
    """
    padded = np.concatenate((text, np.zeros(max(0, len(item) + width + 1 - len(text)), np.uint8)))
    steps = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)
    for i, c in enumerate(item):
        new = row + (padded[i:i + width + 1] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), min(len(text), len(item) + end)


def leaks(items: Items, data: np.ndarray, begin: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) to (edits, start, stop) in ``data``."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, diagonal in zip(*items.bands(data)):
        k, m, wanted = int(items.edits[item]), int(items.size[item]), items.texts[item]
        low, high = int(diagonal) - k, int(diagonal) + 2 * (k + 1) + k  # where the region may start
        middle = min(max(0, (low + high + m) // 2), len(data) - 1)
        text = int(np.searchsorted(begin, middle, "right")) - 1
        first, last = int(begin[text]), int(begin[text + 1]) - Q
        low, stop = max(low, first), min(high + m + k, last)
        if stop - low < m - k:
            continue
        region = data[low:stop]
        exact = region.tobytes().find(wanted)
        if exact >= 0:
            found = (0, low + exact, low + exact + m)
        else:
            pattern = np.frombuffer(wanted, np.uint8)
            edits, end = align(pattern, region, max(1, high - low))
            if edits > k:
                continue
            back, size = align(pattern[::-1], region[:end][::-1], 2 * k + 1)
            found = (min(edits, back), low + max(0, end - size), low + end)
        key = (text, int(item))
        if key not in best or found < best[key]:
            best[key] = found
    return best


def _find(items: Items, columns: list[str], matches: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        for part in slices(batches):
            column = part.column("text")
            data, begin, source = normalized(column)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            hits, short = leaks(items, data, begin), items.short_leaks(data, begin)
            if hits or short:
                low, at = text_bytes(column)
                letters = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))  # characters before each byte
            named = [(text, items.ids[item], edits, start, stop) for (text, item), (edits, start, stop) in sorted(hits.items())] + short
            for text, item_id, edits, start, stop in named:
                a, b = source[start], source[stop - 1] + 1
                origin = letters[at[text]]
                while b < at[text + 1] and low[b] & 0xC0 == 0x80:
                    b += 1
                found[text].append({"item_id": item_id, "edits": edits, "start": int(letters[a] - origin), "stop": int(letters[b] - origin)})
            earlier = part.column(matches).to_pylist() if matches in part.schema.names else [[]] * part.num_rows
            both = pa.array([[*(x or []), *y] for x, y in zip(earlier, found)], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), both], [*columns, matches])

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, matches: str = "leaks", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` and the array of its leaks: item_id, edits, start and stop in characters of the lower-case text."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_chars))
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").where(of == block).collect()]
        items = docs.sparkSession.sparkContext.broadcast(Items(rows))
        docs = docs.mapInArrow(_scan(items, columns, matches), f"{fields}, `{matches}` {MATCH}")
    return docs


def _scan(shared, columns: list[str], matches: str):
    return lambda batches: _find(shared.value, columns, matches)(batches)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start and stop: one row per leaking document and leaked item."""
    rows = with_leaks(docs.select("doc_id", "text"), benchmark).where(F.size("leaks") > 0)
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks."""
    name = "leaks"
    while name in docs.columns:
        name += "_"
    return with_leaks(docs, benchmark, name).where(F.size(name) == 0).drop(name)
