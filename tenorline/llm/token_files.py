"""Token ids of whole texts in Parquet files that can be read selectively.

The files are Spark's own Parquet: an ``ids`` list column (dictionary pages, delta-packed where the dictionary overflows),
row groups of ``ROW_GROUP_BYTES`` and small pages with the column and offset indexes that the writer adds. ``doc_id`` and
``n_tokens`` are columns of their own, so counts and offsets are read without any token page. Rows lie in ascending
``doc_id`` order: files are ranges of it, ``shard`` numbers them, and ``begin`` counts the ids before a row in its shard.

Encoding goes through a memory of text pieces. The bytes of many texts are cut at once into words, numbers, marks, white
space and rests, always at places where the tokenizer's own splitting cuts too, so the ids are those of the whole text.
Each distinct piece of a slice is looked up once; pieces that are not remembered, and whole texts holding a special token,
are given to the tokenizer. A tokenizer that normalizes or splits in another way than byte-level vocabularies do gets
whole texts only.

Defined cases: a null or empty text has the end id only; a null ``doc_id`` comes first; rows with equal ids are ordered by
a hash of their text, then by the text, and equal rows lie side by side; other columns are ignored; no rows give an empty table.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenorline.llm.grams import slices, text_bytes
from tenorline.llm.runtime import broadcast_if_small, scratch

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PIECE_BYTES = 64  # longer pieces are not remembered
PIECES = 300_000  # pieces in a worker's new memory; the old one has about as many

# Kinds of bytes. Both bytes of a Latin letter with a mark are letters, a WIDE byte begins another character that is no white
# space. Nothing is known of OTHER bytes: control characters, those that may begin wide blanks, and all that follow a first byte.
OTHER, SPACE, BREAK, LETTER, DIGIT, MARK, QUOTE, WIDE = range(8)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*b"\t\n\v\f\r"]] = BREAK
KIND[[*b"0123456789"]] = DIGIT
KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = LETTER
KIND[ord(" ")], KIND[ord("'")] = SPACE, QUOTE
KIND[[*range(0xC3, 0xE1), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] = WIDE

# By the kinds of a byte and the next: whether the tokenizer's pattern cuts between them, and whether it cuts before the first,
# the last blank before something visible. A quote may begin a contraction, so it is never cut from letters that follow.
_SEEN = [LETTER, DIGIT, MARK, QUOTE, WIDE]
BETWEEN, BEFORE = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
BETWEEN[LETTER, [SPACE, BREAK, DIGIT, MARK, QUOTE]] = True
BETWEEN[DIGIT, [SPACE, BREAK, LETTER, MARK, QUOTE]] = True
BETWEEN[MARK, [SPACE, BREAK, LETTER, DIGIT]] = True
BETWEEN[QUOTE, [SPACE, BREAK, DIGIT]] = True
BETWEEN[BREAK, _SEEN] = BEFORE[SPACE, _SEEN] = BEFORE[BREAK, _SEEN] = True

# Pieces that the tokenizer's splitting leaves whole.
_SINGLE = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u021f]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|[ \t-\r]+")

# The characters by which byte-level vocabularies write the bytes that print nothing.
_SHOWN = {byte: 0x100 + place for place, byte in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
FILE_SCHEMA = "doc_id long, shard int, begin long, n_tokens long, ids array<int>"


def cuts(data: np.ndarray, at: np.ndarray, uncut: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, and one place more for the end; texts lie in ``data`` from ``at`` on, those with a true ``uncut`` stay whole."""
    kind = KIND[data]
    first = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    first = first[(data[first] != 0xC3) | (data[first + 1] & 0x3F != 0x17) & (data[first + 1] & 0x3F != 0x37)]  # no letters: the signs for times and divided by
    kind[first] = kind[first + 1] = LETTER
    cut = np.zeros(len(data) + 1, bool)
    pairs = kind[:-1] << 3 | kind[1:]
    cut[:len(pairs)] = BEFORE.ravel()[pairs]
    cut[at[1:][at[1:] > 0] - 1] = False  # what comes next is another text
    cut[1:len(pairs) + 1] |= BETWEEN.ravel()[pairs]
    for k in np.flatnonzero(uncut):
        cut[at[k] + 1:at[k + 1]] = False
    cut[at] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to little-endian 32-bit ids. Pieces not met for a while are forgotten: those in use move from the old memory to the new."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        split, model = form["pre_tokenizer"] or {}, form["model"]
        self.in_pieces = bool(split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and model["type"] == "BPE"
                              and not any(form[c] for c in ("normalizer", "truncation", "padding")) and not any(model.get(c) for c in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, piece: str) -> bytes:
        """Ids of a piece that needs no splitting, from the model itself."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]).tobytes()

    def pieces(self, distinct: list[bytes], unsplit: set[bytes]) -> list[bytes]:
        """Ids of pieces; those of ``unsplit`` are texts that hold a special token."""
        known, old = self.known, self.old
        coded = list(map(known.get, distinct))
        rest = []
        for k in [k for k, ids in enumerate(coded) if ids is None]:
            piece = distinct[k]
            ids = old.get(piece)
            if ids is None:
                text = piece.decode()
                if piece in unsplit or not _SINGLE.fullmatch(text):
                    rest.append((k, text))
                    continue
                ids = self.single(text)
            coded[k] = ids
            if len(piece) <= PIECE_BYTES:
                known[piece] = ids
        for (k, _), ids in zip(rest, self.whole([text for _, text in rest])):
            coded[k] = ids
            if len(distinct[k]) <= PIECE_BYTES:
                known[distinct[k]] = ids
        if len(known) > PIECES:
            self.known, self.old = {}, known
        return coded

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has. Nulls are empty."""
        if not self.in_pieces:
            coded = self.whole([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(coded), "<i4"), np.array([len(c) // 4 for c in coded], np.int64)
        data, at = text_bytes(texts, lower=False)
        if not len(data):
            return np.zeros(0, "<i4"), np.zeros(len(texts), np.int64)
        uncut = np.zeros(len(texts), bool)
        for token in self.special:
            uncut |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        begin = cuts(data, at, uncut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
        _, ends, distinct = pieces.dictionary.buffers()
        ends, distinct = np.frombuffer(ends, np.int64, len(pieces.dictionary) + 1).tolist(), distinct.to_pybytes()
        coded = self.pieces([distinct[a:b] for a, b in zip(ends, ends[1:])], {data[at[k]:at[k + 1]].tobytes() for k in np.flatnonzero(uncut)})
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        place, which = np.cumsum(sizes) - sizes, pieces.indices.to_numpy()
        size = sizes[which]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = np.frombuffer(b"".join(coded), "<i4")[np.repeat(place[which] - done[:-1], size) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(begin, at)])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.ids(pa.array(texts, pa.large_string()))
        return [ids[end - size:end].tobytes() for size, end in zip(sizes, np.cumsum(sizes))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, begin = encoder(path).ids, 0
        for part in slices(batches):
            ids, sizes = code(part.column("text"))
            ids = pa.array(np.insert(ids, np.cumsum(sizes), END_ID))
            sizes += 1
            at = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), pa.array(begin + at[:-1]), pa.array(sizes), lists], ["doc_id", "shard", "begin", "n_tokens", "ids"])
            begin += int(at[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Token files of ``docs`` below ``path``; ``tokenizer`` is a file of the tokenizers library that every worker can open."""
    tie = F.xxhash64("text")
    placed = docs.select("doc_id", F.col("text"), tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    rows = placed.select("doc_id", F.spark_partition_id().alias("shard"), "text").mapInArrow(_encode(tokenizer), FILE_SCHEMA)
    writer = rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", 5000)
    writer.option("parquet.writer.version", "PARQUET_2_0").option("compression", "snappy").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, n_tokens, ids) of token files."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        data = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "shard", "begin", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "shard", "begin", "n_tokens", "ids_crc32"])


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in token files.

    A start is ``begin`` plus the ids of the shards before; shards are few, their sums come from the ``n_tokens`` pages alone.
    """
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    summed = files.mapInArrow(_checksums, "doc_id long, shard int, begin long, n_tokens long, ids_crc32 long")
    return summed.join(broadcast_if_small(offsets), F.col("shard") == F.col("of")).select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of ``docs`` from token files written to the shared scratch folder."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_digests(read_tokens(docs.sparkSession, path))
