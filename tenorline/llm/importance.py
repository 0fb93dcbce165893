"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are compared: one of the target text, labelled ``quality`` = 1, and one of the
raw text, all documents. A document's log weight is the sum over its grams of log(p_target / p_raw). A document is
target-like if its log weight reaches the cut that tells labelled good from labelled bad documents best. As many
documents as are target-like are drawn by Gumbel top-k: noise from a seeded hash is added to each log weight and the
largest keys win. The k-th largest key is found exactly by counting keys digit by digit, never by sorting.

Grams are words, runs of marks and their pairs; a token after itself is one gram of its own whatever the token, so that
drivel of repeated words is told from prose.

Defined cases: a null or empty text, and one of blanks only, has no gram and log weight 0; labels of a null ``doc_id`` or
with null ``quality`` are ignored, and a document with both labels counts as its lower one; without good and bad labelled
documents nothing can be learned and every document is kept. Equal rows get equal keys; all rows at the k-th key are
kept. A null ``doc_id`` is scored like others. Other columns are ignored, or carried along by ``good_documents``.

``LABELLED`` bounds the labelled sample per class that the target model and the cut are fitted on; the raw model and k
cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenorline.llm.grams import U64, mix64, slices, text_bytes, tokens
from tenorline.llm.runtime import broadcast_if_small, cut

BUCKETS = 1 << 14
LABELLED = 20_000
SMOOTHING = 0.5
SEED = 17
DIGIT_BITS = 12

_REPEAT = U64(0x51ED270B0F5B3E21)


def bucketed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of a text column, and grams per text."""
    data, at = text_bytes(column)
    hashed, counts = tokens(data, at, marks=True)
    if not len(hashed):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    inner = text[1:] == text[:-1]
    same = hashed[1:] == hashed[:-1]
    pairs = np.where(same, _REPEAT, mix64(hashed[:-1] * U64(3) + hashed[1:]))[inner]
    both = np.concatenate((hashed, pairs))
    of = np.concatenate((text, text[1:][inner]))
    order = np.argsort(of, kind="stable")
    return (both[order] >> U64(64 - 14)).astype(np.int64), np.bincount(of, minlength=len(counts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part in slices(batches):
        grams, counts = bucketed(part.column("text"))
        raw += np.bincount(grams, minlength=BUCKETS)
        good = np.repeat(part.column("good").to_numpy(zero_copy_only=False).astype(bool), counts)
        target += np.bincount(grams[good], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(labelled_id, good): at most ``bound`` documents of either class, those of the smallest hash."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rows.select(F.col("doc_id").alias("labelled_id"), (F.col("quality") > 0).alias("good"))
    order = F.xxhash64("labelled_id"), "labelled_id"
    return rows.where("good").orderBy(*order).limit(bound).unionByName(rows.where("NOT good").orderBy(*order).limit(bound))


def fit(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio per bucket. What reaches the driver are BUCKETS sums."""
    marked = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("labelled_id"), "left").select(docs["text"], F.coalesce("good", F.lit(False)).alias("good"))
    counted = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    share = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target) / share(raw))


def _weigh(ratio: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, counts = bucketed(part.column("text"))
            sums = np.concatenate(([0.0], np.cumsum(ratio[grams])))
            ends = np.cumsum(counts)
            weights = np.round(sums[ends] - sums[ends - counts], 6) + 0.0
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(weights)], [*columns, "log_weight"])

    return run


def log_weights(docs: DataFrame, ratio: np.ndarray, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``docs``, which has ``text``, and log_weight."""
    fields = [*(f for f in docs.schema.fields if f.name in carried)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", log_weight double"
    return docs.select(*carried, "text").mapInArrow(_weigh(ratio, carried), schema)


def best_cut(scored: list[tuple[float, bool]]) -> float | None:
    """The weight that splits (weight, good) pairs with the least sum of both error rates; the middle of the gap there."""
    good, bad = np.sort([w for w, g in scored if g]), np.sort([w for w, g in scored if not g])
    if not len(good) or not len(bad):
        return None
    values = np.unique(np.concatenate((good, bad)))
    errors = np.searchsorted(good, values) / len(good) + (len(bad) - np.searchsorted(bad, values)) / len(bad)
    k = int(np.argmin(errors))
    return float(values[k]) if k == 0 else float((values[k - 1] + values[k]) / 2)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of ``key``."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the non-negative long column ``digits``, from counts per digit."""
    found, bits = 0, 60
    while bits > 0:
        bits -= DIGIT_BITS
        digit = F.shiftright("digits", bits)
        counts = keys.where(F.shiftright("digits", bits + DIGIT_BITS) == found).groupBy(digit.alias("digit")).count().collect()
        for row in sorted(counts, key=lambda r: -r["digit"]):
            if k <= row["count"]:
                found = row["digit"]
                break
            k -= row["count"]
    return found


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, bound: int = LABELLED) -> DataFrame:
    """doc_id, text_hash, log_weight, sample_key and kept per row of ``docs``."""
    sample = cut(labelled_sample(labels, bound), "labelled")
    ratio = fit(docs.select("doc_id", "text"), sample)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    noise = gumbel(F.struct("doc_id", "text_hash"), seed)
    keyed = log_weights(rows, ratio, ["doc_id", "text_hash"]).withColumn("sample_key", F.col("log_weight") + noise)
    # order-preserving whole numbers: keys are sums of logs, far below the bounds of this scale
    digits = F.least(F.greatest(F.round(F.col("sample_key") * 1e6).cast("long") + F.lit(1 << 58), F.lit(0)), F.lit((1 << 60) - 1))
    keyed = cut(keyed.withColumn("digits", digits), "weights")
    scored = keyed.join(F.broadcast(sample), keyed["doc_id"] == F.col("labelled_id")).groupBy("labelled_id").agg(F.min_by("log_weight", "text_hash").alias("w"), F.first("good").alias("g"))
    level = best_cut([(r.w, r.g) for r in scored.collect()])  # a row per id of the sample: 2 * bound at most
    out = ["doc_id", "text_hash", "log_weight", "sample_key"]
    if level is None:
        return keyed.select(*out, F.lit(True).alias("kept"))
    k = keyed.where(F.col("log_weight") >= level).count()
    least = kth_largest(keyed, k) if k else 1 << 60
    return keyed.select(*out, (F.col("digits") >= least).alias("kept"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, sample_key and kept per row of ``docs``."""
    return resample(docs, labels).drop("text_hash")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the draw keeps."""
    drawn = resample(docs, labels).where("NOT kept").select(F.col("doc_id").alias("out_id"), F.col("text_hash").alias("out_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("out_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("out_hash"))
    return docs.join(broadcast_if_small(cut(drawn, "rejected")), same, "left_anti")
