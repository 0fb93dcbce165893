"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word that was seen in training is scored by its log frequency in each language. A word that was not is scored by its
character n-grams: the longest length of which it has a known n-gram counts, by the mean of their log frequencies. A text's
score is the sum over its words; the language with the largest sum is the prediction, and its share of the likelihoods, with
the sum tempered to the length of a short text, is the score.

The model is fitted on a bounded sample of the labelled texts: at most about ``TEXTS`` per language, drawn by hash over all of
them. At most ``VOCABULARY`` words and as many n-grams, the most frequent ones, are kept; the rest is what the backing off is for.
Prediction reads every whole text, and nothing but the text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; the smaller name wins a tie; without any training
text all are ``und``; a text of which nothing is known has the most frequent languages' prior. A row with a null language is
predicted but never learned from; a null ``doc_id`` is held out. Equal rows are predicted alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenorline.llm.grams import slices

TEXTS = 4_000
VOCABULARY = 200_000
LONGEST = 5
SMOOTHING = 0.1
FOLDS = 5
EVIDENCE = 20.0  # a text's sum counts as that of so many words at most

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    counts = Counter(WORD.findall(text.lower())) if text else Counter()
    for word in [w for w in counts if not w.isalpha()]:  # the pattern also takes numbers that are no decimal digits
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


def ngrams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per language of a partition, in pieces of bounded size."""
    held: dict[str, Counter] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, counts in held.items() for word, n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[], [], []], (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            counts = held.setdefault(lang, Counter())
            before = len(counts)
            counts.update(words_of(text))
            size += len(counts) - before
        if size > 500_000:
            yield out()
            held.clear()
            size = 0
    yield out()


class Model:
    """Log frequencies: arrays over the sorted languages by word, and by n-gram."""

    def __init__(self, counts: list[tuple[str, str, int]], prior: dict[str, int], vocabulary: int = VOCABULARY):
        self.langs = sorted(prior)
        place = {lang: i for i, lang in enumerate(self.langs)}
        size = len(self.langs)
        words: dict[str, np.ndarray] = {}
        for lang, word, n in counts:
            words.setdefault(word, np.zeros(size))[place[lang]] += n
        grams: dict[str, np.ndarray] = {}
        for word, row in words.items():
            for n in range(1, LONGEST + 1):
                for gram in ngrams(word, n):
                    held = grams.get(gram)
                    grams[gram] = row.copy() if held is None else held + row
        self.words = self._logs(words, vocabulary)
        self.grams = self._logs(grams, vocabulary)
        total = np.array([prior[lang] for lang in self.langs], float)
        self.prior = np.log((total + 1) / (total + 1).sum()) if size else np.zeros(0)

    @staticmethod
    def _logs(table: dict[str, np.ndarray], bound: int) -> tuple[dict[str, int], np.ndarray]:
        """Row of each key, and the rows."""
        if not table:
            return {}, np.zeros((0, 0), np.float32)
        keys, rows = list(table), np.array(list(table.values()))
        order = sorted(range(len(keys)), key=lambda i: (-rows[i].sum(), keys[i]))[:bound]
        logs = np.log((rows[order] + SMOOTHING) / (rows.sum(axis=0) + SMOOTHING * len(keys))).astype(np.float32)
        return {keys[i]: place for place, i in enumerate(order)}, logs

    def word(self, word: str) -> np.ndarray | None:
        place, logs = self.words
        if word in place:
            return logs[place[word]]
        place, logs = self.grams
        for n in range(LONGEST, 0, -1):
            rows = [place[g] for g in ngrams(word, n) if g in place]
            if rows:
                return logs[rows].mean(axis=0)
        return None

    def predict(self, text: str | None, memory: dict) -> tuple[str, float]:
        counts = words_of(text)
        if not counts or not self.langs:
            return "und", 0.0
        rows = []
        for word in counts:
            row = memory.get(word)
            if row is None:
                row = self.word(word)
                row = memory[word] = np.zeros(len(self.langs), np.float32) if row is None else row
            rows.append(row)
        total = sum(counts.values())
        scores = np.fromiter(counts.values(), np.float64, len(counts)) @ np.array(rows, np.float64)
        scores = self.prior + scores * min(1.0, EVIDENCE / total)
        best = int(np.argmax(scores))
        return self.langs[best], float(1 / np.exp(scores - scores[best]).sum())


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        for part in slices(batches):
            found = [model.predict(t, memory) for t in part.column("text").to_pylist()]
            if len(memory) > 100_000:
                memory.clear()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out() -> Column:
    """Whether a row is of the fold that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, texts: int = TEXTS, vocabulary: int = VOCABULARY) -> Model:
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    prior = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not prior:
        return Model([], {})
    share = F.create_map(*[x for lang, n in prior.items() for x in (F.lit(lang), F.lit(min(1.0, texts / n)))])
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = drawn.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    per_word = counted.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    kept = per_word.orderBy(F.col("all").desc(), "word").limit(vocabulary).collect()
    return Model([(lang, r["word"], n) for r in kept for lang, n in r["by"].items()], prior, vocabulary)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
