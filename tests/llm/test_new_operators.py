"""Spelling variants, collocations and nearest neighbours against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_support import CLASHING, DOCS, texts  # noqa: F401
from tenorline.llm import adaptive_scan, collocations, spelling

A_TO_Z = {i: i + 32 for i in range(65, 91)}


# --- spelling variants ---------------------------------------------------------------------------------------------

def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows: list[dict]) -> list[tuple]:
    count: Counter = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.get("text") or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if r.get('doc_id') is None else r['doc_id']}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, near_count = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        near_count[w], form[w] = len(others), best if best and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, near_count[w], words[form[w]] if form[w] else -1) for w, n in words.items())


def spelling_rows() -> list[dict]:
    rng = random.Random(5)
    base = ["straße", "Größe", "colour", "color", "grey matter", "aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "x" * 300, "x" * 299 + "y", "×÷×÷×", "naïve", "naive"]
    base += ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[:rng.randint(1, len(base))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + "z" + w[at:], w[:at] + "É" + w[at + 1:], w.upper()])
            words.append(w)
        rows.append({"doc_id": i if i % 19 else None, "text": rng.choice([" ", "-", "1", "\n"]).join(words), "size": 1, "node": "n"})
    return rows + rows[:9] + [{"doc_id": 7, "text": None}, {"doc_id": 8, "text": ""}, {"doc_id": 9, "text": "alone " * 4000 + "w" * 20_000}, {"doc_id": None, "text": "alone alone"}]


def got_variants(df) -> list[tuple]:
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_equal_plain_python(texts, tmp_path):
    rows = spelling_rows()
    docs = texts(tmp_path, rows, CLASHING, 4)
    want = plain_variants(rows)
    assert sum(x[1] != "" for x in want) > 20
    assert got_variants(spelling.group_variants(docs)) == want
    assert got_variants(spelling.group_variants(docs, unit_words=3)) == want  # crowded units as tiles of two parts


def test_variants_of_nothing(texts, tmp_path):
    assert spelling.group_variants(texts(tmp_path, [], DOCS)).collect() == []


def test_tiles_hold_each_pair_once():
    words = sorted(["abcde", "abcdf", "abcd", "xbcde", "abcdee", "aabcde", "bbcde"])
    for shorter in (4, 5):
        own = [w for w in words if len(w) in (shorter, shorter + 1)]
        zero = np.zeros(len(own), np.int64)
        a, b = spelling.near_pairs(own, zero, shorter, zero, zero, zero > 0)
        assert sorted((own[i], own[j]) for i, j in zip(a, b)) == sorted((x, y) for i, x in enumerate(own) for y in own[i + 1:] if near(x, y) and min(len(x), len(y)) == shorter)


# --- collocations -----------------------------------------------------------------------------------------------------

def plain_collocations(rows: list[dict], least: int, top: int) -> list[tuple]:
    f: Counter = Counter()
    totals: Counter = Counter()
    for r in rows:
        lang = "und" if r.get("lang") is None else r["lang"]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (r.get("text") or "").translate(A_TO_Z)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    candidates = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    out: dict[str, list] = {}
    for (lang, p), a in candidates.items():
        if len(p) == 2 and any(100 * n >= 50 * a for (x, q), n in candidates.items() if x == lang and len(q) == 3 and p in (q[:2], q[1:])):
            continue
        score, k, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, best in out.items() for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]))


def phrase_rows() -> list[dict]:
    rng = random.Random(11)
    words = ["New", "york", "city", "the", "of", "naïve", "É", "a b", "“so”", "x1"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        parts = [rng.choice(["new york city", "of the", rng.choice(words), rng.choice(words[:12])]) for _ in range(rng.randint(0, 40))]
        rows.append({"doc_id": i, "text": "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for p in parts), "lang": rng.choice(["en", "en", "de", "es", None, "und", ""])})
    rows += [{"doc_id": 900, "text": "en es en es " * 30, "lang": "es"}, {"doc_id": 901, "text": "es en " * 40, "lang": "en"}, {"doc_id": 902, "text": "a a a a a a a a a a a a a a", "lang": "fr"}]
    return rows + rows[:40] + [{"doc_id": 903, "text": None, "lang": "en"}, {"doc_id": 904, "text": "", "lang": None}, {"doc_id": 905, "text": ".,;", "lang": "xx"}, {"doc_id": 906, "text": "very long " * 50_000, "lang": "en"}]


def got_collocations(df) -> list[tuple]:
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_collocations_equal_plain_python(texts, tmp_path):
    rows = phrase_rows()
    got = collocations.collocations(texts(tmp_path, rows, CLASHING, 4), top=60)
    assert got_collocations(got) == plain_collocations(rows, 10, 60)
    assert [t for c, t in got.dtypes if c in ("rank", "a", "l", "r", "n", "score")] == ["bigint"] * 6


def test_collocations_of_nothing(texts, tmp_path):
    assert collocations.collocations(texts(tmp_path, [], DOCS)).collect() == []


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(3)
    keys = np.concatenate((np.repeat(np.arange(50), 10), rng.integers(1000, 10_000, 20_000))).astype(np.uint64)
    rng.shuffle(keys)
    summary = collocations.MisraGries(len(keys) // 10 + 1)
    for part in np.array_split(keys, 40):
        summary.merge(*np.unique(part, return_counts=True))
    assert summary.taken < 10 and len(summary.keys) <= summary.capacity
    value, count = np.unique(keys, return_counts=True)
    assert set(value[count >= 10].tolist()) <= set(summary.possible(10).tolist())
    true = dict(zip(value.tolist(), count.tolist()))
    assert all(0 <= true[k] - c <= summary.taken for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


# --- nearest neighbours ------------------------------------------------------------------------------------------------

VECTORS = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32(), "vector": pa.string(), "score": pa.string(), "query": pa.string()}


def brute(rows: list[dict], k: int) -> dict[int, list[tuple[int, float]]]:
    own = {}
    for r in rows:
        v = r.get("embedding")
        if r.get("vec_id") is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[r["vec_id"]] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in own.items():
        if q % 20 == 0:
            scored = [(-float((v * w).sum()), i) for i, w in own.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_against_all_inner_products(texts, tmp_path, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    rows = [{"vec_id": i, "embedding": (centres[i % 12] + 0.7 * rng.normal(size=32)).tolist(), "score": "x"} for i in range(3000)]
    rows += [{"vec_id": 3000 + i, "embedding": rows[40]["embedding"]} for i in range(1500)]  # a third of all rows is one vector
    rows += rows[:30] + [{"vec_id": 9000}, {"vec_id": 9020, "embedding": []}, {"vec_id": 9040, "embedding": [0.0] * 32}, {"vec_id": 9060, "embedding": [None] * 32}, {"vec_id": 9080, "embedding": [float("nan")] * 32},
                        {"vec_id": 9100, "embedding": [1.0, 2.0]}, {"vec_id": 9101, "embedding": [3.0, -1.0]}, {"vec_id": None, "embedding": rows[0]["embedding"]}, {"vec_id": 9120, "embedding": [1e30] * 32}]
    got, want = found(adaptive_scan.search(texts(tmp_path, rows, VECTORS, 3), F.col("vec_id") % 20 == 0)), brute(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, best in got.items():
        assert len(best) == len(want[q]) and best == sorted(best, key=lambda x: (-x[1], x[0]))
    assert got[9100] == [(9101, 1.0)] and got[3000] == want[3000]


def test_neighbours_of_few_and_of_none(texts, tmp_path):
    search = lambda rows: found(adaptive_scan.search(texts(tmp_path, rows, VECTORS), F.col("vec_id") % 20 == 0))
    assert search([]) == {}
    assert search([{"vec_id": 0, "embedding": [1.0]}]) == {}
    assert search([{"vec_id": i, "embedding": [1.0, float(i)]} for i in (0, 1, 2)]) == {0: [(1, 1.0), (2, 1.0)]}


def test_rotation_keeps_inner_products():
    points = np.random.default_rng(2).normal(size=(50, 37))
    turned = adaptive_scan.rotate(points)
    assert np.allclose(points @ points.T, turned @ turned.T)
