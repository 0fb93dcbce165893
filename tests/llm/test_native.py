"""Chat formatting and source mixing against plain Python, and every SQL query against its SQL."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import pytest

from llm_support import CLASHING, DOCS, TESTDATA, duck, ordered, texts  # noqa: F401
from tenorline.llm import chat, mixing, workload

TURNS = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "run": pa.string(), "pos": pa.int64()}


def plain_chats(rows: list[dict]) -> list[tuple]:
    turns = defaultdict(set)
    for r in rows:
        if r["conv_id"] is not None:
            turns[r["conv_id"]].add((r["turn"] is not None, r["turn"] or 0, r.get("role") or "", r.get("text") or ""))
    whole = {c: tuple((role, text) for *_, role, text in sorted(t)) for c, t in turns.items()}
    out = []
    for c, own in whole.items():
        same = [d for d, other in whole.items() if other == own]
        if c == min(same) and not any(len(o) > len(own) and o[:len(own)] == own for o in whole.values()):
            out.append((c, len(own), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own)))
    return sorted(out)


def grow(c: int, n: int, word: str = "w") -> list[dict]:
    return [{"conv_id": c, "turn": t, "role": "user" if t % 2 == 0 else "assistant", "text": f"{word}{t}"} for t in range(n)]


def test_chats_keep_the_longest_of_a_growing_log(texts, tmp_path):
    rows = grow(1, 2) + grow(2, 4) + grow(3, 4) + grow(4, 3, "v") + grow(5, 1, "v") + grow(7, 1) + grow(7, 1)
    rows += [{"conv_id": None, "turn": 0, "role": "user", "text": "lost"}, {"conv_id": 8, "turn": None, "role": None, "text": None}, {"conv_id": 9, "turn": 0, "role": "user", "text": ""},
             {"conv_id": 10, "turn": 0, "role": "user", "text": "a"}, {"conv_id": 10, "turn": 0, "role": "user", "text": "b"}, {"conv_id": 11, "turn": 0, "role": "user", "text": "a" * 200_000}]
    got = [(r["conv_id"], r["n_turns"], r["n_same"], r["rendered"]) for r in ordered(chat.format_chats(texts(tmp_path, rows, TURNS, 3)))]
    assert sorted(got) == plain_chats(rows)


def test_giant_conversations_are_cut_into_parts(texts, tmp_path):
    n = 2 * chat.SPAN + 5
    rows = grow(1, n) + grow(2, n - 1) + grow(3, chat.SPAN)
    got = sorted((r["conv_id"], r["part"], r["rendered"]) for r in ordered(chat.format_chats(texts(tmp_path, rows, TURNS, 2))))
    assert [(c, p) for c, p, _ in got] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r for *_, r in got) == plain_chats(rows)[0][3]


def test_no_conversations(texts, tmp_path):
    assert ordered(chat.format_chats(texts(tmp_path, [], TURNS))) == []


def plain_targets(sizes: dict) -> dict:
    """Clamping round by round, as the method is told."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: 3.0 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **clamped}
        clamped.update(over)


def test_targets_and_what_is_taken(texts, tmp_path):
    rows = [{"doc_id": i, "text": " ".join(["w"] * (i % 23 + 1)), "source": f"s{i % 7}" if i % 7 else None} for i in range(2000)]
    rows += [{"doc_id": 5000 + i, "text": "a b\x0b c d", "source": "tiny"} for i in range(3)] + [{"doc_id": None, "text": None, "source": "s1"}, {"doc_id": 1, "text": rows[1]["text"], "source": "s1"}, {"doc_id": 9999, "text": "", "source": "empty"}]
    got = ordered(mixing.mix_sources(texts(tmp_path, rows, CLASHING, 4)))
    again = ordered(mixing.mix_sources(texts(tmp_path, rows, DOCS, 1)))
    assert got == again and len(got) == len(rows)
    sizes, source = defaultdict(int), {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
        source.setdefault((r["doc_id"], n), r["source"])
    targets, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s], rel=1e-12) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert targets["tiny"] == 3 * sizes["tiny"] == taken["tiny"]
    assert all(abs(taken[s] - targets[s]) <= max(25, 0.01 * targets[s]) for s in targets)


def test_mixed_documents_are_the_counted_copies(texts, tmp_path):
    rows = [{"doc_id": i // 2, "text": "word " * (i % 9), "source": f"s{i % 4}", "n_chars": i} for i in range(400)] + [{"doc_id": 7, "text": "x y", "source": "s1"}] * 5
    docs = texts(tmp_path, rows, CLASHING, 3)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, counted = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id, len((r.text or "").split())] += len((r.text or "").split())
    for r in mixing.mix_sources(docs).collect():
        counted[r.doc_id, r["size"]] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in counted.items() if v}


def test_nothing_to_mix(texts, tmp_path):
    assert ordered(mixing.mix_sources(texts(tmp_path, [], DOCS))) == [] and ordered(mixing.mixed_documents(texts(tmp_path, [], DOCS))) == []
    (row,) = ordered(mixing.mix_sources(texts(tmp_path, [{"doc_id": 1, "text": None}], DOCS)))
    assert row == {"doc_id": 1, "size": 0, "source_size": 0, "target": 0.0, "taken": 0}


SF = str(TESTDATA / "sf0.001")


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_sql(spark, name):
    df = workload.QUERIES[name](spark, SF)
    cursor = duck(SF).execute(workload.ORACLES[name])
    names = [c[0] for c in cursor.description]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=key) == sorted(cursor.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op1_secret_scan", "op7_chat_formatting"])
def test_native_operators_run_no_python(spark, name):
    plan = workload.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop|ExistingRDD", plan)
