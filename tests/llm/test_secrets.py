from __future__ import annotations

import hashlib
import re

from llm_support import CLASHING, DOCS, ordered, texts  # noqa: F401
from tenorline.llm import secrets

KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?ai:password|passwd|secret|token|api_?key))")), 2, 12),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]


def plain(text: str | None) -> dict:
    found = [(m.start(), i, name, m.end()) for i, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    spans = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
    return {**{f"n_{k}": sum(f[2] == k for f in found) for k, *_ in KINDS}, "base_sha256": hashlib.sha256(spans.encode()).hexdigest(), "spans": spans}


TEXTS = [None, "", "   ", "password=abc", "password=abcdefghijkl", "Secret: 'ABCDEF0123456789", 'API_KEY": "x.y/z+w=1234567', "apikey  =  0123456789abcdef0123456789abcdef",
         'secret="token": "abcdefghijklmnop"', "password=token=abcdefghijklmnop", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "AKIAAKIA" + "0" * 20, "é🙂 passwd:0123456789ab é",
         "0123456789abcde", "0123456789abcdef", "f" * 40000, " ".join(["deadbeefdeadbeef"] * 3000), "ſecret=abcdefghijkl", "token='" + "a" * 12 + "' token='" + "b" * 12 + "'", "ghp_" + "a1" * 18]


def test_equals_plain_regular_expressions(texts, tmp_path):
    rows = [{"doc_id": i, "text": t, "kept": "x"} for i, t in enumerate(TEXTS)] + [{"doc_id": None, "text": TEXTS[4]}, {"doc_id": 4, "text": TEXTS[4]}, {"doc_id": 4, "text": TEXTS[15]}]
    got = [{k: v for k, v in r.items()} for r in ordered(secrets.scan_secrets(texts(tmp_path, rows, CLASHING, 3), rules=secrets.BASE))]
    want = sorted(({"doc_id": r["doc_id"], **plain(r["text"])} for r in rows), key=lambda r: str(r))
    assert sorted(got, key=str) == want


def test_more_rules_add_spans_and_leave_the_base(texts, tmp_path):
    text = "x ghp_" + "a1" * 18 + " -----BEGIN RSA PRIVATE KEY----- xoxb-0123456789 password=0123456789ab"
    (row,) = ordered(secrets.scan_secrets(texts(tmp_path, [{"doc_id": 1, "text": text}], DOCS)))
    assert [s.split(":")[0] for s in row["spans"].split(",")] == ["forge", "hex", "pem", "chat", "assign"]
    assert row["base_sha256"] == plain(text)["base_sha256"]


def test_no_rows(texts, tmp_path):
    assert ordered(secrets.scan_secrets(texts(tmp_path, [], DOCS))) == []


def test_trigram_queries_are_necessary_conditions():
    assert secrets.trigram_query("abc(de|fg)?h+") == [["abc", "bcd", "cde", "deh"], ["abc", "bcf", "cfg", "fgh"], ["abc", "bch"]]
    assert secrets.trigram_query("[0-9]+") == [[]] and secrets.trigram_query("(abcd|x)y") == [[]]
    assert secrets.trigram_query("(?:abc){2,}") == [["abc"]] and secrets.trigram_query("a.bcd") == [["bcd"]]


def test_no_python_and_one_lowering(texts, tmp_path):
    plan = secrets.scan_secrets(texts(tmp_path, [{"doc_id": 1, "text": "a"}], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
