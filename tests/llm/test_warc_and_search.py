"""The WARC source as a round trip, and the KD-tree search against all inner products."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_support import ordered, texts  # noqa: F401
from tenorline.llm import kdtree, warc

PAGES = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "record_id": pa.string(), "payload": pa.string()}


def plain_pages(rows: list[dict]) -> list[dict]:
    largest: dict[bytes, int] = {}
    for r in rows:
        body = (r.get("html") or "").encode()
        if r.get("page_id") is not None:
            largest[body] = max(largest.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body, page = (r.get("html") or "").encode(), r.get("page_id")
        again = len(body) >= 1000 and page is not None and page < largest[body]
        out.append({"page_id": page, "payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": largest[body] if again else None})
    return sorted(out, key=str)


def page_rows() -> list[dict]:
    rng = random.Random(2)
    rows = [{"page_id": i, "url": f"http://h{i % 3}.example.org/{i}", "html": "é" * 300 + "\r\n\r\nWARC/1.1\r\n" + str(rng.random()) * (i % 90)} for i in range(120)]
    rows += [{"page_id": 1000 + i, "url": None, "html": "same " * 250} for i in range(40)] + [{"page_id": 2000 + i, "url": "u\r\nX: y", "html": "small"} for i in range(5)]
    return rows + [{"page_id": None, "url": None, "html": None}, {"page_id": None, "html": "same " * 250}, {"page_id": 7, "html": None}, {"page_id": 8, "html": ""}, {"page_id": 1039, "html": "same " * 250}, {"page_id": 9, "html": "long " * 400_000}]


def test_archived_pages_equal_plain_python(texts, tmp_path):
    rows = page_rows()
    got = sorted((r.asDict() for r in warc.archived_pages(texts(tmp_path, rows, PAGES, 4)).collect()), key=str)
    assert got == plain_pages(rows)


def test_no_pages(texts, tmp_path):
    assert ordered(warc.archived_pages(texts(tmp_path, [], PAGES))) == []


def test_headers_are_pushed_down_and_payloads_skipped(texts, tmp_path, spark):
    path = f"file://{tmp_path}/archive"
    rows = page_rows()
    warc.write_warc(warc.page_records(texts(tmp_path, rows, PAGES, 3)), path)
    revisits = warc.read_warc(spark, path).where("warc_type = 'revisit' AND target_uri IS NULL")
    assert revisits.count() == 39
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "warc_type" not in plan.split("BatchScan")[0]
    one = warc.read_warc(spark, path).where("target_uri = 'http://h1.example.org/4'").collect()
    assert [r.payload.decode() for r in one] == [rows[4]["html"]] and one[0].headers["Content-Type"].startswith("application/http")
    few = warc.read_warc(spark, path).where(F.col("warc_type").isin("response", "request") & F.col("target_uri").startswith("http://h2")).count()
    assert few == 40
    assert warc.read_warc(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    assert warc.read_warc(spark, path, payload=False).count() == len(rows)


def test_other_archives_are_read(tmp_path, spark):
    """Plain files, members without lengths, a cut-off record, headers in other cases of use."""
    body = b"x" * 200_000
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://a\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <b>\r\nX-Other: 1:2\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one + two + one + two[:40])
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one)[:60])
    (tmp_path / "_ignored").write_bytes(b"no archive")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter(r.record_id for r in rows) == Counter({"<a>": 3, "<b>": 2})
    assert all(r.payload == (body if r.record_id == "<a>" else b"abc") for r in rows)
    assert warc.read_warc(spark, str(tmp_path)).where("warc_type = 'metadata'").select("headers").first().headers == {"X-Other": "1:2"}


def test_members_of_several_records_and_odd_headers(tmp_path, spark):
    """A whole file in one gzip member, records over several members, names in lower case, lengths that are no numbers."""
    def one(name: bytes, body: bytes, length: bytes | None = None, head: bytes = b"WARC-Record-ID") -> bytes:
        return b"WARC/1.0\r\n" + head + b": <" + name + b">\r\nwarc-type: resource\r\ncontent-length: " + (length if length is not None else b"%d" % len(body)) + b"\r\n\r\n" + body + b"\r\n\r\n"

    large = bytes(range(256)) * 4000
    three = one(b"1", b"a" * 10) + one(b"2", large, head=b"warc-record-id") + one(b"3", b"")
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(three))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(three[:300]) + gzip.compress(three[300:]))
    (tmp_path / "lengths.warc.gz").write_bytes(warc.gzip_member(three) + warc.gzip_member(one(b"4", b"d")))
    (tmp_path / "bad.warc").write_bytes(one(b"5", b"what is\r\n\r\nthis", b"many") + one(b"6", b"f", b"-1") + one(b"7", b"g"))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    want = Counter({("<1>", b"a" * 10): 3, ("<2>", large): 3, ("<3>", b""): 3, ("<4>", b"d"): 1, ("<5>", b""): 1, ("<6>", b""): 1, ("<7>", b"g"): 1})
    assert Counter((r.record_id, bytes(r.payload)) for r in rows) == want and all(r.warc_type == "resource" for r in rows)
    skipped = warc.read_warc(spark, str(tmp_path), payload=False)
    assert Counter(r.record_id for r in skipped.collect()) == Counter(i for i, _ in want.elements())
    assert {r.record_id for r in warc.read_warc(spark, str(tmp_path)).where("record_id = '<4>'").collect()} == {"<4>"}


def test_large_outputs_are_rolled(texts, tmp_path, spark):
    path = str(tmp_path / "rolled")
    docs = warc.page_records(texts(tmp_path, [{"page_id": i, "html": str(i) * 3000} for i in range(30)], PAGES))
    warc.register(spark)
    docs.write.format("warc").option("fileBytes", "500").mode("append").save(path)
    assert len(list((tmp_path / "rolled").glob("*.warc.gz"))) > 3 and warc.read_warc(spark, path).count() == 30


VECTORS = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32(), "vector": pa.string(), "shard": pa.string()}


def plain_top(rows: list[dict], k: int = 10) -> list[tuple]:
    kept = [(r["vec_id"], tuple(math.floor(1024 * float(np.float32(x))) for x in r["embedding"])) for r in rows
            if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    out = set()
    for q, v in {x for x in kept if x[0] % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q and len(w) == len(v))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_search_equals_all_products(texts, tmp_path, monkeypatch, shard_rows):
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 16)
    monkeypatch.setattr(kdtree, "QUERY_BLOCK", 3)
    monkeypatch.setattr(kdtree.build_index, "__defaults__", (shard_rows,))
    rng = np.random.default_rng(4)
    rows = [{"vec_id": i, "embedding": rng.normal(size=8).tolist()} for i in range(700)]
    rows += [{"vec_id": 1000 + i, "embedding": [1.5] * 8} for i in range(300)] + [{"vec_id": 2000 + i, "embedding": rng.normal(size=3).tolist()} for i in range(5)]
    rows += [{"vec_id": 3000, "embedding": None}, {"vec_id": 3100, "embedding": [1.0, None]}, {"vec_id": 3200, "embedding": [float("nan")] * 8}, {"vec_id": 3300, "embedding": [float("inf")] * 8}, {"vec_id": 3400, "embedding": []},
             {"vec_id": None, "embedding": [9.0] * 8}, {"vec_id": 3500, "embedding": [1.0] * 5}, rows[0], {"vec_id": 4000, "embedding": [3000.0] * 8}, {"vec_id": 4100, "embedding": [100000.0, 1.0]}, {"vec_id": 4101, "embedding": [99999.0, -1.0]}]
    found = kdtree.top_k(texts(tmp_path, rows, VECTORS, 3), F.col("vec_id") % 100 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == plain_top(rows)


@pytest.mark.parametrize("dim", [2, 300])
def test_large_components_and_many_dimensions(texts, tmp_path, monkeypatch, dim):
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 8)
    rng = np.random.default_rng(dim)
    rows = [{"vec_id": 50 + i, "embedding": (rng.normal(size=dim) * 10.0 ** (i % 5)).tolist()} for i in range(150)]
    rows += [{"vec_id": 1, "embedding": [300000.0] + [1.0] * (dim - 1)}, {"vec_id": 2, "embedding": [1.0] * dim}, {"vec_id": 400, "embedding": [400000.0] + [1.0] * (dim - 1)}, {"vec_id": 500, "embedding": [-1e6] * dim}, {"vec_id": 3, "embedding": [1e9] + [0.0] * (dim - 1)}, {"vec_id": 600, "embedding": [0.0] * dim}]
    huge = {"vec_id": 4, "embedding": [1e12] + [2.0] * (dim - 1)}, {"vec_id": 700, "embedding": [1e9] * dim}
    found = kdtree.top_k(texts(tmp_path, rows + list(huge), VECTORS, 3), F.col("vec_id") % 100 == 0)
    want = [(q, rank, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, rank, i, s in plain_top(rows + list(huge))]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == want


def test_no_vectors(texts, tmp_path):
    assert ordered(kdtree.top_k(texts(tmp_path, [], VECTORS), F.col("vec_id") % 100 == 0)) == []
