"""Several tables committed together, tables stored by key, and logs."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import dicts
from tenorline import schemas
from tenorline.operators import sinks

AT = datetime(2026, 6, 1, 6)


def availability(spark, *rows):
    return spark.createDataFrame([(k, "ppp", "relative_ppp", status, "x", None) for k, status in rows], schemas.AVAILABILITY)


def payloads(spark, *rows):
    return spark.createDataFrame([("eodhd", symbol, at, text) for symbol, at, text in rows], schemas.EQUITY_PAYLOADS)


def states(spark, root):
    marts = [(r["pair_key"], r["status"]) for r in dicts(sinks.read_table(spark, root, "currency_data_availability"), "pair_key")]
    return marts, [(r["external_symbol"], r["payload_json"]) for r in dicts(sinks.read_table(spark, root, "equity_payloads"), "external_symbol")]


def load(spark, root, *, mart, text):
    staged = {"currency_data_availability": sinks.stage_replacement(mart, root, "currency_data_availability", ["pair_key"]),
              "equity_payloads": sinks.stage_append(text, root, "equity_payloads", F.to_date("fetched_at"))}
    sinks.commit_tables(spark, root, staged)


def test_tables_change_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    load(spark, root, mart=availability(spark, ("a", "old"), ("b", "old")), text=payloads(spark, ("S", AT, "old")))
    before = states(spark, root)
    assert before == ([("a", "old"), ("b", "old")], [("S", "old")])
    new = {"mart": availability(spark, ("a", "new")), "text": payloads(spark, ("S", AT, "new"), ("T", AT, "new"))}
    for name in ("stage_append", "commit_tables"):  # the job dies between two tables, then before the commit
        with monkeypatch.context() as m:
            m.setattr(sinks, name, lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                load(spark, root, **new)
        assert states(spark, root) == before
    assert not list(tmp_path.glob("*/_work-*"))
    load(spark, root, **new)
    assert states(spark, root) == ([("a", "new"), ("b", "old")], [("S", "new"), ("T", "new")])


def test_a_key_rewrites_its_bucket_only(spark, tmp_path):
    root, name = str(tmp_path), "currency_data_availability"
    keys = [f"pair-{i}" for i in range(300)]
    sinks.commit_tables(spark, root, {name: sinks.stage_replacement(availability(spark, *[(k, "old") for k in keys]), root, name, ["pair_key"])})
    first = sinks.committed_parts(spark, f"{root}/{name}")
    assert 50 < len(first) <= sinks.BUCKETS
    sinks.commit_tables(spark, root, {name: sinks.stage_replacement(availability(spark, ("pair-7", "new")), root, name, ["pair_key"])})
    second = sinks.committed_parts(spark, f"{root}/{name}")
    assert sum(second[bucket] != version for bucket, version in first.items()) == 1
    rows = sinks.read_table(spark, root, name)
    assert rows.count() == 300 and rows.where("status = 'new'").count() == 1


def test_rows_of_an_older_layout_move_into_buckets(spark, tmp_path):
    root, name = str(tmp_path), "currency_data_availability"
    sinks.write_table(availability(spark, ("a", "old"), ("b", "old")), root, name)
    sinks.commit_tables(spark, root, {name: sinks.stage_replacement(availability(spark, ("b", "new"), ("c", "new")), root, name, ["pair_key"])})
    assert states(spark, root)[0] == [("a", "old"), ("b", "new"), ("c", "new")]


def test_a_log_is_only_appended_to(spark, tmp_path):
    root, name = str(tmp_path), "equity_payloads"
    for text in ("one", "two", "three"):
        sinks.commit_tables(spark, root, {name: sinks.stage_append(payloads(spark, ("S", AT, text)), root, name, F.to_date("fetched_at"))})
    sinks.commit_tables(spark, root, {name: sinks.stage_append(payloads(spark, ("S", AT.replace(day=2), "next day")), root, name, F.to_date("fetched_at"))})
    held = sinks.committed_parts(spark, f"{root}/{name}")
    assert sorted(part.partition("@")[0] for part in held) == ["2026-06-01"] * 3 + ["2026-06-02"] and len(set(held.values())) == 4
    newest = lambda: sorted(r["payload_json"] for r in sinks.read_table(spark, root, name).collect())
    assert newest() == ["next day", "three"]
    sinks.compact_log(spark, root, name)
    assert sorted(part.partition("@")[0] for part in sinks.committed_parts(spark, f"{root}/{name}")) == ["2026-06-01", "2026-06-02"]
    assert newest() == ["next day", "three"]


def test_a_stale_writer_is_refused(spark, tmp_path):
    root, name = str(tmp_path), "currency_data_availability"
    mine = sinks.stage_replacement(availability(spark, ("a", "mine")), root, name, ["pair_key"])
    theirs = sinks.stage_replacement(availability(spark, ("b", "theirs")), root, name, ["pair_key"])
    sinks.commit_tables(spark, root, {name: theirs})
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.commit_tables(spark, root, {name: mine})
    assert states(spark, root)[0] == [("b", "theirs")]


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, mart=availability(spark, ("a", "old")), text=payloads(spark))
    load(spark, root, mart=availability(spark), text=payloads(spark))
    assert states(spark, root) == ([("a", "old")], [])
