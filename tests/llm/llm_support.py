from __future__ import annotations

import json
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tenorline.llm.runtime import prepare

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def texts(spark):
    """DataFrames from dicts, written and read as Parquet like the given tables."""
    prepare(spark)

    def build(tmp_path, rows: list[dict], schema: dict[str, pa.DataType], parts: int = 1):
        folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        table = pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in schema.items()})
        step = max(1, -(-len(rows) // parts))
        for k, at in enumerate(range(0, max(1, len(rows)), step)):
            pq.write_table(table.slice(at, step), folder / f"part-{k}.parquet")
        return spark.read.parquet(str(folder))

    return build


DOCS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}

# An extra column whose name operators might use themselves.
CLASHING = {**DOCS, "node": pa.string(), "draw": pa.string(), "leaks": pa.string(), "size": pa.int64(), "text_hash": pa.string(), "kept": pa.string(), "good": pa.string(), "label": pa.string()}


def ordered(df) -> list[dict]:
    rows = [row.asDict(recursive=True) for row in df.collect()]
    return sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str))


def duck(sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.fixture(scope="session")
def small_documents():
    return pq.read_table(TESTDATA / "sf0.001/documents.parquet").to_pylist()
