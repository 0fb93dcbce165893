from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tenorline.catalog import local_frame  # noqa: E402
from tenorline.schemas import STAGING, STAGING_DEFAULTS  # noqa: E402
from tenorline.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tenorline-tests", cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def staging(spark):
    """Staging frame from dicts; missing columns take their defaults."""
    defaults = {"category": "c", "region": "r", "frequency": "monthly", "unit": "index", "provider": "p", **STAGING_DEFAULTS}

    def build(rows: list[dict]):
        full = []
        for row in rows:
            values = {**defaults, "source_url": f"https://example.org/{row['series_id']}", **row}
            full.append(tuple(values[name] for name in STAGING.names))
        return local_frame(spark, full, STAGING)

    return build


def months(first: date, n: int) -> list[date]:
    start = first.year * 12 + first.month - 1
    return [date((start + i) // 12, (start + i) % 12 + 1, 1) for i in range(n)]


def dicts(df, *order: str) -> list[dict]:
    rows = [row.asDict(recursive=True) for row in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[name]) for name in order))
