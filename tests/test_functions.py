from __future__ import annotations

import math
import random
from datetime import date

from pyspark.sql import functions as F

from tenorline.functions import dates, histories, numbers, text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_rounding_equals_binary_half_even(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1e4, 1e4) for _ in range(4000)] + [rng.uniform(-1e12, 1e12) for _ in range(500)]
    values += [round(rng.uniform(-100, 100), 3) for _ in range(4000)] + [i / 8 for i in range(-40, 41)] + [2.675, 1.005, 0.0, -0.001, 1e15, 123456.785]
    for digits in (2, 4):
        got = column(spark, values, "double", lambda x: numbers.py_round(x, digits))
        assert got == [round(v, digits) + 0.0 for v in values]
        assert all(math.copysign(1, g) == 1 for g in got if g == 0)


def test_rounding_of_special_values(spark):
    assert column(spark, [None, float("inf")], "double", lambda x: numbers.py_round(x, 2)) == [None, None]
    assert math.isnan(column(spark, [float("nan")], "double", lambda x: numbers.py_round(x, 2))[0])


def test_display_rounds_binary_ties_away_from_zero(spark):
    shown = column(spark, [0.125, 0.375, -0.125, 2.675, 1.005, 0.0], "double", lambda x: numbers.display_fixed(x, 2))
    assert shown == ["0.13", "0.38", "-0.13", "2.67", "1.00", "0.00"]
    assert column(spark, [0.25, 9.45, None], "double", numbers.display_multiple) == ["0.3x", "9.4x", "N/A"]
    assert column(spark, [12.5, float("inf"), float("nan"), None], "double", numbers.display_percent) == ["12.50%", "N/A", "N/A", "N/A"]


def test_strict_numbers_accept_what_python_accepts(spark):
    texts = ["4.50", " 4.5 ", ".", "", "1_000", "1__0", "_1", "1e3", "1E-2", "+.5", "5.", "1.5d", "1.5f", "0x10", "abc", "1,5", "nan", "inf", "-Infinity", "--1", "1e999", None]

    def python(t):
        try:
            v = float(t)
        except (TypeError, ValueError):
            return None
        return v if not math.isnan(v) else None

    got = column(spark, texts, "string", lambda x: numbers.safe_double(x, keep_non_finite=True))
    assert [None if g is not None and math.isnan(g) else g for g in got] == [python(t) for t in texts]
    finite = column(spark, texts, "string", lambda x: numbers.finite(numbers.safe_double(x)))
    assert finite == [v if v is not None and math.isfinite(v) else None for v in map(python, texts)]


def test_lenient_numbers(spark):
    texts = ["12,5", " 3.5abc", "1,2,3", "abc", "", "-4", ".5", "5.", "1e2x", "12%", None]
    assert column(spark, texts, "string", numbers.lenient_double) == [12.5, 3.5, 1.2, None, None, -4.0, 0.5, 5.0, 100.0, 12.0, None]
    assert column(spark, ["0", "-1", "2"], "string", numbers.positive_double) == [None, None, 2.0]


def test_period_start(spark):
    cases = [
        ("2025-Q3", "daily", date(2025, 7, 1)), ("2025-Q1", "annual", date(2025, 1, 1)), ("2025-Q5", "quarterly", None),
        ("2024", "annual", date(2024, 1, 1)), ("2024-07-09", "annual", date(2024, 1, 1)), ("2025-08-15", "quarterly", date(2025, 7, 1)),
        ("2025-08", "quarterly", date(2025, 7, 1)), ("2025-10-31", "monthly", date(2025, 10, 1)), ("2025-10", "monthly", date(2025, 10, 1)),
        ("2025-10", "daily", date(2025, 10, 1)), ("2025-10-31", "daily", date(2025, 10, 31)), ("20251031", "daily", date(2025, 10, 31)),
        ("2025-13-01", "daily", None), ("soon", "monthly", None), ("2025-1-1", "daily", None), (None, "daily", None)]
    df = spark.createDataFrame([(i, r, f) for i, (r, f, _) in enumerate(cases)], "i int, r string, f string")
    got = [r[0] for r in df.orderBy("i").select(dates.period_start(F.col("r"), F.col("f"))).collect()]
    assert got == [c[2] for c in cases]


def test_dates(spark):
    df = spark.createDataFrame([(date(2025, 8, 31), f) for f in ("daily", "monthly", "quarterly", "annual")], "d date, f string")
    assert [r[0] for r in df.select(dates.request_period(F.col("d"), F.col("f"))).collect()] == ["2025-08-31", "2025-08", "2025-Q3", "2025-08-31"]
    assert column(spark, [0.0, 1784160000.0, -1.0], "double", dates.epoch_day) == [date(1970, 1, 1), date(2026, 7, 16), date(1969, 12, 31)]
    assert column(spark, [date(2025, 8, 31), date(1965, 1, 2)], "date", lambda d: dates.month_start(dates.month_number(d))) == [date(2025, 8, 1), date(1965, 1, 1)]


def test_text(spark):
    assert column(spark, ["SPY.US", "SPY", "A.USD"], "string", text.listing_symbol) == ["SPY", "SPY", "A.USD"]
    urls = ["https://data.ecb.europa.eu/x", "https://fred.stlouisfed.org/series/Y", "https://db.nomics.world/a", "https://ec.europa.eu/b", "https://Host.Example:8080/p", "words", "", None]
    assert column(spark, urls, "string", text.source_name) == ["ECB", "FRED", "AMECO", "AMECO", "host.example", "words", None, None]
    page = "<html><p>Your access has been blocked due to security concerns.</p><br/>HTTP status code: 400 now</html>"
    long = "<div>" + "ab " * 200 + "</div>"
    assert column(spark, [page, long], "string", text.error_page_summary) == [
        "Your access has been blocked due to security concerns. HTTP status code: 400.", ("ab " * 200)[:240]]


def test_histories(spark):
    rows = [[100.0, 110.0, 121.0], [100.0], [], [100.0, None], [100.0, -5.0], [100.0, 50.0]]
    got = column(spark, rows, "array<double>", histories.mean_growth_percent)
    assert [None if g is None else round(g, 9) for g in got] == [10.0, None, None, None, None, -50.0]
    assert column(spark, rows, "array<double>", histories.mean)[:4] == [331 / 3, 100.0, None, None]
