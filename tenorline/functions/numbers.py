"""Number parsing, rounding and display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenorline.functions.text import WHITE_SPACE_CHARACTERS

# Grammar of the numbers a landed value text may hold: single underscores between digits are
# allowed, type suffixes (``1.5d``) and hexadecimal forms are not.
_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_NON_FINITE = r"(?i)^[+-]?(?:nan|inf|infinity)$"
_NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null (NaN sorts above infinity)."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def safe_double(text: Column, keep_non_finite: bool = False) -> Column:
    """Strict text to double; null for anything that is not a number.

    Each row is matched and cast once. A number too large for a double becomes infinity.
    """
    trimmed = F.btrim(text, F.lit(WHITE_SPACE_CHARACTERS))
    number = F.when(trimmed.rlike(_NUMBER), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(number, F.when(trimmed.rlike(_NON_FINITE), trimmed.try_cast("double"))) if keep_non_finite else number


def number_prefix(text: Column) -> Column:
    """Longest numeric prefix after turning the first comma into a dot; null if there is none, infinite on overflow."""
    # Most texts are empty or plain, so the patterns run only where they can matter.
    dotted = F.when(text.contains(","), F.regexp_replace(text, r"^([^,]*),", "$1.")).otherwise(text)
    return F.when(text != "", F.regexp_extract(dotted, _NUMBER_PREFIX, 1).try_cast("double"))


def lenient_double(text: Column) -> Column:
    """``number_prefix`` where it is finite, else null."""
    return finite(number_prefix(text))


def positive(x: Column) -> Column:
    """``x`` where it is finite and above zero, else null."""
    return F.when((x > 0) & (x < F.lit(float("inf"))), x)


def positive_double(text: Column) -> Column:
    """``number_prefix`` where it is finite and above zero, else null."""
    return positive(number_prefix(text))


def fixed_text(x: Column, digits: int) -> Column:
    """Fixed-precision text, half-even on the exact binary value."""
    return F.call_function("format_number", x, F.lit(_pattern(digits)))


def py_round(x: Column, digits: int) -> Column:
    """Round half-even on the exact binary value, unlike ``F.round`` which rounds the shortest decimal text.

    Away from a tie, scaling and ``rint`` give the same double as printing would, so the slow
    print-and-parse path runs only for values within 1e-4 of a tie or too large to scale safely.
    """
    scale = float(10 ** digits)
    scaled = x * F.lit(scale)
    clear_of_tie = F.abs(F.abs(scaled) % 1.0 - F.lit(0.5)) > F.lit(1e-4)
    exact = F.call_function("format_number", x, F.lit(_pattern(digits))).try_cast("double")
    rounded = F.when((F.abs(scaled) < F.lit(1e9)) & clear_of_tie, F.rint(scaled) / F.lit(scale)).otherwise(exact)
    return rounded + F.lit(0.0)


def display_fixed(x: Column, digits: int) -> Column:
    """Fixed-precision text with exact binary ties going away from zero (screen and export rule)."""
    # A value ties at `digits` decimals only if it is an odd multiple of 2**-(digits + 1).
    tie = F.abs(x) * F.lit(float(2 ** (digits + 1))) % 2.0 == 1.0
    nudge = F.when(tie, F.signum(x) * F.lit(10.0 ** -(digits + 1))).otherwise(F.lit(0.0))
    return F.call_function("format_number", x + nudge, F.lit(_pattern(digits)))


def display_percent(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), F.concat(display_fixed(x, 2), F.lit("%"))).otherwise("N/A")


def display_multiple(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), F.concat(display_fixed(x, 1), F.lit("x"))).otherwise("N/A")


def percent_change(current: Column, base: Column) -> Column:
    """(current / base - 1) * 100; null for a zero base."""
    return (F.try_divide(current, base) - F.lit(1.0)) * F.lit(100.0)


def _pattern(digits: int) -> str:
    return "0." + "0" * digits if digits else "0"
