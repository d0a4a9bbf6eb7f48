"""Dirty numbers, safe ratios and printed effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number. The guard matters: the JVM parser alone would also take '12d' or 'NaN'.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(text.rlike(PLAIN_NUMBER), F.trim(text).try_cast("double"))


def parse_whole(text: Column) -> Column:
    """Text to int, truncating decimals; out-of-range values become NULL."""
    number = parse_number(text)
    towards_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return towards_zero.try_cast("int")


def parse_count(text: Column, whole: Column | bool = False, thousands: str = "null") -> Column:
    """A field count, never NULL: unreadable cells count as 0.

    ``whole`` truncates decimals. ``thousands="null"`` reads ``2,460`` as unreadable (so 0), the
    behaviour the published totals rest on; ``"strip"`` reads it as 2460.
    """
    if thousands not in ("null", "strip"):
        raise ValueError("thousands must be 'null' or 'strip'")
    if thousands == "strip":
        text = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "")
    kept = parse_number(text)
    cut = parse_whole(text).cast("double")
    if isinstance(whole, bool):
        value = cut if whole else kept
    else:
        value = F.when(whole, cut).otherwise(kept)
    return F.coalesce(value, F.lit(0.0))


def parse_minutes(text: Column, zero_texts: tuple[str, ...], unreadable_is_zero: Column | bool = False) -> Column:
    """Effort minutes. NULL and the listed texts are 0; other unreadable text is NULL unless asked."""
    value = F.when(text.isNull() | text.isin(*zero_texts), F.lit(0)).otherwise(parse_whole(text))
    flag = F.lit(unreadable_is_zero) if isinstance(unreadable_is_zero, bool) else unreadable_is_zero
    return F.when(value.isNull() & flag, F.lit(0)).otherwise(value)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL for a zero denominator under ANSI mode."""
    return F.try_divide(top, bottom)


def short_number(value: Column, digits: int = 2) -> Column:
    """Round half to even and print without trailing zeros, as in ``0.5`` or ``12``."""
    text = F.bround(value, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def effect_text(estimate: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """``est (lo to hi)``; NULL when any part is NULL."""
    return F.concat(
        short_number(estimate, digits), F.lit(" ("), short_number(low, digits),
        F.lit(" to "), short_number(high, digits), F.lit(")"),
    )
