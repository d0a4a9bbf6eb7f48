"""Label clean-up. Patterns act on the first match only, which Spark's own replace does not do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match; ``pattern`` must not hold capturing groups."""
    return F.regexp_replace(text, rf"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def strip_first(text: Column, pattern: str) -> Column:
    return replace_first(text, pattern, "")


def null_if_in(text: Column, *values: str) -> Column:
    return F.when(~text.isin(*values), text)


def null_if_matches(text: Column, pattern: str) -> Column:
    return F.when(~text.rlike(pattern), text)


def dotted_label(text: Column) -> Column:
    """``Minutes of Observation`` to ``minutes.of.observation``."""
    return F.translate(F.lower(text), " ", ".")


def join_present(separator: str, *parts: Column) -> Column:
    """Join the non-NULL parts; NULL when there are none."""
    joined = F.concat_ws(separator, *parts)
    return F.when(joined != "", joined)


def leading_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\w*", 0)


def leading_digits(text: Column) -> Column:
    return F.regexp_extract(text, r"^\d*", 0)


def pad_clock(text: Column) -> Column:
    """``6:15`` or ``6;15`` to ``06:15``."""
    return F.regexp_replace(text, r"^(\d)\p{Punct}", "0$1:")
