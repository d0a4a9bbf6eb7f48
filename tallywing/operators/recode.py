"""Ordered label recoding.

A chain of "if a then b" rules runs top to bottom, and a later rule sees what an earlier one made.
The chain is folded once on the driver into a plain old-to-final map, so each row does one lookup
whatever the length of the chain.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str | None]


def closure(rules: Iterable[Rule]) -> dict[str, str | None]:
    """Fold ordered rules into ``{label: final label}``. NULL is final: no rule matches it."""
    rules = list(rules)
    final: dict[str, str | None] = {}
    for start, _ in rules:
        label: str | None = start
        for old, new in rules:
            if label == old:
                label = new
        final[start] = label
    return final


def lookup(label: Column, mapping: dict[str, str]) -> Column:
    """Value for ``label`` in a fixed mapping, NULL when absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), label)


def recode(label: Column, rules: Iterable[Rule]) -> Column:
    """Apply an ordered rule chain to a label column."""
    mapping = closure(rules)
    to_null = [old for old, new in mapping.items() if new is None]
    texts = {old: new for old, new in mapping.items() if new is not None}
    out = F.coalesce(lookup(label, texts), label) if texts else label
    return F.when(~label.isin(*to_null), out) if to_null else out


def recode_from_table(df: DataFrame, column: str, table: DataFrame, old: str, new: str) -> DataFrame:
    """The same for a user's own mapping table with unique ``old`` labels."""
    pairs = table.select(F.col(old).alias(column), F.col(new).alias("__new"))
    return df.join(pairs, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def factor_code(label: Column, levels: Iterable[object]) -> Column:
    """1-based position of ``label`` in ``levels``; NULL for a value outside them."""
    levels = list(levels)
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), label)
    return F.when(position > 0, position.cast("int"))
