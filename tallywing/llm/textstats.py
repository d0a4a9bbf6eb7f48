"""Statistics of whole texts as column expressions, without Python on the executors.

Texts are read as they are; a NULL text has no words and every statistic 0. Arrays that a lambda
reads at an index are bound first (``transform(array(x), a -> ...)[0]``), so that each is built once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: symbols.
SYMBOLS = r"[#*$%&|<>]"

_WINDOWS = """
    transform(array(transform(w, x -> xxhash64(x))), k ->
        transform(sequence(0, size(k) - 5), i -> xxhash64(k[i], k[i + 1], k[i + 2], k[i + 3], k[i + 4])))[0]
"""
#: Positions of windows found twice or more, then the words they cover.
_COVERED = """
    transform(array(sort_array(transform(hs, (h, i) -> struct(h, i)))), p ->
        aggregate(
            sort_array(transform(
                filter(sequence(0, size(p) - 1), j ->
                    (j > 0 and p[greatest(j - 1, 0)].h = p[j].h)
                    or (j < size(p) - 1 and p[least(j + 1, size(p) - 1)].h = p[j].h)),
                j -> p[j].i)),
            named_struct('n', 0, 'last', -5),
            (a, at) -> named_struct('n', a.n + least(5, at - a.last), 'last', at),
            a -> a.n))[0]
"""
_REPEATED = f"""
    case when size(w) < 6 then 0 else
        transform(array({_WINDOWS}), hs ->
            case when size(array_distinct(hs)) = size(hs) then 0 else {_COVERED} end)[0]
    end
"""
_PER_TEXT = f"""
    transform(array(filter(split(t, '[ \\\\t-\\\\r]+'), x -> x != '')), w -> named_struct(
        'n_words', size(w),
        'n_repeat_words', {_REPEATED}))[0]
"""
_LINES = """
    transform(array(filter(split(t, '\\\\n'), x -> x rlike '[^ \\\\t-\\\\r]')), ls ->
        named_struct('n', size(ls), 'd', size(ls) - size(array_distinct(ls))))[0]
"""
#: Fixed order: what a classifier may look at.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "ended_share", "mark_share", "words_a_line")


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with a struct of counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in
    five-word windows found twice or more, the first included), n_ended, n_upper, n_digits, n_marks, n_lines.

    The columns of ``docs`` are kept in one struct while the counts are made, so their names may be any but ``into``."""
    sized = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "*", F.expr(_PER_TEXT).alias(f"{into}_w"), F.expr(_LINES).alias(f"{into}_l"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[ \t-\r]"))).alias(f"{into}_c"),
    )
    w, ln = F.col(f"{into}_w"), F.col(f"{into}_l")
    stats = F.struct(
        w["n_words"].cast("long").alias("n_words"),
        F.col(f"{into}_c").cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        ln["d"].cast("long").alias("n_dup_lines"),
        w["n_repeat_words"].cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"[.!?](?=[ \t-\r]|$)")).cast("long").alias("n_ended"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("t", F.lit(r"[!?|{}<>\[\]@/\\=_~^]")).cast("long").alias("n_marks"),
        ln["n"].cast("long").alias("n_lines"),
    )
    return sized.select("row.*", stats.alias(into))


def features(stats: str = "stats") -> dict[str, Column]:
    """The figures a classifier looks at; a share of nothing is 0."""

    def share(part: str, whole: str):
        total = F.col(f"{stats}.{whole}")
        return F.when(total > 0, F.col(f"{stats}.{part}") / total).otherwise(0.0)

    return {
        "n_words": F.col(f"{stats}.n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "ended_share": share("n_ended", "n_words"),
        "mark_share": share("n_marks", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
    }
