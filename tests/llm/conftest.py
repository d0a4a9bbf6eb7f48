import pytest

LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs home again today.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "  \n\t ", "en", "b"),
    (5, LONG, "en", "a"),
    (6, "spam " * 60, "en", None),
    (7, "The quick brown fox jumps over the lazy dog and runs home again today.", "en", "b"),
    (7, "The quick brown fox jumps over the lazy dog and runs home again today.", "en", "b"),
    (None, "A text without an id that holds a few words more than ten, so it counts.", "de", "c"),
    (9, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.\nZweite Zeile, kurz.", "de", "a"),
    (9, "Another text with the same id, which must not be mixed up with it at all.", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, lang, source, None if t is None else len(t), "x", 1, 2.0, "y", True, 5) for i, t, lang, source in ROWS]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, stats string, t int, size double, `row` string, "
              "place boolean, n_removed long")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = 12345")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
