"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

LONG = "the clown of http://a.b and cc by words 4111 1111 1111 1111 a@b.co " * 3000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away again today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away again today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away again today"),
    (3, None), (4, ""), (None, "a null id, +49 151 123 4567 and 10.0.0.1"), (None, None), (5, "   \n\t "),
    (6, LONG), (7, "x" * 50_000), (8, "you idiot clown"), (9, "Ünïcödé 你好 🙂 'tis I'll it's 1²½"), (-1, "negative id"), (10, "1" * 30_000),
    (11, "ab1" * 9000 + " a.b" * 2000 + "@" * 500), (12, " "), (13, "\x00 \x1c zero"),
]
#: Names that operators use inside, as columns of the input.
CLASHES = [
    "row", "vec", "word", "n", "score", "tile", "fp", "kind", "start", "end", "_m", "_g", "unit", "held_out", "count", "predicted", "text_hash",
    "component_id", "_key", "_sum", "_n", "_group", "pos", "span", "shard", "slot", "base", "c", "piece",
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with clashing extra columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3, F.lit(1))
    return docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | {c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, i % 2) for i in range(1, 14)] + [(8, 1, 1), (8, 0, 0), (None, 1, 1), (9, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
