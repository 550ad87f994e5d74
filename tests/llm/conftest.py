import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, repeated, very long and blank texts, ties, and columns with names that operators use inside."""
    rows = [
        (0, "The cat sat on the mat and the dog slept by the door of the house.", "en", "a", 1),
        (1, "The  cat sat on the mat\nand the dog slept by the door of the house.", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n", "en", "b", 3),
        (5, "word " * 40_000, "en", "a", 200_000),
        (5, "word " * 40_000, "en", "a", 200_000),
        (6, "x" * 120_000, "en", None, 120_000),
        (7, "ÄÖÜ straße 日本語 😀 mañana\x0bça", "de", "c", 1),
        (8, "one", "en", "c", 1),
        (9, "One", "en", "c", 1),
        (10, "ab" * 400, "en", "é", 800),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "fp", "hash", "_text", "shard", "bucket", "size", "s", "n", "_id", "_y", "_n", "_sha", "_place", "_times", "_h", "_gone", "rows", "kept", "stay", "node", "root", "id", "target", "start", "block", "html", "a.b"):
        df = df.selectExpr("*", f"'clash' as `{name}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
