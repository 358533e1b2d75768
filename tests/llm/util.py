"""Small documents with every awkward case, shared by the operator tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
# Names that operators use inside; a table may bring columns called the same.
CLASH = ["label", "score", "size", "node", "component", "word", "n", "idx", "row", "path", "known", "draw", "first"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and blank texts, one very long text, one very long word, ties, repeated rows."""
    rng = random.Random(seed)
    base = sentence(rng, 60)
    rows = [(1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)),
            (3, base + " extra words here", "en", "b", 0), (4, None, "en", "a", None), (5, "", "de", "a", 0),
            (6, " \t\n ", None, "b", 3), (7, sentence(rng, 3), None, None, 9),
            (8, sentence(rng, 120_000), "de", "a", 1), (9, "x" * 200_000, "en", None, 2),
            (10, "1234 !!! ???", "fr", "c", 12), (11, "Ünïcödé     text \x0b with\x0cgaps", "fr", "c", 5),
            (12, base.upper(), "fr", "c", 5), (None, sentence(rng, 30), "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[6]] * 2
    rows += [(20 + i, sentence(rng, 40), rng.choice(["en", "de"]), rng.choice("abc"), 1) for i in range(30)]
    return rows


def docs(spark: SparkSession, rows: list[tuple] | None = None, clash: bool = True) -> DataFrame:
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if clash:
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASH])
    return df


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS draw", "2 AS n")
