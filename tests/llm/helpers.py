"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    words = ["w" + "".join(draw.choices("abcdefghij", k=4)) for _ in range(vocabulary)]
    return " ".join(draw.choice(words) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text) pairs, or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """NULLs in every column, empty and long texts, ties and repeated rows."""
    base = prose(1, 120)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (None, base), (None, None),
            (6, prose(2, 20_000)), (7, "one"), (8, "ünï çødé \U0001F600 " * 30), (9, "x" * 100_000), (10, "a b c d\n" * 50)]
    docs = documents(spark, rows)
    nulls = spark.createDataFrame([(11, "some words here", None, None, None)], DOCS)
    return docs.union(nulls)


CLASHES = ("row_key", "drops", "words", "kept", "rank", "bucket", "component", "stratum", "_drops", "row", "h1", "text_", "line")


def with_clashes(docs):
    return docs.withColumns({c: F.lit(c) for c in CLASHES})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
