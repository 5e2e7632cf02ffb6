"""Rows that every operator must take: nulls, empty and long texts, repeats, columns with clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "kept", "h", "c", "n", "start", "spans", "_spans", "_doc", "node", "root", "ids", "row", "key", "first", "_words", "llr", "settled", "component", "_text", "label", "a", "b", "values", "n_words")


def odd_docs(spark):
    """With clashing columns beside the usual ones."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long_text = " ".join(rnd.choice(words) for _ in range(30_000))
    rows = [(1, "the quick brown fox"), (2, None), (3, ""), (4, " \t\n "), (5, long_text), (6, long_text), (7, "same words " * 40), (7, "same words " * 40), (8, "???"), (None, "a row without an id"), (9, "the quick brown fox")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({name: F.lit("x") for name in CLASHING})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
