"""Small documents with the odd cases that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string, kept string, _row int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    passage = prose(1, 60)
    long_text = prose(2, 4000, 3000)
    texts = [
        (1, "alpha beta gamma"),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, passage),
        (6, f"{prose(3, 30)} {passage} {prose(4, 30)}"),
        (7, f"{prose(5, 10)}\n{passage}"),
        (8, long_text),
        (9, long_text),
        (10, long_text + " end"),
        (11, "alpha beta gamma"),
        (12, "déjà vu é x \U0001f600 ends"),
        (12, "déjà vu é x \U0001f600 ends"),
        (13, passage),
        (13, "another text of the same id " + passage),
        (None, "alpha beta gamma"),
        (None, None),
        (15, "same " * 300),
        (16, "A line that is shared by many documents, longer than forty characters\nshort\n\n"),
        *[(20 + i, f"own {i}\n  a line THAT is shared by many documents, longer than forty characters\t\nx{i}") for i in range(6)],
    ]
    languages, sources = ["en", "de", None], ["b", "a", None, "ä"]
    return [
        (i, t, languages[n % 3], sources[n % 4], None if t is None else len(t), f"id{n}", None, "kept", n)
        for n, (i, t) in enumerate(texts)
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
