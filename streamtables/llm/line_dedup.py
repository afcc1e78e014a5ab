"""Line deduplication: lines that many documents share stay in one of them.

Lines are exploded, normalised and hashed; distinct documents per hash are counted with
map-side combining; only positions of dropped lines travel back to their documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.llm.common import LOWER, SPACES, UPPER, boxed, id_key, unboxed, whole_text


def line_key(line: Column) -> Column:
    """The line without outer white space and with A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


@F.pandas_udf(T.StringType())
def _without_lines(text: pd.Series, drops: pd.Series) -> pd.Series:
    def kept(t, gone):
        if gone is None:
            return t
        gone = set(gone)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([kept(t, g) for t, g in zip(text, drops, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share, except in the largest ``doc_id``.

    Returns the columns of ``docs`` with ``n_lines``, ``n_dropped`` (both before and by the
    dropping) and ``kept_text``. Columns of ``docs`` with these names are replaced.

    Only keys of at least ``min_chars`` code points count. A null text is one empty line. Rows
    that share a ``doc_id`` are one document when counting, and each keeps its own row; a null
    ``doc_id`` is one document, before all others. Lines are matched by a 128-bit hash.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(
        boxed(own), id_key().alias("_id"), whole_text().alias("_text"), F.xxhash64(whole_text()).alias("_tie")
    )
    lines = rows.select("_id", "_tie", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).filter(F.length("_key") >= min_chars)
    lines = lines.select("_id", "_tie", "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"))
    shared = (
        lines.groupBy("_h", "_g")
        .agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_keeper"))
        .filter(F.col("_docs") >= min_docs)
    )
    drops = (
        lines.join(shared, ["_h", "_g"])
        .filter(F.col("_id") != F.col("_keeper"))
        .groupBy("_id", "_tie")
        .agg(F.collect_set("_pos").alias("_drops"))
    )
    kept = rows.join(drops, ["_id", "_tie"], "left")
    return kept.select(
        *unboxed(own),
        F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        _without_lines("_text", "_drops").alias("kept_text"),
    )
