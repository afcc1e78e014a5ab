"""Streaming forms of operators whose batch form differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_closed(df: DataFrame, time: str, size: str, by: list[str], name: str = "play_count") -> DataFrame:
    """COUNT(*) per tumbling window and group, each window emitted once when the watermark
    passes its end; later rows are dropped. Keeps the window struct for further aggregation."""
    return df.groupBy(F.window(time, size).alias("window"), *by).agg(F.count("*").alias(name))


def session_closed(df: DataFrame, time: str, gap: str, by: list[str], name: str = "play_count") -> DataFrame:
    """COUNT(*) per session, emitted when the watermark passes the session's end."""
    window = F.session_window(time, gap).alias("window")
    return df.groupBy(window, *by).agg(F.count("*").alias(name))


def first_seen(df: DataFrame, key: list[str], two_steps: bool = False) -> DataFrame:
    """First row per key within the watermark.

    With ``two_steps`` copies are dropped first among rows read by neighbouring tasks and then
    overall, so a key with very many copies does not meet in one state partition at once. The
    price is state: every key is kept once more for each group of tasks that saw it, up to as
    many as there are shuffle partitions.
    """
    if not two_steps:
        return df.dropDuplicatesWithinWatermark(key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    return near.dropDuplicatesWithinWatermark([*key, "_part"]).drop("_part").dropDuplicatesWithinWatermark(key)


def count_distinct_closed(df: DataFrame, time: str, size: str, by: list[str], value: str, name: str) -> DataFrame:
    """Distinct values per tumbling window and group, emitted when the window closes.

    Spark refuses ``count(DISTINCT …)`` on a stream, so values are made unique first and counted
    by a second aggregation over the same windows. State holds each value once a window.
    """
    window = F.window(time, size).alias("window")
    unique = df.filter(F.col(value).isNotNull()).groupBy(window, *by, value).agg(F.lit(1).alias("_one"))
    return unique.groupBy("window", *by).agg(F.count("*").alias(name))


def running_aggregate(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """Unwindowed aggregate; start it in ``update`` mode into an upsert sink."""
    return df.groupBy(*by).agg(*aggregates)


def last_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key so far, by ``order``; start it in ``update`` mode into an upsert sink.

    State holds one row for each key. A row that is not later than the one known changes nothing.
    """
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
