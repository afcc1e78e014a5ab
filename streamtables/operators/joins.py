"""Joins of streams and tables on equal keys, with optional spreading of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtables.functions.times import time_slot

#: Column that numbers the parts of a spread key.
SALT = "_salt"


def spread(left: DataFrame, right: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Give every left row one of ``parts`` numbers and every right row all of them.

    The number comes from the row and its input partition: a re-run task repeats it, and exact
    copies of a row in different partitions are spread too.
    """
    number = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(parts))
    left = left.withColumn(SALT, number.cast("int"))
    right = right.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left, right


def enrich(
    facts: DataFrame,
    dimension: DataFrame,
    fact_key: str,
    dimension_key: str,
    how: str = "inner",
    salt: int = 1,
) -> DataFrame:
    """Join facts with the rows of a dimension that have the same key.

    Works for two tables, for a stream and a table, and for two streams; two streams keep all
    rows in state because the join has no time bound. No side is hinted: Spark broadcasts the
    dimension only while its measured size is under ``spark.sql.autoBroadcastJoinThreshold``,
    and in batch adaptive execution splits hot keys of the sort-merge join. Streaming joins are
    not adaptive, so ``salt`` > 1 spreads a hot fact key over that many state partitions.
    Column names must differ between the sides; the dimension key is kept.
    """
    if how in ("left_semi", "left_anti"):
        # Only key existence matters, so copies of a key need not travel.
        dimension = dimension.select(dimension_key)
        if not dimension.isStreaming:
            dimension = dimension.distinct()
    condition: Column = F.col(fact_key) == F.col(dimension_key)
    if salt <= 1:
        return facts.join(dimension, condition, how)
    if how in ("right", "right_outer", "full", "full_outer"):
        raise ValueError("salting copies dimension rows, so it cannot preserve unmatched ones")
    left, right = spread(facts, dimension.withColumnRenamed(dimension_key, "_dim_key"), salt)
    right = right.withColumnRenamed(SALT, "_dim_salt")
    joined = left.join(right, (F.col(fact_key) == F.col("_dim_key")) & (F.col(SALT) == F.col("_dim_salt")), how)
    joined = joined.drop(SALT, "_dim_salt")
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.withColumnRenamed("_dim_key", dimension_key)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_time: str,
    right_time: str,
    within_seconds: int,
) -> DataFrame:
    """Pairs with equal keys where ``left_time <= right_time <= left_time + within``.

    Both sides are cut into time slots as long as the interval; a left row meets only its own
    and the next slot. A hot key is thereby split by time, and pairs outside the two slots are
    never formed. On two watermarked streams the time bounds let Spark drop old state.
    """
    length = within_seconds * 1_000_000
    own_slot = time_slot(left_time, length)
    spread = left.withColumn("_lslot", F.explode(F.array(own_slot, own_slot + length)))
    slotted = right.withColumn("_rslot", time_slot(right_time, length))
    condition = (
        (F.col(left_key) == F.col(right_key))
        & (F.col("_lslot") == F.col("_rslot"))
        & (F.col(right_time) >= F.col(left_time))
        & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within_seconds} SECONDS"))
    )
    return spread.join(slotted, condition, "inner").drop("_lslot", "_rslot")
