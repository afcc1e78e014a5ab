"""Ranking within groups and top-K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtables.operators.ordered import SLOT, Carry, Slot, carry_over, cut, in_order


def rank_rows(
    df: DataFrame, by: list[str], order: list[Column], name: str = "row_num", slot: Slot | None = None
) -> DataFrame:
    """ROW_NUMBER of every row within its group. ``order`` must be total within a group.

    With a ``slot`` that follows the order, rows are counted per slot and ranked inside slots, so
    a large group is shared by many tasks. Without one, a group is one task's.
    """
    if slot is None:
        return df.withColumn(name, F.row_number().over(in_order(by, order)).cast("long"))
    carried = carry_over(cut(df, slot), by, slot, [Carry("_earlier", F.count("*"), "sum")])
    local = F.row_number().over(in_order(by, order, slotted=True))
    rank = (local + F.coalesce(F.col("_earlier"), F.lit(0))).cast("long")
    return carried.withColumn(name, rank).drop("_earlier", SLOT)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "row_num") -> DataFrame:
    """The first ``k`` rows of each group, with their rank.

    Spark keeps K rows per group and map task before it shuffles, so a hot group costs no more
    than others, for every K up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    (``session.RECOMMENDED`` raises it).
    """
    return df.withColumn(name, F.row_number().over(in_order(by, order))).filter(F.col(name) <= k)
