"""Order-dependent work on groups that may be too large for one task.

``row_number``, running sums, "last value so far" and sessions need the rows of a group in
order. Spark's window puts a whole group into one task. Here a group is cut into *slots* that
follow its order, such as days of its time column or the values of its leading order column.
Each slot is worked on alone; what it must know about the slots before it comes from a summary
with one row per group and slot. The cut depends on the declared slot only, never on how many
rows a group has, so results don't change with the size of the data, and nothing runs while a
plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtables.functions.times import time_slot
from streamtables.session import run_dir

SLOT = "_slot"

#: Length of time slots unless another is given.
DAY_SECONDS = 86_400


@dataclass(frozen=True)
class Slot:
    """An expression that only grows (or, with ``falling``, only shrinks) along a group's order."""

    of: Column
    falling: bool = False

    def order(self) -> Column:
        return F.col(SLOT).desc_nulls_last() if self.falling else F.col(SLOT).asc_nulls_first()


def slots_of_time(column: str, seconds: int = DAY_SECONDS) -> Slot:
    """Slots of so many seconds along an ascending time column."""
    return Slot(time_slot(column, seconds * 1_000_000))


def slots_of_values(column: str, falling: bool = False) -> Slot:
    """One slot for each value of the leading order column; for columns with few values a group."""
    return Slot(F.col(column), falling)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it from there.

    Later passes read only the columns they need, and lost executors do not change the rows.
    """
    path = run_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, slot: Slot) -> DataFrame:
    return df.withColumn(SLOT, slot.of)


def in_order(keys: list[str], order: list[Column], slotted: bool = False):
    """Window over a group in order, or over one of its slots."""
    return Window.partitionBy(*keys, *([SLOT] if slotted else [])).orderBy(*order)


@dataclass(frozen=True)
class Carry:
    """One value handed from slot to slot: how to take it inside a slot and how to join it up.

    ``kind`` is ``sum`` (add the parts) or ``last`` (the latest part that is not null).
    """

    name: str
    inside: Column
    kind: str


def carry_over(slotted: DataFrame, keys: list[str], slot: Slot, carries: list[Carry]) -> DataFrame:
    """Add, to each row, what the earlier slots of its group hold (null if nothing).

    The summary is aggregated inside the map tasks. Its join is on group and slot, so a large
    group is spread over its slots.
    """
    summary = slotted.groupBy(*keys, SLOT).agg(*[c.inside.alias(c.name) for c in carries])
    before = Window.partitionBy(*keys).orderBy(slot.order()).rowsBetween(Window.unboundedPreceding, -1)
    running = {
        c.name: F.sum(c.name).over(before) if c.kind == "sum" else F.last(c.name, ignorenulls=True).over(before)
        for c in carries
    }
    names = {k: f"_of_{i}" for i, k in enumerate([*keys, SLOT])}
    carried = summary.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], *[v.alias(n) for n, v in running.items()])
    match = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()])
    return slotted.join(carried, match, "left").drop(*names.values())
