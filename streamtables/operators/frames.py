"""OVER aggregation with ROWS and RANGE frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from streamtables.functions.times import time_slot
from streamtables.operators.ordered import SLOT, Carry, Slot, carry_over, cut, in_order
from streamtables.operators.ranking import rank_rows


def _over(aggregates: dict[str, Column], window: WindowSpec) -> list[Column]:
    return [a.over(window).alias(name) for name, a in aggregates.items()]


def over_rows(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    preceding: int,
    aggregates: dict[str, Column],
    slot: Slot | None = None,
    block_rows: int = 100_000,
) -> DataFrame:
    """Aggregates over the current row and the ``preceding`` rows before it.

    With a ``slot`` that follows the order, groups are numbered and cut into blocks of rows. Each
    block also gets the last ``preceding`` rows of the one before, which is all its frames can
    reach. Without one, a group is one task's.
    """
    if slot is None:
        frame = in_order(by, order).rowsBetween(-preceding, 0)
        return df.select("*", *_over(aggregates, frame))
    block_rows = max(block_rows, preceding + 1)
    numbered = rank_rows(df, by, order, "_n", slot)
    position = F.col("_n") - 1
    block = position - F.pmod(position, F.lit(block_rows))
    reaches_next = F.pmod(position, F.lit(block_rows)) >= block_rows - preceding
    both = F.array(block, block + block_rows)
    blocks = numbered.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(reaches_next, both).otherwise(F.array(block)))
    )
    frame = Window.partitionBy(*by, "_block").orderBy("_n").rowsBetween(-preceding, 0)
    result = blocks.select("*", *_over(aggregates, frame))
    return result.filter(F.col("_home") == F.col("_block")).drop("_n", "_home", "_block")


# How a RANGE aggregate is taken over some rows, and how two such parts are put together.
_TAKE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a + b, a, b),
    "min": F.least,
    "max": F.greatest,
}


def over_range(
    df: DataFrame, by: list[str], time: str, range_seconds: int, aggregates: dict[str, tuple[str, str]]
) -> DataFrame:
    """Aggregates over the rows of the last ``range_seconds`` up to the current row's time.

    ``aggregates`` maps a result name to (``sum`` | ``count`` | ``min`` | ``max``, column).

    Time is cut into slots as long as the range, so a frame is the end of one slot and the
    start of the next. Aggregates from the start and to the end of each slot are running ones;
    each row then looks up where its frame begins in the slot before. A frame is never summed
    row by row, so dense frames cost no more than sparse ones, and a large group is split by
    slot.
    """
    reach = range_seconds * 1_000_000
    slot = [*by, "_slot"]
    cut = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_slot", time_slot(time, reach))
    from_start = Window.partitionBy(*slot).orderBy(F.col("_t").asc()).rangeBetween(Window.unboundedPreceding, 0)
    to_end = Window.partitionBy(*slot).orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    parts = cut.select(
        *by,
        "_t",
        "_slot",
        F.struct(*[c for c in df.columns if c not in by]).alias("_row"),
        F.struct(*[_TAKE[kind](c).over(from_start).alias(n) for n, (kind, c) in aggregates.items()]).alias("_head"),
        F.struct(*[_TAKE[kind](c).over(to_end).alias(n) for n, (kind, c) in aggregates.items()]).alias("_tail"),
    )
    # A row of the slot before, moved on by the range, lies where the frames it opens end. Rows
    # without a time form one frame, and moving them on would make them meet themselves.
    opening = parts.filter(F.col("_t").isNotNull()).select(
        *by, (F.col("_t") + reach).alias("_t"), (F.col("_slot") + reach).alias("_slot"), "_tail", F.lit(0).alias("_side")
    )
    current = parts.drop("_tail").withColumn("_side", F.lit(1))
    line = current.unionByName(opening, allowMissingColumns=True)
    nearest = Window.partitionBy(*slot).orderBy(F.col("_t").desc(), F.col("_side").asc())
    framed = line.withColumn("_before", F.last("_tail", ignorenulls=True).over(nearest)).filter(F.col("_side") == 1)
    merged = {n: _MERGE[kind](F.col(f"_head.{n}"), F.col(f"_before.{n}")) for n, (kind, _) in aggregates.items()}
    columns = [F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return framed.select(*columns, *[v.alias(n) for n, v in merged.items()])


def running_sum(
    df: DataFrame, by: list[str], order: list[Column], value: Column, name: str, slot: Slot | None = None
) -> DataFrame:
    """Sum of ``value`` over all rows of the group up to the current one; the order is total.

    With a ``slot`` that follows the order, slots are summed and each row adds up its own slot.
    Sums of doubles depend on the slots (which change the order of additions), not on sizes.
    """
    df = df.withColumn("_value", value)
    if slot is None:
        frame = in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum("_value").over(frame)).drop("_value")
    carried = carry_over(cut(df, slot), by, slot, [Carry("_earlier", F.sum("_value"), "sum")])
    frame = in_order(by, order, slotted=True).rowsBetween(Window.unboundedPreceding, 0)
    local, earlier = F.sum("_value").over(frame), F.col("_earlier")
    total = F.coalesce(local + earlier, local, earlier)
    return carried.withColumn(name, total).drop("_value", "_earlier", SLOT)
