"""Version-aware operators: as-of join, keep first / last, latest image of a changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtables.operators.ordered import DAY_SECONDS, Carry, carry_over, cut, in_order, slots_of_time


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    by: list[str],
    fact_time: str,
    version_time: str,
    fact_order: list[str],
    version_order: list[str] | None = None,
    how: str = "inner",
    slot_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Join each fact with the version of its key that was valid at the fact's time.

    Facts and versions are laid out on one time line per key and the latest version is carried
    forward, so the work grows with the number of rows and not with the pairs of a key. The line
    is cut into slots of ``slot_seconds``; a slot starts from the last version of those before it.
    ``by`` columns exist on both sides; ``fact_order`` and ``version_order`` break ties of time.
    """
    fact_columns = [c for c in facts.columns if c not in by]
    version_columns = [c for c in versions.columns if c not in by]
    version_order = version_order or []
    line = facts.select(
        *by,
        F.col(fact_time).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*fact_order).alias("_fact_tie"),
        F.struct(*fact_columns).alias("_fact"),
    ).unionByName(
        # A missing key equals nothing, as in any join.
        versions.dropna(subset=by).select(
            *by,
            F.col(version_time).alias("_t"),
            F.lit(0).alias("_side"),
            F.struct(*(version_order or [version_time])).alias("_version_tie"),
            F.struct(*version_columns).alias("_version"),
        ),
        allowMissingColumns=True,
    )
    order = [F.col(c).asc() for c in ("_t", "_side", "_version_tie", "_fact_tie")]
    slot = slots_of_time("_t", slot_seconds)
    position = F.struct("_t", "_side", "_version_tie")
    newest = F.max_by("_version", F.when(F.col("_side") == 0, position))
    line = carry_over(cut(line, slot), by, slot, [Carry("_carried", newest, "last")])
    local = F.last("_version", ignorenulls=True).over(in_order(by, order, slotted=True))
    valid = F.coalesce(local, F.col("_carried"))
    joined = line.withColumn("_valid", valid).filter(F.col("_side") == 1)
    if how == "inner":
        joined = joined.filter(F.col("_valid").isNotNull())
    return joined.select(
        *by,
        *[F.col(f"_fact.{c}").alias(c) for c in fact_columns],
        *[F.col(f"_valid.{c}").alias(c) for c in version_columns],
    )


def _one_per_key(df: DataFrame, key: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(pick(F.struct(*rest)).alias("_row"))
    return kept.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``. Copies are reduced inside the map tasks."""
    return _one_per_key(df, key, lambda row: F.min_by(row, F.struct(*order)))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``."""
    return _one_per_key(df, key, lambda row: F.max_by(row, F.struct(*order)))


def latest_image(
    changes: DataFrame, key: list[str], order: list[str], deleted: Column | None = None
) -> DataFrame:
    """Current image of a keyed changelog: the last row per key, without deleted keys.

    ``deleted`` tells from a row whether it removes its key.
    """
    image = keep_last(changes, key, order)
    return image if deleted is None else image.filter(~F.coalesce(deleted, F.lit(False)))
