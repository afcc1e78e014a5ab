"""Checks of declared constraints that no engine enforces by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_missing(required: list[str]) -> Column:
    """Whether a row lacks one of the columns."""
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in required], F.lit(False))


def split_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows): quarantined rows lack a required column."""
    missing = any_missing(required)
    return df.filter(~missing), df.filter(missing)


def required_report(df: DataFrame, required: list[str]) -> DataFrame:
    """Missing values per required column, as rows (column_name, missing, total)."""
    if not required:
        return df.sparkSession.createDataFrame([], "column_name string, missing long, total long")
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing_{i}") for i, c in enumerate(required)],
    )
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"missing_{i}").alias("missing")) for i, c in enumerate(required)]
    return counts.select(F.inline(F.array(*pairs)), "total").select("column_name", "missing", "total")


def duplicate_keys(df: DataFrame, key: list[str], count_name: str = "copies") -> DataFrame:
    """Primary keys that occur more than once. Counting is combined before the shuffle."""
    return df.groupBy(*key).agg(F.count("*").alias(count_name)).filter(F.col(count_name) > 1)
