"""Set operations. Columns are matched by position, as SQL does.

INTERSECT and EXCEPT label the rows of each side, put both together and group once. Copies are
combined inside the map tasks, so a row that repeats many times does not travel, and no join is
needed; nulls compare as equal because grouping treats them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(right)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(right).distinct()


def _by_presence(left: DataFrame, right: DataFrame, keep: Column) -> DataFrame:
    both = left.withColumn("_left", F.lit(True)).unionAll(right.withColumn("_left", F.lit(False)))
    seen = both.groupBy(*left.columns).agg(F.max("_left").alias("_in_left"), F.min("_left").alias("_only_left"))
    return seen.filter(keep).select(*left.columns)


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return _by_presence(left, right, F.col("_in_left") & ~F.col("_only_left"))


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return _by_presence(left, right, F.col("_only_left"))
