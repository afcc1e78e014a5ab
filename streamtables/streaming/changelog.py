"""A changelog with row kinds: what each batch changes in a keyed image.

A batch of an upsert stream says what a key's row is now. Readers that keep sums need to know
what it was, too. Each batch is therefore compared with the image before it, in one join, and
written as rows with a kind in front: ``+I`` (a key's first row), ``-U`` and ``+U`` (the row
before and after a change) and ``-D`` (the row that is removed). A row of the kinds ``+I`` and
``+U`` counts once, one of the others takes one away; so added up, a changelog is the image, and
any aggregate that can subtract stays right downstream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from streamtables.streaming.files import committed, make_folder, read_numbered, write_numbered
from streamtables.streaming.upsert import BATCH, DELETED, UpsertSink

OP = "op"
INSERT, BEFORE, AFTER, DELETE = "+I", "-U", "+U", "-D"


def sign(op: str = OP) -> Column:
    """One for rows that a change adds, minus one for rows that it takes away."""
    return F.when(F.col(op).isin(INSERT, AFTER), 1).when(F.col(op).isin(BEFORE, DELETE), -1).cast("long")


def changes(image: DataFrame, batch: DataFrame, key: list[str], precedence: list[str]) -> DataFrame:
    """What ``batch`` (one row per key, marked ``DELETED``) changes in ``image`` (removed keys included).

    ``precedence`` decides whether the row of the batch or the one of the image is newer.
    """
    columns = [c for c in batch.columns if c not in (DELETED, BATCH)]
    row = F.struct(*columns)
    rank = F.struct(*precedence) if precedence else F.lit(True)
    new = batch.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], row.alias("_new"), F.col(DELETED).alias("_gone"), rank.alias("_new_rank"))
    old = image.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(key)], row.alias("_old"), F.col(DELETED).alias("_old_gone"), rank.alias("_old_rank"))
    match = [F.col(f"_k{i}").eqNullSafe(F.col(f"_o{i}")) for i in range(len(key))]
    both = new.join(old, match, "left")
    known = F.col("_old_gone").isNotNull()
    was, is_ = known & ~F.col("_old_gone"), ~F.col("_gone")
    newer = ~known | (F.col("_new_rank") >= F.col("_old_rank"))
    entry = lambda op, of: F.struct(F.lit(op).alias(OP), F.col(of).alias("_row"))
    none = F.array().cast(f"array<struct<{OP}:string,_row:{both.schema['_new'].dataType.simpleString()}>>")
    made = (
        F.when(~newer, none)
        .when(is_ & ~was, F.array(entry(INSERT, "_new")))
        .when(is_ & was & ~F.col("_new").eqNullSafe(F.col("_old")), F.array(entry(BEFORE, "_old"), entry(AFTER, "_new")))
        .when(~is_ & was, F.array(entry(DELETE, "_old")))
        .otherwise(none)
    )
    return both.select(F.explode(made).alias("_change")).select(f"_change.{OP}", "_change._row.*")


@dataclass
class ChangelogSink:
    """Keeps the image of ``sink`` and writes the changelog beside it.

    The changelog of a batch is made from the image below its number and written first, so a
    batch that is repeated after a failure writes the same rows into the same folders.
    """

    sink: UpsertSink

    @property
    def path(self) -> str:
        return f"{self.sink.path}/changelog"

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = self.sink.marked(batch, number)
        image = self.sink.below(spark, number)
        rows = changes(image if image is not None else marked.limit(0), marked, self.sink.key, self.sink.precedence())
        write_numbered(rows, self.path, number)
        self.sink.write(batch, number)

    def read(self, spark: SparkSession) -> DataFrame:
        """All changes so far."""
        return read_numbered(spark, self.path, committed(spark, self.path))

    def live(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The changes as a stream; ``schema`` is that of the rows."""
        make_folder(spark, self.path)
        whole = StructType([StructField(OP, StringType()), *schema.fields])
        return spark.readStream.schema(whole).parquet(f"{self.path}/b=*")


def fold(changelog: DataFrame) -> DataFrame:
    """The image that a changelog adds up to, in whatever order its rows come."""
    columns = [c for c in changelog.columns if c != OP]
    added = changelog.groupBy(*columns).agg(F.sum(sign()).alias("_count"))
    return added.filter(F.col("_count") > 0).drop("_count")


def retracting_count(changelog: DataFrame, by: list[str], name: str) -> DataFrame:
    """COUNT(*) per group of the rows that are there; on a stream start it in ``update`` mode.

    A group whose rows are all gone has a count of zero, which tells an upsert sink to remove it.
    """
    return changelog.groupBy(*by).agg(F.sum(sign()).alias(name))


def retracting_sum(changelog: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """SUM(value) and COUNT(*) (``name`` and ``rows``) per group of the rows that are there."""
    return changelog.groupBy(*by).agg(F.sum(value * sign()).alias(name), F.sum(sign()).alias("rows"))


