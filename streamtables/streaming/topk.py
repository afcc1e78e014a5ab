"""Top-K per window and group over a stream of window counts.

Spark refuses ``row_number`` on a stream. Counts of a closed window all arrive in one
micro-batch of an append-mode aggregation, so ranking that batch is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtables.operators.ranking import top_k
from streamtables.streaming.changelog import ChangelogSink
from streamtables.streaming.upsert import UpsertSink


def rank_closed(by: list[str], order: list[Column], k: int):
    """Batch transform for ``foreachBatch``: the top K of each window in the batch."""

    def transform(batch: DataFrame) -> DataFrame:
        return top_k(batch, ["window_start", "window_end", *by], order, k).drop("row_num")

    return transform


def top_k_array(counts: DataFrame, by: list[str], best: Column, rest: list[str], k: int) -> DataFrame:
    """Top K as a second aggregation over window counts, without leaving the DataFrame.

    ``best`` is a struct whose larger value ranks first. The aggregate keeps K structs per group
    in every map task and in state, never the whole group. Expects the window struct column
    ``window``, which carries the watermark from the first aggregation to the second.
    ``collect_top_k`` comes with Spark but is not in its public function list.
    """
    from pyspark.sql.internal import InternalFunction

    entry = F.struct(best.alias("best"), *rest)
    grouped = counts.groupBy("window", *by).agg(InternalFunction.collect_top_k(entry, k, False).alias("_top"))
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        F.explode("_top").alias("_e"),
    ).select("window_start", "window_end", *by, *[F.col(f"_e.{c}").alias(c) for c in rest])


RANK = "row_num"
_GONE = "_gone"


@dataclass
class RunningTopK:
    """The top K of each group over values that change with every batch, such as running counts.

    ``values`` keeps the image of all values (its key names an item, ``by`` a group). A batch ranks
    again only the groups that it touches, from that image, so an item that loses its place
    can come back, also if values fall or items go. The chart is kept as an image with a
    changelog: what a batch writes are the places that changed, with their row kinds.
    """

    values: UpsertSink
    path: str
    by: list[str]
    order: list[Column]
    k: int

    @property
    def chart(self) -> ChangelogSink:
        return ChangelogSink(UpsertSink(self.path, [*self.by, RANK], [], F.col(_GONE)))

    def write(self, batch: DataFrame, number: int) -> None:
        """Write one batch of values; usable as the function of ``foreachBatch`` in ``update`` mode."""
        spark = batch.sparkSession
        self.values.write(batch, number)
        # A group may lose an item to another group, so groups are those before and after.
        items = batch.select(*self.values.key).distinct()
        touched = batch.select(*self.by)
        known = self.values.below(spark, number)
        if known is not None:
            touched = touched.unionByName(known.join(items, self.values.key, "left_semi").select(*self.by))
        touched = touched.distinct()
        ranked = top_k(_among(self.values.image(spark, number), touched, self.by), self.by, self.order, self.k, RANK)
        ranked = ranked.withColumn(RANK, F.col(RANK).cast("long")).withColumn(_GONE, F.lit(False))
        # Places of these groups that nobody has any more.
        places = touched.withColumn(RANK, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(self.k).cast("long"))))
        free = _among(places, ranked.select(*self.by, RANK), [*self.by, RANK], "left_anti").withColumn(_GONE, F.lit(True))
        self.chart.write(ranked.unionByName(free, allowMissingColumns=True), number)

    def read(self, spark: SparkSession) -> DataFrame:
        """The chart as it is."""
        return self.chart.sink.image(spark).drop(_GONE)


def _among(rows: DataFrame, keys: DataFrame, by: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or is not) among ``keys``; null equals null."""
    other = keys.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)])
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)], how)
