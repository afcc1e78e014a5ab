"""Targets that sort the rows of a stream out in one pass, and count them on the way.

A batch is read once: its rows are written to a folder with one sub-folder per outcome, while an
``observe`` counts what passes by. Nothing is dropped; what a query leaves out can be read,
counted and replayed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from streamtables.operators.checks import any_missing
from streamtables.streaming.files import committed, read_numbered, write_numbered

OUTCOME = "_outcome"


def _sorted_out(batch: DataFrame, outcome: Column, path: str, number: int, counts: list[Column]) -> dict:
    """Write a batch by outcome and return what was counted on the way."""
    seen = Observation()
    observed = batch.withColumn(OUTCOME, outcome).observe(seen, *counts)
    write_numbered(observed, path, number, by=OUTCOME)
    return seen.get


def _with_outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    rows = read_numbered(spark, path, committed(spark, path), path)
    return rows.filter(F.col(OUTCOME) == outcome).drop(OUTCOME, "b")


@dataclass
class LateRows:
    """Parts the rows of a stream in those on time and those behind the watermark.

    As in Spark, the watermark of a batch is the latest time of the batches before it, less the
    delay, and only moves forward; a row is late if its time is at or before it. Spark drops such rows
    in operators with state, this keeps them. A row without a time is on time.
    """

    path: str
    time: str
    delay_seconds: float

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows"

    @property
    def _latest(self) -> str:
        return f"{self.path}/latest"

    def watermark(self, spark: SparkSession, number: int) -> int | None:
        """Microseconds of the watermark of a batch; None before any time was seen."""
        before = [n for n in committed(spark, self._latest) if n < number]
        if not before:
            return None
        # Each batch keeps the latest time so far, so the last one says it all.
        latest = read_numbered(spark, self._latest, before[-1:]).first()["latest"]
        return None if latest is None else latest // 1000 * 1000 - int(self.delay_seconds * 1_000_000)

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        passed = self.watermark(spark, number)
        at = F.unix_micros(F.col(self.time).cast("timestamp"))
        late = F.coalesce(at <= F.lit(passed), F.lit(False)) if passed is not None else F.lit(False)
        outcome = F.when(late, "late").otherwise("on_time")
        counted = _sorted_out(batch, outcome, self._rows, number, [F.max(at).alias("latest"), F.count_if(late).alias("late"), F.count("*").alias("rows")])
        before = [n for n in committed(spark, self._latest) if n < number]
        known = read_numbered(spark, self._latest, before[-1:]).first()["latest"] if before else None
        latest = max(filter(lambda x: x is not None, (known, counted["latest"])), default=None)
        row = [(latest, counted["late"] or 0, counted["rows"] or 0)]
        write_numbered(spark.createDataFrame(row, "latest long, late long, rows long").coalesce(1), self._latest, number)

    def on_time(self, spark: SparkSession) -> DataFrame:
        return _with_outcome(spark, self._rows, "on_time")

    def late(self, spark: SparkSession) -> DataFrame:
        return _with_outcome(spark, self._rows, "late")

    def counts(self, spark: SparkSession) -> DataFrame:
        """Late rows and all rows of every batch (``batch``, ``late``, ``rows``)."""
        rows = read_numbered(spark, self._latest, committed(spark, self._latest), self._latest)
        return rows.select(F.col("b").cast("long").alias("batch"), "late", "rows")


@dataclass
class CheckedRows:
    """Parts rows that have all required columns from those that lack one, and reports what is missing.

    The split, the report and the writing are one pass over a batch, or over a whole table.
    """

    path: str
    required: list[str]
    quarantine: str = field(default="quarantined", init=False)

    def write(self, batch: DataFrame, number: int = 0) -> None:
        missing = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing_{i}") for i, c in enumerate(self.required)]
        outcome = F.when(any_missing(self.required), self.quarantine).otherwise("accepted")
        counted = _sorted_out(batch, outcome, f"{self.path}/rows", number, [F.count("*").alias("total"), *missing])
        rows = [(c, counted[f"missing_{i}"] or 0, counted["total"] or 0) for i, c in enumerate(self.required)]
        report = batch.sparkSession.createDataFrame(rows, "column_name string, missing long, total long")
        write_numbered(report.coalesce(1), f"{self.path}/report", number)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return _with_outcome(spark, f"{self.path}/rows", "accepted")

    def quarantined(self, spark: SparkSession) -> DataFrame:
        return _with_outcome(spark, f"{self.path}/rows", self.quarantine)

    def report(self, spark: SparkSession) -> DataFrame:
        """Missing values per required column over all batches, as ``required_report`` gives them."""
        path = f"{self.path}/report"
        rows = read_numbered(spark, path, committed(spark, path))
        return rows.groupBy("column_name").agg(F.sum("missing").alias("missing"), F.sum("total").alias("total"))
