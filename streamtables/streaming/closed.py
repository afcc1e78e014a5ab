"""Operators of tables over the closed time of a stream, a batch at a time.

Rows are written once, in the batch that brings them. A batch reads back those that the watermark
passes with it and the earlier ones that their results can need, and hands them to an operator of
tables. No row goes through Python or waits in a state store, so the work of a batch is that of
one table of these rows, with its slots for large groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from streamtables.streaming.files import committed, read_numbered, remove, write_numbered

_MICROS = 1_000_000


def _micros(column: str | Column) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


@dataclass
class ClosedRows:
    """Writes the results of ``operator`` for the time that the watermark has passed; ``write`` is for ``foreachBatch``.

    As in Spark, the watermark before a batch is the latest ``time`` of the batches before it, less
    the delay, and only moves forward. Rows at or before it are late and dropped, and so are rows without a time.
    After the batch, all rows up to the new watermark are closed. ``operator`` gets the newly closed rows
    with the rows of the last ``reach_seconds`` before them, or with those that ``carry`` chose from
    the closed rows so far. Its results count if ``result_time`` lies in the newly closed time.

    ``sides`` are conditions that part the rows into streams; the slowest decides the watermark. A
    repeated batch replaces what it wrote. Rows that no batch can need any more are removed.
    """

    path: str
    time: str
    delay_seconds: float
    operator: Callable[[DataFrame], DataFrame]
    result_time: Column
    reach_seconds: float = 0
    carry: Callable[[DataFrame], DataFrame] | None = None
    sides: tuple[Column, ...] = ()

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows"

    @property
    def _times(self) -> str:
        return f"{self.path}/times"

    @property
    def _carried(self) -> str:
        return f"{self.path}/carried"

    @property
    def _results(self) -> str:
        return f"{self.path}/results"

    def _watermark(self, latest: list[int | None]) -> int | None:
        if any(x is None for x in latest):
            return None
        return min(latest) // 1000 * 1000 - int(self.delay_seconds * _MICROS)

    def write(self, batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, _micros(self.time)
        before = [n for n in committed(spark, self._times) if n < number]
        sides = self.sides or (F.lit(True),)
        known = list(read_numbered(spark, self._times, before[-1:]).first()["latest"]) if before else [None] * len(sides)
        passed = self._watermark(known)
        since = None if passed is None else passed - int(self.reach_seconds * _MICROS)

        seen = Observation()
        timed = batch.filter(F.col(self.time).isNotNull())
        counts = [F.max(F.when(side, at)).alias(f"side{i}") for i, side in enumerate(sides)]
        on_time = timed.observe(seen, F.max(at).alias("highest"), *counts)
        write_numbered(on_time if passed is None else on_time.filter(at > passed), self._rows, number)
        found = seen.get
        latest = [max((x for x in (k, found[f"side{i}"]) if x is not None), default=None) for i, k in enumerate(known)]
        now = self._watermark(latest)

        # A row of state for each batch that is not wholly behind the watermark.
        stored = [n for n in committed(spark, self._rows) if n < number]
        old = []
        if stored and since is not None:
            highest = read_numbered(spark, self._times, stored, self._times).select("b", "highest").collect()
            old = [r["b"] for r in highest if r["highest"] is None or r["highest"] <= since]
        rows = read_numbered(spark, self._rows, [n for n in stored if n not in old] + [number])
        rows = rows.filter(at <= F.lit(now)) if now is not None else rows.filter(F.lit(False))
        rows = rows.filter(at > since) if since is not None else rows
        if self.carry is not None:
            if before:
                rows = rows.unionByName(read_numbered(spark, self._carried, before[-1:]))
            write_numbered(self.carry(rows), self._carried, number)
        result, of = self.operator(rows), _micros(self.result_time)
        # A window may end in time that is not closed yet.
        result = result.filter(of <= now) if now is not None else result.filter(F.lit(False))
        write_numbered(result if passed is None else result.filter(of > passed), self._results, number)
        state = spark.createDataFrame([(latest, found["highest"])], "latest array<long>, highest long")
        write_numbered(state.coalesce(1), self._times, number)
        for n in old:
            remove(spark, f"{self._rows}/b={n}")
        for n in before[:-1] if self.carry is not None else []:
            remove(spark, f"{self._carried}/b={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The results of all batches."""
        return read_numbered(spark, self._results, committed(spark, self._results))
