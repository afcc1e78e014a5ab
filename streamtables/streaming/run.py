"""Starting and replaying streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from streamtables.streaming.files import committed, read_numbered, write_numbered

BatchWriter = Callable[[DataFrame, int], None]

#: As many rows of a batch as the console sink can print.
ALL_ROWS = 2**31 - 2


def _trigger(every: str | None) -> dict:
    """Trigger arguments: read what is there and stop, or run every interval."""
    return {"processingTime": every} if every else {"availableNow": True}


def append_files(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None, format: str = "parquet", **options: str
) -> StreamingQuery:
    """Append sink: rows are written exactly once as files (or to any other Spark sink)."""
    writer = df.writeStream.format(format).outputMode("append").options(**options)
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start(path)


def each_batch(
    df: DataFrame, write: BatchWriter, checkpoint: str, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Hand each micro-batch to ``write``, which must be repeatable for the same batch number."""
    writer = df.writeStream.foreachBatch(write).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a replay to end; its failure is raised here."""
    query.awaitTermination()
    return query


class BatchFolder:
    """Append target of ``foreachBatch``: one folder per batch, so a repeated batch replaces itself."""

    def __init__(self, path: str, transform: Callable[[DataFrame], DataFrame] | None = None, format: str = "parquet"):
        self.path, self.transform, self.format = path, transform, format

    def write(self, batch: DataFrame, number: int) -> None:
        write_numbered(self.transform(batch) if self.transform else batch, self.path, number, self.format)

    def read(self, spark: SparkSession) -> DataFrame:
        return read_numbered(spark, self.path, committed(spark, self.path))


def debug_rows(df: DataFrame, op: str = "+I") -> DataFrame:
    """A continuous SELECT as the debug sink prints it: with a row-kind column in front."""
    return df.select(F.lit(op).alias("op"), *df.columns)


def debug_console(df: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Print every row of a query with its row kind, as it arrives."""
    writer = debug_rows(df).writeStream.format("console").options(numRows=ALL_ROWS, truncate="false")
    return writer.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def insert_by_position(df: DataFrame, target: StructType) -> DataFrame:
    """Map query columns to target columns by position and cast them to the target types."""
    if len(df.columns) != len(target.fields):
        raise ValueError(f"query has {len(df.columns)} columns, target has {len(target.fields)}: {target.names}")
    renamed = df.toDF(*target.names)
    return renamed.select(*[_cast(renamed, f.name, f.dataType) for f in target.fields])


def _cast(df: DataFrame, name: str, dtype) -> Column:
    # A cast would hide the watermark of an event-time column that already has the right type.
    return df[name] if df.schema[name].dataType == dtype else df[name].cast(dtype).alias(name)


def progress_totals(query: StreamingQuery) -> dict[str, float]:
    """Rows read, rows dropped as late, state rows and input rate of a query."""
    reports = query.recentProgress
    operators = [op for p in reports for op in p["stateOperators"]]
    last = reports[-1]["stateOperators"] if reports else []
    return {
        "input_rows": sum(p["numInputRows"] for p in reports),
        "rows_dropped_by_watermark": sum(op["numRowsDroppedByWatermark"] for op in operators),
        "state_rows": sum(op["numRowsTotal"] for op in last),
        "processed_rows_per_second": max((p.get("processedRowsPerSecond") or 0.0 for p in reports), default=0.0),
    }
