"""Time attributes and window columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proctime() -> Column:
    """Processing time: one value per batch query or micro-batch."""
    return F.current_timestamp()


def millis(column: Column | str) -> Column:
    """A timestamp cut to the millisecond precision of the message formats."""
    return F.date_trunc("MILLISECOND", column)


def time_slot(column: str, length_micros: int) -> Column:
    """Start of the slot of a time, in microseconds; slots have a fixed length."""
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    return micros - F.pmod(micros, F.lit(length_micros))


def with_watermark(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Declare event time on a stream. Batch tables pass through unchanged.

    Only TIMESTAMP columns can carry a watermark, so a zone-less one is cast first.
    """
    if not df.isStreaming:
        return df
    if dict(df.dtypes)[column] == "timestamp_ntz":
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay)


def flatten_window(df: DataFrame, window: str = "window") -> DataFrame:
    """Replace a window struct by ``window_start`` and ``window_end``."""
    rest = [c for c in df.columns if c != window]
    return df.select(
        F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end"), *rest
    )
