"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtables.session import run_dir

#: Characters that separate words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word, for regular expressions of the JVM.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null document id in joins and orders: nulls come first.
NULL_ID = -(2**63)


#: Rows that a Python worker gets at once. Texts have no bound, so a worker should hold few of them.
ROWS_AT_ONCE = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``ROWS_AT_ONCE`` if it has more."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= ROWS_AT_ONCE:
        spark.conf.set(_BATCH_ROWS, str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str = "doc_id") -> Column:
    """The document id as a number that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def boxed(columns: list[str]) -> Column:
    """A row's own columns in one, so that their names cannot clash with those of a computation."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")


def unboxed(columns: list[str]) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in columns]


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that it is computed once."""
    bound_batches(df.sparkSession)
    path = f"{run_dir(df.sparkSession, label)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; ``bytes.split`` separates at exactly the six characters of SPACES."""
    return text.encode().split() if text else []


def by_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict[str, object] | None]) -> DataFrame:
    """``mapInArrow`` with a function from a batch of rows to columns; one batch is held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = step(batch) if batch.num_rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
