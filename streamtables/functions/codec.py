"""Message encoding and decoding as column expressions over the whole stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# JSON text uses SQL timestamps with milliseconds and writes null fields.
_JSON_WRITE = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSS", "ignoreNullFields": "false"}


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def json_value(column: Column | str, schema: T.StructType) -> Column:
    """JSON message value as a struct: missing fields become null, malformed text is an error."""
    return F.from_json(_text(column), schema, {"mode": "FAILFAST"})


def json_key(column: Column | str, schema: T.StructType) -> Column:
    """JSON message key as a struct: parse errors become null fields."""
    return F.from_json(_text(column), schema, {"mode": "PERMISSIVE"})


def split_malformed(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Decode JSON values without failing: (decoded rows, malformed messages)."""
    wide = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    decoded = df.withColumn("_decoded", F.from_json(_text(column), wide, options))
    is_bad = F.col(f"_decoded.{CORRUPT}").isNotNull()
    good = decoded.filter(~is_bad | F.col("_decoded").isNull()).select(
        *[c for c in df.columns if c != column], *[F.col(f"_decoded.{n}").alias(n) for n in schema.names]
    )
    return good, decoded.filter(is_bad).drop("_decoded")


def _struct(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def to_json_value(columns: list[str]) -> Column:
    """All listed columns as one JSON text, null fields included."""
    return F.to_json(_struct(columns), _JSON_WRITE)


def to_json_key(key_fields: list[str]) -> Column:
    return F.to_json(_struct(key_fields), _JSON_WRITE)


def raw_key(column: Column | str = "key") -> Column:
    """Message key as text."""
    return _text(column)


def split_raw_key(df: DataFrame, key: str, value_name: str = "value") -> DataFrame:
    """One raw key column as text, the remaining columns packed into the value struct."""
    rest = [c for c in df.columns if c != key]
    return df.select(_text(key).alias(key), _struct(rest).alias(value_name))


def avro_value(column: Column | str, record: str, confluent: bool = False) -> Column:
    """Avro message value as a struct, by Spark's own codec (needs the spark-avro package).

    Registry-framed messages carry a marker byte and a four-byte schema number in front.
    """
    from pyspark.sql.avro.functions import from_avro

    column = F.col(column) if isinstance(column, str) else column
    body = F.substring(column, F.lit(6), F.length(column)) if confluent else column
    return from_avro(body, record, {"mode": "FAILFAST"})


def to_avro_value(columns: list[str], record: str) -> Column:
    from pyspark.sql.avro.functions import to_avro

    return to_avro(_struct(columns), record)
