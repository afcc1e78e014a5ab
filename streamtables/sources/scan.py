"""Typed scans of declared streams, over tables at rest or live streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.functions import codec
from streamtables.functions.times import proctime, with_watermark
from streamtables.operators.versions import latest_image
from streamtables.sources.stream import OPTION_PREFIX, Stream, StreamError

#: Columns of a message as brokers deliver it.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Envelope names that Spark spells differently.
_ENVELOPE_NAMES = {"timestamp-type": "timestampType"}

# Start positions and the broker source option each stands for.
_START = {"earliest-offset": "earliest", "latest-offset": "latest"}

# Declared options that say what a stream is; all others go to its reader or writer.
_DESCRIBING = ("connector", "topic", "format", "path")
_DESCRIBING_PREFIXES = ("key.", "value.", "properties.", "scan.startup.")

#: Columns of a broker's sink that writable metadata may fill. Message files hold the whole envelope.
_WRITABLE = ("topic", "partition", "headers")


@dataclass
class Binding:
    """Where a stream is stored.

    ``layout`` is ``typed`` when the files hold the declared columns, or ``message`` when they
    hold key/value messages. ``columns`` maps a declared column to the stored column that
    carries it; ``schema`` is the stored schema when it cannot be derived from the declaration.
    """

    format: str = "parquet"
    path: str | None = None
    layout: str = "typed"
    columns: dict[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None
    options: dict[str, str] = field(default_factory=dict)


def declared_binding(stream: Stream) -> Binding:
    """Binding of a stream from its declared options.

    Broker connectors become the Kafka source; ``filesystem`` reads files; any other connector
    name is taken as a Spark format, which receives the declared options. Options that do not
    describe the stream itself are passed on as they are.
    """
    options = stream.resolved_options()
    connector = options["connector"]
    passed = {k: v for k, v in options.items() if k not in _DESCRIBING and not k.startswith(_DESCRIBING_PREFIXES)}
    if connector == "filesystem":
        if options.get("scan.startup.mode", "earliest-offset") != "earliest-offset":
            raise StreamError(f"stream {stream.name!r}: files are read from the earliest on")
        return Binding(format=options.get("format", "parquet"), path=options["path"], options=passed)
    if connector not in ("kafka", "upsert-kafka"):
        own = {k.removeprefix(OPTION_PREFIX): v for k, v in stream.options.items() if k.startswith(OPTION_PREFIX)}
        return Binding(format=connector, options={k: v for k, v in own.items() if k != "connector"})
    read = {"subscribe": options["topic"], **passed}
    for key, value in options.items():
        if key.startswith("properties."):
            read["kafka." + key.removeprefix("properties.")] = value
    mode = options.get("scan.startup.mode")
    if mode == "timestamp":
        read["startingTimestamp"] = options["scan.startup.timestamp-millis"]
    elif mode in _START:
        read["startingOffsets"] = _START[mode]
    elif mode:
        raise StreamError(f"unsupported start position {mode!r} for stream {stream.name!r}")
    return Binding(format="kafka", layout="message", options=read)


def _stored_schema(stream: Stream, binding: Binding) -> T.StructType:
    if binding.schema is not None:
        return binding.schema
    if binding.layout == "message":
        return ENVELOPE
    names = {m.name: m.source for m in stream.metadata.values()} | binding.columns
    return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in stream.schema.fields])


def read_stored(spark: SparkSession, stream: Stream, binding: Binding, streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format(binding.format).options(**binding.options)
    if binding.format != "kafka":
        reader = reader.schema(_stored_schema(stream, binding))
    return reader.load(binding.path) if binding.path else reader.load()


def read_channel(spark: SparkSession, binding: Binding, streaming: bool) -> DataFrame:
    """Messages of a stream that declares no columns."""
    reader = (spark.readStream if streaming else spark.read).format(binding.format).options(**binding.options)
    if binding.format != "kafka":
        reader = reader.schema(binding.schema or ENVELOPE)
    return reader.load(binding.path) if binding.path else reader.load()


def sink_options(binding: Binding) -> dict[str, str]:
    """Write options of a binding: a broker sink names its topic instead of subscribing to it.

    Of file options, those that only a reader understands are harmless to a writer.
    """
    if binding.format != "kafka":
        return dict(binding.options)
    write = {k: v for k, v in binding.options.items() if k.startswith("kafka.")}
    return write | {"topic": binding.options["subscribe"]}


def decode(stored: DataFrame, stream: Stream, key: Column | None = None) -> DataFrame:
    """Messages to declared columns, by the stream's key and value formats.

    ``key`` is an expression over the message that is added as ``_key``.
    """
    options = stream.resolved_options()
    value_format = options["value.format"].lower()
    raw_keys = stream.raw_key_columns
    outside_value = set(raw_keys)
    if options.get("value.fields-include") == "EXCEPT_KEY":
        outside_value |= set(stream.key_fields)
    fields = [f for f in stream.payload.fields if f.name not in outside_value]
    if value_format == "json":
        body = codec.json_value("value", T.StructType(fields))
    elif value_format in ("avro", "avro-confluent"):
        body = codec.avro_value("value", stream.avro_schema(), value_format == "avro-confluent")
    else:
        raise StreamError(f"unsupported value format {value_format!r}")
    decoded = stored.withColumn("_body", body)
    selected: list[Column] = []
    for f in stream.payload.fields:
        source = codec.raw_key() if f.name in outside_value else F.col(f"_body.`{f.name}`")
        selected.append(source.cast(f.dataType).alias(f.name))
    selected += [codec.raw_key().alias(k) for k in raw_keys]
    selected += [_envelope_column(m) for m in stream.metadata.values()]
    if key is not None:
        selected.append(key.alias("_key"))
    return decoded.select(*selected)


def _envelope_column(m) -> Column:
    return F.col(f"`{_ENVELOPE_NAMES.get(m.source, m.source)}`").cast(m.type).alias(m.name)


def conform(df: DataFrame, stream: Stream, columns: dict[str, str] | None = None) -> DataFrame:
    """Project and cast stored rows to the declared columns."""
    names = columns or {}
    selected = [F.col(f"`{names.get(f.name, f.name)}`").cast(f.dataType).alias(f.name) for f in stream.payload.fields]
    selected += [
        F.col(f"`{names.get(k, k)}`").cast("string").alias(k)
        for k in stream.raw_key_columns
        if names.get(k, k) in df.columns
    ]
    for m in stream.metadata.values():
        source = names.get(m.name) or (m.source if m.source in df.columns else m.name)
        selected.append(F.col(f"`{source}`").cast(m.type).alias(m.name))
    return df.select(*selected)


def with_time_attributes(df: DataFrame, stream: Stream) -> DataFrame:
    """Add processing-time columns and the declared watermark."""
    for column in stream.proctime_columns:
        df = df.withColumn(column, proctime())
    if stream.event_time:
        df = with_watermark(df, *stream.event_time)
    return df


def scan(
    spark: SparkSession,
    stream: Stream,
    binding: Binding | None = None,
    streaming: bool = False,
) -> DataFrame:
    """A declared stream as a DataFrame: decoded, conformed, with its time attributes."""
    binding = binding or declared_binding(stream)
    stored = read_stored(spark, stream, binding, streaming)
    typed = decode(stored, stream) if binding.layout == "message" else conform(stored, stream, binding.columns)
    return with_time_attributes(typed, stream)


def scan_image(spark: SparkSession, stream: Stream, binding: Binding) -> DataFrame:
    """Current image of an upsert stream stored as messages: the newest message per key counts,
    and one without a value removes its key.

    A changelog is ordered by its offsets; the messages of a key share a partition. Timestamps
    don't count, as producers set them.
    """
    stored = read_stored(spark, stream, binding, streaming=False)
    newest = latest_image(stored, ["key"], ["offset", "partition"], F.col("value").isNull())
    decoded = decode(newest, stream)
    if stream.raw_key_columns or stream.resolved_options().get("key.format") == "raw":
        return decoded
    # Key columns that the value leaves out come from the key.
    keys = T.StructType([stream.payload[k] for k in stream.key_fields])
    both = decode(newest, stream, codec.json_key("key", keys))
    filled = [
        F.coalesce(F.col(f"`{name}`"), F.col(f"_key.`{name}`")).alias(name) if name in stream.key_fields else F.col(f"`{name}`")
        for name in decoded.columns
    ]
    return both.select(*filled)


def encode(df: DataFrame, stream: Stream, deleted: str | None = None) -> DataFrame:
    """Declared columns to key/value messages. A deleted row keeps its key and loses its value.

    Writable metadata goes into the envelope: it becomes a column named as the envelope has it.
    """
    options = stream.resolved_options()
    value_format = options["value.format"].lower()
    columns = [c for c in stream.payload.names if c in df.columns]
    keys = stream.key_fields
    if options.get("value.fields-include") == "EXCEPT_KEY":
        columns = [c for c in columns if c not in keys]
    if value_format == "json":
        value = codec.to_json_value(columns)
    elif value_format == "avro":
        value = codec.to_avro_value(columns, stream.avro_schema())
    else:
        raise StreamError(f"cannot write value format {value_format!r}")
    if deleted:
        value = F.when(~F.col(deleted), value)
    if not keys:
        key = F.lit(None).cast("string")
    elif options.get("key.format") == "raw":
        key = F.col(keys[0]).cast("string") if keys[0] in df.columns else F.lit(None).cast("string")
    else:
        key = codec.to_json_key(keys)
    envelope = [
        F.col(f"`{m.name}`").cast(ENVELOPE[m.source].dataType if m.source in ENVELOPE.names else m.type).alias(m.source)
        for m in stream.metadata.values()
        if not m.readonly and m.name in df.columns
    ]
    return df.select(key.alias("key"), value.alias("value"), *envelope)


def as_stored(messages: DataFrame, topic: str, format: str) -> DataFrame:
    """Messages as a binding of that format stores them: for a broker, or as files of whole envelopes.

    The offset of a file's messages is the time of their batch, so later batches come later.
    """
    extra = [c for c in messages.columns if c not in ("key", "value")]
    if format == "kafka":
        if unwritable := [c for c in extra if c not in _WRITABLE]:
            raise StreamError(f"a broker's sink cannot write the metadata {unwritable}")
        return messages
    if unknown := [c for c in extra if c not in ENVELOPE.names]:
        raise StreamError(f"message files have no place for the metadata {unknown}")
    given = {
        "topic": F.lit(topic),
        "partition": F.lit(0),
        "offset": F.unix_micros(F.current_timestamp()),
        "timestamp": F.current_timestamp(),
    }
    filled = [F.coalesce(F.col(n), v).alias(n) if n in extra else v.alias(n) for n, v in given.items()]
    return messages.select(F.col("key").cast("binary"), F.col("value").cast("binary"), *filled)
