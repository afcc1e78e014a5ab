import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.functions import codec
from streamtables.functions.messages import map_messages, message_function, register
from streamtables.operators.checks import duplicate_keys, required_report, split_required
from streamtables.sources.scan import Binding, conform, declared_binding, decode, encode, scan, sink_options
from streamtables.sources.stream import Stream, StreamError

SCHEMA = T.StructType().add("a", "long").add("b", "string")


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_json_value_missing_and_malformed(spark):
    rows = messages(spark, '{"a": 1}', '{"a": 2, "b": "x", "c": 0}')
    decoded = rows.select(codec.json_value("value", SCHEMA).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in decoded] == [(1, None), (2, "x")]
    with pytest.raises(Exception, match="MALFORMED"):
        messages(spark, "{bad").select(codec.json_value("value", SCHEMA)).collect()


def test_json_key_ignores_errors(spark):
    decoded = messages(spark, "{bad", '{"a": 3}').select(codec.json_key("value", SCHEMA).alias("k"))
    assert [r.a for r in decoded.select("k.a").collect()] == [None, 3]


def test_quarantine(spark):
    good, bad = codec.split_malformed(messages(spark, "{bad", '{"a": 3}', None), "value", SCHEMA)
    assert sorted((r.a or 0) for r in good.collect()) == [0, 3]
    assert [r.value for r in bad.collect()] == ["{bad"]


JSON = Stream.declare(
    "j",
    sql="CREATE TABLE J (`id` BIGINT NOT NULL, `name` STRING, `at` TIMESTAMP(3) NOT NULL)",
    options={"ddl.key.fields": "id", "ddl.value.format": "json"},
)


def test_json_encoding_keeps_all_columns(spark):
    rows = spark.sql("SELECT 7L AS id, CAST(NULL AS STRING) AS name, TIMESTAMP '2024-01-02 03:04:05.678' AS at")
    message = encode(rows, JSON).first()
    assert json.loads(message.key) == {"id": 7}
    assert json.loads(message.value) == {"id": 7, "name": None, "at": "2024-01-02 03:04:05.678"}


def test_deleted_row_has_key_only(spark):
    rows = spark.sql("SELECT 7L AS id, 'x' AS name, current_timestamp() AS at, true AS gone")
    message = encode(rows, JSON, "gone").first()
    assert json.loads(message.key) == {"id": 7} and message.value is None


def test_message_files_scan(spark, tmp_path):
    stamp = dt.datetime(2024, 1, 1)
    stream = Stream.declare(
        "m",
        sql="CREATE TABLE M (`id` BIGINT NOT NULL, `name` STRING)",
        metadata=[
            {"name": "event_time", "type": "long_timestamp-millis", "metadata": {"from": "timestamp", "readonly": True}},
            {"name": "offset", "type": "long", "metadata": {"from": "offset"}},
        ],
        time_attributes={"event_time": "`event_time` - INTERVAL '30' SECONDS", "p": ""},
        options={"ddl.value.format": "json", "ddl.key.fields": "id"},
    )
    schema = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
    row = (b'{"id": 5}', b'{"id": 5, "name": "n"}', "m", 0, 42, stamp)
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "m"))
    binding = Binding(path=str(tmp_path / "m"), layout="message")
    got = scan(spark, stream, binding)
    assert got.columns == ["id", "name", "event_time", "offset", "p"]
    first = got.first()
    assert (first.id, first.name, first.event_time, first.offset) == (5, "n", stamp, 42)
    assert first.p is not None
    live = scan(spark, stream, binding, streaming=True)
    assert live.isStreaming and "EventTimeWatermark" in live._jdf.queryExecution().analyzed().toString()


def test_raw_key_stays_out_of_value(spark):
    stream = Stream.declare("r", sql="CREATE TABLE R (`id` BIGINT NOT NULL)", protocol="kafka")
    assert stream.raw_key_columns == ["the_kafka_key"]
    keyed = codec.split_raw_key(spark.sql("SELECT 1 AS k, 2 AS a, 3 AS b"), "k")
    assert keyed.schema["k"].dataType == T.StringType()
    assert keyed.select("value.*").columns == ["a", "b"]


def test_broker_binding_and_passthrough():
    stream = Stream.declare(
        "songs",
        sql="CREATE TABLE S (`id` BIGINT)",
        options={"ddl.scan.startup.mode": "earliest-offset", "ddl.properties.group.id": "g"},
        servers={"brokers": "h:9092"},
    )
    binding = declared_binding(stream)
    assert binding.format == "kafka" and binding.layout == "message"
    assert binding.options == {
        "subscribe": "songs",
        "startingOffsets": "earliest",
        "kafka.group.id": "g",
        "kafka.bootstrap.servers": "h:9092",
    }
    assert sink_options(binding)["topic"] == "songs" and "subscribe" not in sink_options(binding)
    stream.options["ddl.scan.startup.mode"] = "group-offsets"
    with pytest.raises(StreamError):
        declared_binding(stream)


def test_unknown_value_format(spark):
    stream = Stream.declare("x", sql="CREATE TABLE X (`id` BIGINT)", options={"ddl.value.format": "csv"})
    with pytest.raises(StreamError):
        decode(messages(spark, "1"), stream)


def test_conform_casts_and_renames(spark):
    stream = Stream.declare("c", sql="CREATE TABLE C (`id` BIGINT, `v` DOUBLE)", options={"ddl.value.format": "json"})
    got = conform(spark.sql("SELECT 1 AS a, '2.5' AS v, 9 AS unused"), stream, {"id": "a"})
    assert got.dtypes == [("id", "bigint"), ("v", "double")]
    assert tuple(got.first()) == (1, 2.5)


def test_required_checks(spark):
    rows = spark.createDataFrame([(1, "p"), (2, None), (None, None)], "id bigint, genre string")
    accepted, quarantined = split_required(rows, ["id", "genre"])
    assert accepted.count() == 1 and quarantined.count() == 2
    report = {r.column_name: (r.missing, r.total) for r in required_report(rows, ["id", "genre"]).collect()}
    assert report == {"id": (1, 3), "genre": (2, 3)}
    assert split_required(rows, [])[0].count() == 3


def test_duplicate_keys(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int")
    assert [tuple(r) for r in duplicate_keys(rows, ["a", "b"]).collect()] == [(1, 1, 2)]


def test_message_functions(spark):
    @register("wrap")
    def wrap(params):
        return lambda texts: params["left"] + texts + params["right"]

    rows = messages(spark, "ab", None)
    got = map_messages(rows, "wrap", {"left": "<", "right": ">"})
    assert {r.value for r in got.collect()} == {"<ab>", None}
    assert {r.value for r in map_messages(rows, "uppercase").collect()} == {"AB", None}
    assert {r.value for r in map_messages(rows, "uppercase", prefer_builtin=False).collect()} == {"AB", None}
    assert map_messages(rows, "lowercase", prefer_builtin=False).filter(F.col("value") == "ab").count() == 1
    with pytest.raises(KeyError):
        message_function("nobody")


def test_other_connectors(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "n"))
    files = Stream.declare(
        "n",
        sql="CREATE TABLE N (`id` BIGINT)",
        options={"ddl.connector": "filesystem", "ddl.path": str(tmp_path / "n"), "ddl.format": "json"},
    )
    assert scan(spark, files).agg(F.sum("id")).first()[0] == 3
    ticks = Stream.declare("t", sql="CREATE TABLE T (`value` BIGINT)", options={"ddl.connector": "rate", "ddl.rowsPerSecond": "5"})
    assert declared_binding(ticks) == Binding(format="rate", options={"rowsPerSecond": "5"})
