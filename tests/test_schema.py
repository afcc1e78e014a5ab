import json

import pytest
from pyspark.sql import types as T

from streamtables.sources import schema as S
from streamtables.sources.stream import Catalog, Stream, StreamError, watermark_delay

PLAY_FIELDS = [
    {"name": "song_id", "type": "long"},
    {"name": "duration", "type": "long", "optional": True},
    {"name": "at", "type": "long_timestamp-millis"},
]
PLAY_SQL = "CREATE TABLE P (`song_id` BIGINT NOT NULL, `duration` BIGINT, `at` TIMESTAMP(3) NOT NULL)"
PLAY_AVRO = json.dumps(
    {
        "type": "record",
        "name": "P",
        "fields": [
            {"name": "song_id", "type": "long"},
            {"name": "duration", "type": ["null", "long"]},
            {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        ],
    }
)


def test_spellings_agree():
    fields = S.from_fields("P", PLAY_FIELDS).payload
    assert fields == S.from_sql(PLAY_SQL).payload == S.from_avro_record(PLAY_AVRO).payload
    assert fields["song_id"].nullable is False and fields["duration"].nullable is True


@pytest.mark.parametrize(
    "text,expected",
    [
        ("BOOLEAN", T.BooleanType()),
        ("TINYINT", T.IntegerType()),
        ("SMALLINT", T.IntegerType()),
        ("INTEGER", T.IntegerType()),
        ("BIGINT", T.LongType()),
        ("FLOAT", T.FloatType()),
        ("DOUBLE", T.DoubleType()),
        ("STRING", T.StringType()),
        ("CHAR", T.StringType()),
        ("VARCHAR(20)", T.StringType()),
        ("BINARY", T.BinaryType()),
        ("VARBINARY", T.BinaryType()),
        ("DATE", T.DateType()),
        ("TIMESTAMP", T.TimestampType()),
        ("TIMESTAMP(3)", T.TimestampType()),
        ("DECIMAL", T.DecimalType(10, 0)),
        ("DECIMAL(10,2)", T.DecimalType(10, 2)),
        ("NULL", T.NullType()),
        ("bigint", T.LongType()),
    ],
)
def test_sql_types(text, expected):
    columns = S.from_sql(f"CREATE TABLE t (a {text}, b STRING NOT NULL)")
    assert columns.payload["a"].dataType == expected
    assert columns.payload.names == ["a", "b"]


@pytest.mark.parametrize("text", ["ROW", "MULTISET", "MAP", "ARRAY", "RAW", "TIMESTAMP_WITH_LOCAL_TIME_ZONE"])
def test_sql_types_refused(text):
    with pytest.raises(ValueError):
        S.from_sql(f"CREATE TABLE t (a {text})")


def test_only_first_statement_counts():
    assert S.from_sql("CREATE TABLE a (x INT); CREATE TABLE b (y INT)").table == "a"
    with pytest.raises(ValueError):
        S.from_sql("SELECT 1; CREATE TABLE b (y INT)")


def test_sql_time_and_metadata_columns():
    columns = S.from_sql(
        """CREATE TABLE t (
            `id` BIGINT NOT NULL, `p` AS PROCTIME(), `at` TIMESTAMP(3) METADATA FROM 'timestamp' VIRTUAL,
            WATERMARK FOR `at` AS `at` - INTERVAL '30' SECONDS, `k` STRING)"""
    )
    assert columns.payload.names == ["id", "k"]
    assert columns.time_attributes == {"p": "", "at": "`at` - INTERVAL '30' SECONDS"}
    assert columns.metadata["at"].source == "timestamp" and columns.metadata["at"].readonly


@pytest.mark.parametrize(
    "name,expected",
    [
        ("boolean", T.BooleanType()),
        ("int", T.IntegerType()),
        ("long", T.LongType()),
        ("float", T.FloatType()),
        ("double", T.DoubleType()),
        ("bytes", T.BinaryType()),
        ("string", T.StringType()),
        ("int_date", T.DateType()),
        ("long_timestamp-millis", T.TimestampType()),
        ("bytes_decimal", T.DecimalType(10, 0)),
    ],
)
def test_field_types(name, expected):
    assert S.primitive(name) == expected


def test_unknown_field_type():
    with pytest.raises(ValueError):
        S.from_fields("t", [{"name": "a", "type": "array"}])


def test_nested_avro():
    record = {
        "type": "record",
        "name": "R",
        "fields": [
            {"name": "a", "type": {"type": "array", "items": ["null", "int"]}},
            {"name": "m", "type": {"type": "map", "values": "string"}},
            {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["x"]}},
            {"name": "f", "type": {"type": "fixed", "name": "F", "size": 4}},
            {"name": "n", "type": ["null", {"type": "record", "name": "N", "fields": [{"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}}]}]},
            {"name": "again", "type": "N"},
        ],
    }
    payload = S.from_avro_record(record).payload
    assert payload["a"].dataType == T.ArrayType(T.IntegerType(), True)
    assert payload["m"].dataType == T.MapType(T.StringType(), T.StringType(), False)
    assert payload["e"].dataType == T.StringType() and payload["f"].dataType == T.BinaryType()
    assert payload["n"].nullable and payload["again"].dataType == payload["n"].dataType
    assert payload["again"].dataType["d"].dataType == T.DecimalType(12, 2)
    with pytest.raises(ValueError):
        S.avro_type(["int", "string"], {})


def test_avro_round_trip():
    payload = S.from_avro_record(PLAY_AVRO).payload
    assert S.from_avro_record(S.to_avro_record("P", payload)).payload == payload


def test_field_level_time_and_metadata():
    stream = Stream.declare(
        "s",
        table="T",
        fields=[
            {"name": "id", "type": "long"},
            {"name": "p", "type": "proctime"},
            {
                "name": "at",
                "type": "long_timestamp-millis",
                "metadata": {"from": "timestamp", "readonly": True},
                "watermark": "`at` - INTERVAL '30' SECONDS",
            },
        ],
    )
    assert stream.payload.names == ["id"]
    assert stream.proctime_columns == ["p"]
    assert stream.event_time == ("at", "30 seconds")
    assert stream.writable_schema.names == ["id"]
    assert stream.schema.names == ["id", "the_kafka_key", "at"]
    assert stream.required_columns == ["id", "the_kafka_key", "at"]


def test_outer_declarations_win():
    stream = Stream.declare(
        "s",
        table="T",
        fields=[
            {"name": "at", "type": "long_timestamp-millis", "watermark": "`at` - INTERVAL '5' SECONDS"},
            {"name": "m", "type": "long", "metadata": {"from": "offset"}},
        ],
        metadata=[{"name": "m", "type": "int", "metadata": {"from": "partition", "readonly": True}}],
        time_attributes={"at": "`at` - INTERVAL '9' SECONDS"},
    )
    assert stream.event_time == ("at", "9 seconds")
    assert stream.metadata["m"].source == "partition" and stream.metadata["m"].type == T.IntegerType()


def test_watermark_needs_a_column():
    with pytest.raises(StreamError):
        Stream.declare("s", sql="CREATE TABLE t (a INT)", time_attributes={"at": "`at` - INTERVAL '1' SECOND"})


def test_empty_watermark_on_existing_column_is_ignored():
    stream = Stream.declare("s", sql="CREATE TABLE t (at TIMESTAMP(3))", time_attributes={"at": ""})
    assert stream.event_time is None and stream.proctime_columns == []


@pytest.mark.parametrize(
    "text,delay",
    [
        ("`c` - INTERVAL '30' SECONDS", "30 seconds"),
        ("c - interval '1' second", "1 seconds"),
        ("c - INTERVAL '2' MINUTE", "2 minutes"),
        ("c", "0 seconds"),
    ],
)
def test_watermark_text(text, delay):
    assert watermark_delay("c", text) == delay


@pytest.mark.parametrize("text", ["c + INTERVAL '1' SECOND", "d - INTERVAL '1' SECOND", "c - INTERVAL '1' YEAR", "f(c)"])
def test_watermark_text_refused(text):
    with pytest.raises(StreamError):
        watermark_delay("c", text)


def test_avro_options():
    stream = Stream.declare("topic1", sql=PLAY_SQL, options={"ddl.key.fields": "mine", "ddl.x.y": "z", "other": "1"}, servers={"brokers": "b:9092"})
    options = stream.resolved_options()
    assert options["value.format"] == "avro" and options["key.format"] == "raw"
    assert options["key.fields"] == "the_kafka_key", "inferred options replace user ones"
    assert options["value.fields-include"] == "EXCEPT_KEY"
    assert options["topic"] == "topic1" and options["connector"] == "kafka"
    assert options["properties.bootstrap.servers"] == "b:9092"
    assert options["x.y"] == "z" and "other" not in options


def test_registry_and_json_options():
    bound = Stream.declare("t", sql=PLAY_SQL, servers={"brokers": "b", "schemaRegistry": "http://r"})
    assert bound.resolved_options()["value.format"] == "avro-confluent"
    assert bound.resolved_options()["value.avro-confluent.url"] == "http://r"
    json_stream = Stream.declare("t", sql=PLAY_SQL, options={"ddl.value.format": "json", "ddl.key.fields": "song_id"})
    options = json_stream.resolved_options()
    assert options["key.format"] == "json" and options["value.fields-include"] == "ALL"
    assert options["key.json.ignore-parse-errors"] == "true"
    assert options["value.json.fail-on-missing-field"] == "false"
    assert json_stream.key_fields == ["song_id"] and json_stream.raw_key_columns == []


def test_catalog_errors():
    catalog = Catalog(Stream.declare("a", sql="CREATE TABLE A (x INT)"))
    with pytest.raises(StreamError, match="missing"):
        catalog.get("b")
    catalog.get("a").ready = False
    with pytest.raises(StreamError, match="not ready"):
        catalog.get("a")


def test_primary_key_must_exist():
    with pytest.raises(StreamError):
        Stream.declare("a", sql="CREATE TABLE A (x INT)", primary_key=["y"])
    with pytest.raises(StreamError):
        Stream.declare("a")


def test_inline_wins_and_registry_text():
    resource = {
        "metadata": {"name": "s"},
        "spec": {
            "protocol": "kafka",
            "dataSchemaContext": {
                "inline": {"type": "avro-confluent", "schema": "default"},
                "schema": {"name": "X", "namespace": "n", "fields": [{"name": "q", "type": "int"}]},
            },
        },
        "status": {"storageAddress": {"servers": {"one": {"variables": {"brokers": "h:1"}}}}},
    }
    with pytest.raises(StreamError):
        Stream.from_dict(resource)
    stream = Stream.from_dict(resource, PLAY_AVRO)
    assert stream.table == "P" and stream.servers == {"brokers": "h:1"}
    del resource["spec"]["dataSchemaContext"]["inline"]
    assert Stream.from_dict(resource).table == "X"


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext = FakeContext(master, folder)
        self.conf = {"spark.checkpoint.dir": conf} if conf else {}


def test_shared_folder_comes_from_the_session():
    from streamtables.session import shared_dir

    assert shared_dir(FakeSession("spark://m", conf="hdfs://x/ck/")) == "hdfs://x/ck"
    assert shared_dir(FakeSession("spark://m", folder="hdfs://x/set")) == "hdfs://x/set"
    with pytest.raises(ValueError):
        shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == local.sparkContext.folder == shared_dir(local)
