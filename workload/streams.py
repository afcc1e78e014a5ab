"""The declared streams of the workload and where the given tables hold them.

Play events are the rows of ``events``, songs the rows of ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.sources.scan import Binding, scan
from streamtables.sources.stream import Catalog, Stream

# Columns, types, keys and watermarks of the four declared streams.

MIN_DURATION = 30.0
WINDOW = "1 day"
TOP = 3

#: How much a live scan takes into one micro-batch. A table's files are in no order of time, so up to this size
#: it is one batch; ``EventFeed`` brings the events in several.
LIVE_RATE = {"maxBytesPerTrigger": str(100 << 30)}

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"

SONGS = Stream.declare(
    "songs",
    table="Songs",
    fields=[
        {"name": "id", "type": "long"},
        {"name": "name", "type": "string"},
        {"name": "album", "type": "string", "optional": True},
        {"name": "artist", "type": "string", "optional": True},
        {"name": "genre", "type": "string"},
        {"name": "proctime", "type": "proctime"},
    ],
    options={"ddl.scan.startup.mode": "earliest-offset"},
)

PLAYS = Stream.declare(
    "plays",
    table="PlayEvents",
    fields=[
        {"name": "song_id", "type": "long"},
        {"name": "duration", "type": "double", "optional": True},
        {
            "name": "event_time",
            "type": "long_timestamp-millis",
            "metadata": {"from": "ts", "readonly": True},
            "watermark": "`event_time` - INTERVAL '30' SECONDS",
        },
    ],
    options={"ddl.scan.startup.mode": "earliest-offset"},
)

SONG_PLAYS = Stream.declare(
    "songplays",
    sql="""
        CREATE TABLE SongPlays (
            `song_id` BIGINT NOT NULL,
            `album` STRING,
            `artist` STRING,
            `name` STRING,
            `genre` STRING NOT NULL,
            `duration` DOUBLE,
            `event_time` TIMESTAMP(3) NOT NULL
        )""",
    time_attributes={"event_time": "`event_time` - INTERVAL '1' SECOND"},
    options={"ddl.key.fields": "song_id", "ddl.value.format": "json", "ddl.scan.startup.mode": "earliest-offset"},
)

TOP_SONGS = Stream.declare(
    "topsongs",
    avro={
        "type": "record",
        "name": "TopSongsPerGenre",
        "fields": [
            {"name": "window_start", "type": {"type": "long", "logicalType": "timestamp-millis"}},
            {"name": "window_end", "type": {"type": "long", "logicalType": "timestamp-millis"}},
            {"name": "song_id", "type": "long"},
            {"name": "name", "type": "string"},
            {"name": "genre", "type": "string"},
            {"name": "song_play_count", "type": ["null", "long"]},
        ],
    },
    primary_key=["window_start", "window_end", "song_id", "genre"],
    options={"ddl.connector": "upsert-kafka", "ddl.value.format": "json"},
)

CATALOG = Catalog(SONGS, PLAYS, SONG_PLAYS, TOP_SONGS)


def _ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def table_path(sf_dir: str, table: str) -> str:
    """Path pattern of a table, be it one file or a folder of files.

    A live file source watches patterns and folders, so the single-file case needs a pattern.
    """
    return f"{sf_dir}/{table}.parque[t]"


def plays_binding(sf_dir: str) -> Binding:
    return Binding(
        path=table_path(sf_dir, "events"),
        columns={"song_id": "user_id", "duration": "value"},
        schema=_ddl(EVENTS),
        options=dict(LIVE_RATE),
    )


def songs_binding(sf_dir: str) -> Binding:
    return Binding(
        path=table_path(sf_dir, "customer"),
        columns={
            "id": "c_custkey",
            "name": "c_name",
            "album": "c_nationkey",
            "artist": "c_mktsegment",
            "genre": "c_mktsegment",
        },
        schema=_ddl(CUSTOMER),
    )


def plays(spark: SparkSession, sf_dir: str, live: bool = False) -> DataFrame:
    return scan(spark, PLAYS, plays_binding(sf_dir), streaming=live)


def songs(spark: SparkSession, sf_dir: str, live: bool = False) -> DataFrame:
    return scan(spark, SONGS, songs_binding(sf_dir), streaming=live)


def events(spark: SparkSession, sf_dir: str, live: bool = False, delay: str = "30 seconds") -> DataFrame:
    """The events table as stored; a live scan declares ``ts`` as event time."""
    reader = (spark.readStream.options(**LIVE_RATE) if live else spark.read).schema(_ddl(EVENTS))
    df = reader.parquet(table_path(sf_dir, "events"))
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if live else df


#: Days of events in a slot of a feed; a feed's rows are out of order by less.
SLOT_DAYS = 8


class EventFeed:
    """The events as files that arrive in order of time, a folder for each slot of days.

    Inside a slot rows are in no order, so a watermark that is a slot behind leaves none of them late.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        self.spark, self.folder = spark, folder
        slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (SLOT_DAYS * 86_400))
        self.rows = events(spark, sf_dir).withColumn("_slot", slot)
        # One number per week or so, however many events there are.
        self.slots = sorted(r[0] for r in self.rows.select("_slot").distinct().collect())

    def push(self, slot: int) -> None:
        """The next files arrive."""
        self.rows.filter(F.col("_slot") == slot).drop("_slot").write.parquet(f"{self.folder}/slot{slot}")

    def push_all(self) -> None:
        for slot in self.slots:
            self.push(slot)

    def live(self, delay: str = f"{SLOT_DAYS} days") -> DataFrame:
        """A live scan that takes the files of a slot at a time."""
        files = max(1, self.rows.rdd.getNumPartitions())
        reader = self.spark.readStream.schema(_ddl(EVENTS)).option("maxFilesPerTrigger", files)
        rows = reader.parquet(f"{self.folder}/slot*")
        return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_ddl(CUSTOMER)).parquet(table_path(sf_dir, "customer"))


def conversations(spark: SparkSession, sf_dir: str, live: bool = False) -> DataFrame:
    reader = (spark.readStream.options(**LIVE_RATE) if live else spark.read).schema(_ddl(CONVERSATIONS))
    return reader.parquet(table_path(sf_dir, "conversations"))


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as zone-less values, the way the given tables store them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema.fields
        ]
    )
