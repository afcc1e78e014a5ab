"""Live behaviour over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from streamtables.functions.times import flatten_window, with_watermark
from streamtables.operators import joins, windows
from streamtables.operators.versions import keep_last
from streamtables.plans import charts
from streamtables.streaming import operators as live_ops
from streamtables.streaming import topk as live_topk
from streamtables.streaming.files import committed
from streamtables.streaming.run import (
    BatchFolder,
    append_files,
    debug_console,
    debug_rows,
    each_batch,
    finish,
    insert_by_position,
    progress_totals,
)
from streamtables.streaming.upsert import UpsertSink

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "at timestamp, k string, v int"


def at(clock):
    h, m, s = map(int, clock.split(":"))
    return T0 + dt.timedelta(hours=h, minutes=m, seconds=s)


class Feed:
    """A file stream fed one batch at a time through one checkpoint."""

    def __init__(self, spark, folder, build, schema=SCHEMA, mode="append", write=None):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.build, self.mode, self.write, self.n, self.queries = build, mode, write, 0, []

    def push(self, *rows):
        path = f"{self.folder}/in/part{self.n}"
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(path)
        self.n += 1
        source = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in/*")
        result, checkpoint = self.build(source), f"{self.folder}/checkpoint"
        if self.write:
            query = each_batch(result, self.write, checkpoint, mode=self.mode)
        else:
            query = append_files(result, f"{self.folder}/out", checkpoint)
        self.queries.append(finish(query))
        return self

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out").collect()

    def dropped(self):
        return sum(progress_totals(q)["rows_dropped_by_watermark"] for q in self.queries)


def minute_counts(source):
    return flatten_window(live_ops.count_closed(with_watermark(source, "at", "30 seconds"), "at", "60 seconds", ["k"], "n"))


def first_window(feed):
    return [r.n for r in feed.out() if r.window_start == T0]


def test_late_row_in_next_batch_counts(spark, tmp_path):
    feed = Feed(spark, tmp_path, minute_counts)
    # The watermark follows a batch, so each push ends with the windows it closed.
    feed.push((at("0:0:10"), "a", 1), (at("0:0:20"), "a", 1), (at("0:0:40"), "b", 1))
    assert first_window(feed) == [], "nothing closes before the delay has passed"
    feed.push((at("0:0:50"), "a", 1), (at("0:5:0"), "a", 1))
    assert sorted(first_window(feed)) == [1, 3]


def test_late_row_after_close_is_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, minute_counts)
    feed.push((at("0:0:10"), "a", 1), (at("0:5:0"), "a", 1))
    feed.push((at("0:0:20"), "a", 1))
    feed.push((at("1:0:0"), "a", 1))
    assert first_window(feed) == [1]
    assert feed.dropped() == 1


def test_last_window_stays_open(spark, tmp_path):
    feed = Feed(spark, tmp_path, minute_counts).push((at("0:0:10"), "a", 1), (at("0:1:29"), "a", 1))
    assert feed.out() == []
    feed.push((at("0:1:30"), "a", 1))
    assert [r.n for r in feed.out()] == [1]


def test_top_k_forms_agree_over_batches(spark, tmp_path):
    schema = "event_time timestamp, song_id bigint, name string, genre string"
    batches = [
        [(at("0:0:1"), 1, "x", "g")] * 5 + [(at("0:0:2"), 2, "y", "g")] * 4,
        [(at("0:0:3"), 4, "w", "g")] * 3 + [(at("0:0:4"), 3, "z", "g")] * 3 + [(at("0:0:5"), 9, "q", "h")],
        [(at("0:9:0"), 1, "x", "g")],
    ]
    counts = lambda s: live_ops.count_closed(with_watermark(s, "event_time", "1 second"), "event_time", "60 seconds", ["song_id", "name", "genre"])
    best = lambda: F.struct("play_count", (-F.col("song_id")).alias("i"))
    array = Feed(spark, tmp_path / "a", lambda s: live_topk.top_k_array(counts(s), ["genre"], best(), ["song_id", "name", "play_count"], 3), schema)
    folder = BatchFolder(str(tmp_path / "ranked"), live_topk.rank_closed(["genre"], charts.best_first(), 3))
    ranked = Feed(spark, tmp_path / "b", lambda s: flatten_window(counts(s)), schema, write=folder.write)
    for batch in batches:
        array.push(*batch)
        ranked.push(*batch)
    pick = lambda rows: {(r.genre, r.song_id, r.play_count) for r in rows}
    # Counts are 5, 4, 3, 3: the tie at rank three goes to the smaller song id.
    assert pick(array.out()) == pick(folder.read(spark).collect()) == {("g", 1, 5), ("g", 2, 4), ("g", 3, 3), ("h", 9, 1)}


def test_hop_and_session_close(spark, tmp_path):
    hop = Feed(spark, tmp_path / "h", lambda s: windows.hop_count(with_watermark(s, "at", "0 seconds"), "at", 60, 30, ["k"], "n"))
    session = Feed(spark, tmp_path / "s", lambda s: flatten_window(live_ops.session_closed(with_watermark(s, "at", "0 seconds"), "at", "20 seconds", ["k"], "n")))
    for feed in (hop, session):
        feed.push((at("0:0:10"), "a", 1), (at("0:0:25"), "a", 1)).push((at("0:0:40"), "a", 1)).push((at("0:5:0"), "a", 1))
    assert {(r.window_start, r.n) for r in hop.out()} == {
        (T0 - dt.timedelta(seconds=30), 2), (T0, 3), (at("0:0:30"), 1)}
    assert [(r.window_start, r.window_end, r.n) for r in session.out()] == [(at("0:0:10"), at("0:1:0"), 3)]


@pytest.mark.parametrize("two_steps", [False, True])
def test_dedup_across_batches(spark, tmp_path, two_steps):
    feed = Feed(spark, tmp_path, lambda s: live_ops.first_seen(with_watermark(s, "at", "1 hour"), ["k"], two_steps))
    feed.push((at("0:0:1"), "a", 1), (at("0:0:1"), "a", 1), (at("0:0:2"), "b", 1)).push((at("0:0:1"), "a", 1), (at("0:0:3"), "c", 1))
    assert sorted(r.k for r in feed.out()) == ["a", "b", "c"]


@pytest.mark.parametrize("salt", [1, 3])
def test_two_streams_join_without_time_bound(spark, tmp_path, salt):
    songs = str(tmp_path / "songs")
    spark.createDataFrame([("a", "x")], "id string, name string").write.parquet(f"{songs}/0")
    read_songs = lambda: spark.readStream.schema("id string, name string").parquet(f"{songs}/*")
    feed = Feed(spark, tmp_path, lambda s: joins.enrich(with_watermark(s, "at", "1 second"), read_songs(), "k", "id", salt=salt))
    feed.push((at("0:0:1"), "a", 1), (at("0:0:1"), "b", 1))
    # A song that arrives long after the play still finds it, and a replayed song matches again.
    spark.createDataFrame([("b", "y"), ("a", "x")], "id string, name string").write.parquet(f"{songs}/1")
    feed.push((at("5:0:0"), "a", 2))
    assert sorted((r.k, r.v, r.name) for r in feed.out()) == [
        ("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 2, "x"), ("b", 1, "y")]


def test_interval_join_live(spark, tmp_path):
    def build(s):
        marked = with_watermark(s, "at", "10 seconds")
        side = lambda v, p: marked.filter(F.col("v") == v).select(F.col("k").alias(p + "k"), F.col("at").alias(p + "at"))
        return joins.interval_join(side(1, "l"), side(2, "r"), "lk", "rk", "lat", "rat", 60)

    feed = Feed(spark, tmp_path, build)
    feed.push((at("0:0:10"), "a", 1)).push((at("0:1:10"), "a", 2), (at("0:1:11"), "a", 2)).push((at("0:0:5"), "a", 2))
    assert [(r.lat, r.rat) for r in feed.out()] == [(at("0:0:10"), at("0:1:10"))]


CHANGES = "k string, n int, v int"


def test_upsert_image(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), ["k"], ["n"], F.col("v").isNull())
    batch = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("b", 4, None)], CHANGES)
    with pytest.raises(ValueError):
        sink.image(spark)
    sink.write(batch, 0)
    image = lambda: {(r.k, r.v) for r in sink.image(spark).collect()}
    assert image() == {("a", 2)}
    sink.write(batch, 0)
    assert image() == {("a", 2)}, "a repeated batch changes nothing"
    sink.write(spark.createDataFrame([("b", 1, 9)], CHANGES), 1)
    assert image() == {("a", 2), ("b", 9)}, "the later batch wins"
    sink.write(spark.createDataFrame([("a", 0, None)], CHANGES), 2)
    assert image() == {("b", 9)}


def test_upsert_by_order_ignores_arrival(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), ["k"], ["n"], F.col("v").isNull(), by_order=True, compact_every=1)
    for number, row in enumerate([("a", 5, 5), ("b", 9, None), ("a", 3, 3), ("b", 2, 2)]):
        sink.write(spark.createDataFrame([row], CHANGES), number)
    assert {(r.k, r.v) for r in sink.image(spark).collect()} == {("a", 5)}


def test_compaction_keeps_the_image(spark, tmp_path):
    sink = UpsertSink(str(tmp_path), ["k"], ["n"], compact_every=2)
    expected = {}
    for number in range(7):
        rows = [(k, number, number * 10 + i) for i, k in enumerate("abc") if (number + i) % 2]
        sink.write(spark.createDataFrame(rows, CHANGES), number)
        expected |= {k: v for k, _, v in rows}
        assert {r.k: r.v for r in sink.image(spark).collect()} == expected
    # The last snapshot and the one before it stay; what they hold is removed.
    assert committed(spark, f"{tmp_path}/snapshots") == [4, 6]
    assert committed(spark, f"{tmp_path}/changes") == [5, 6]
    # A compacted batch that is run again leaves the image as it was.
    sink.write(spark.createDataFrame([("b", 6, 61)], CHANGES), 6)
    assert {r.k: r.v for r in sink.image(spark).collect()} == expected


def test_running_aggregate_updates_image(spark, tmp_path):
    sink = UpsertSink(str(tmp_path / "image"), ["k"], ["n"])
    feed = Feed(spark, tmp_path, lambda s: live_ops.running_aggregate(s, ["k"], F.count("*").alias("n")), mode="update", write=sink.write)
    feed.push((T0, "a", 1), (T0, "b", 1)).push((T0, "a", 1))
    assert {(r.k, r.n) for r in sink.image(spark).collect()} == {("a", 2), ("b", 1)}


def test_positional_insert(spark):
    rows = spark.sql("SELECT 1 AS a, '2' AS b")
    target = spark.sql("SELECT 1L AS x, 2 AS y").schema
    got = insert_by_position(rows, target)
    assert got.dtypes == [("x", "bigint"), ("y", "int")] and tuple(got.first()) == (1, 2)
    with pytest.raises(ValueError):
        insert_by_position(rows.select("a"), target)


def test_debug_console_prints_row_kind(spark, tmp_path):
    assert debug_rows(spark.range(1)).columns == ["op", "id"]
    spark.range(2).write.parquet(str(tmp_path / "in" / "0"))
    source = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in" / "*"))
    finish(debug_console(source, str(tmp_path / "c")))


def test_restart_continues_from_checkpoint(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: s.select("k"))
    feed.push((T0, "a", 1)).push((T0, "b", 1))
    assert sorted(r.k for r in feed.out()) == ["a", "b"]
    assert [progress_totals(q)["input_rows"] for q in feed.queries] == [1, 1]


def test_keep_last_is_a_plain_aggregate(spark):
    plan = keep_last(spark.createDataFrame([("a", 1, 1)], CHANGES), ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
