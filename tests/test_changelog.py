"""Row kinds, changing images, late rows and checks in passing, over several batches."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from streamtables.operators.checks import required_report
from streamtables.plans.pipeline import Pipeline, Query
from streamtables.sources.scan import Binding
from streamtables.sources.stream import Catalog, Stream, StreamError
from streamtables.streaming.changelog import ChangelogSink, fold, retracting_count, retracting_sum
from streamtables.streaming.files import committed, folder_names
from streamtables.streaming.run import BatchFolder, each_batch, finish
from streamtables.streaming.split import CheckedRows, LateRows
from streamtables.streaming.upsert import UpsertSink

T0 = dt.datetime(2024, 1, 1)
ROW = "k string, at int, v string, gone boolean"


def sink(path, **extra):
    return UpsertSink(str(path), ["k"], ["at"], F.col("gone"), compact_every=3, **extra)


def test_kinds_of_changes(spark, tmp_path):
    log = ChangelogSink(sink(tmp_path))
    batches = [
        [("a", 1, "x", False), ("b", 1, "x", False), ("c", 1, "x", True)],
        [("a", 2, "y", False), ("b", 2, "x", True), (None, 2, "n", False)],
        [("a", 2, "y", False), ("b", 3, "z", False), ("b", 2, "old", False)],
        [("b", 4, "z", True), ("b", 5, "w", False), ("c", 4, "x", True)],
    ]
    kinds = []
    for n, batch in enumerate(batches):
        log.write(spark.createDataFrame(batch, ROW), n)
        kinds.append(sorted((r.op, r.k, r.v) for r in spark.read.parquet(f"{log.path}/b={n}").collect()))
    assert kinds[0] == [("+I", "a", "x"), ("+I", "b", "x")]
    assert sorted(map(repr, kinds[1])) == sorted(map(repr, [("+I", None, "n"), ("+U", "a", "y"), ("-D", "b", "x"), ("-U", "a", "x")]))
    assert kinds[2] == [("+I", "b", "z")], "an equal row changes nothing"
    assert kinds[3] == [("+U", "b", "w"), ("-U", "b", "z")]


@pytest.mark.parametrize("by_order", [False, True])
def test_folding_gives_the_image_after_every_batch(spark, tmp_path, by_order):
    rng = random.Random(4)
    log = ChangelogSink(sink(tmp_path, by_order=by_order))
    for n in range(8):
        rows = [(f"k{rng.randrange(6)}", rng.randrange(30), rng.choice("xyz"), rng.random() < 0.3) for _ in range(5)]
        batch = spark.createDataFrame(list({(r[0], r[1]): r for r in rows}.values()), ROW)
        log.write(batch, n)
        if n in (3, 6):  # the batch is repeated after a failure
            log.write(batch, n)
        image, folded = log.sink.image(spark), fold(log.read(spark))
        assert sorted(map(repr, folded.collect())) == sorted(map(repr, image.select(*folded.columns).collect()))
        counts = {r.v: r.n for r in retracting_count(log.read(spark), ["v"], "n").collect() if r.n}
        assert counts == Counter(r.v for r in image.collect())
        sums = {r.v: (r.s, r.rows) for r in retracting_sum(log.read(spark), ["v"], F.col("at"), "s").collect() if r.rows}
        assert sums == {v: (sum(r.at for r in image.collect() if r.v == v), n) for v, n in counts.items()}


PLAYS = Stream.declare("p", sql="CREATE TABLE P (`id` BIGINT, `song` STRING)")
SONGS = Stream.declare(
    "s",
    sql="CREATE TABLE S (`song` STRING NOT NULL, `name` STRING)",
    primary_key=["song"],
    options={"ddl.connector": "upsert-kafka", "ddl.value.format": "json"},
)
NAMED = Stream.declare("n", sql="CREATE TABLE N (`id` BIGINT, `name` STRING)")
JOIN = "INSERT INTO [[STREAM:n]] SELECT p.id, s.name FROM [[STREAM:p]] p JOIN [[STREAM:s]] s ON p.song = s.song"


def joined(folder, sql=JOIN):
    bindings = {"p": Binding(path=f"{folder}/in/*"), "s": Binding(path=f"{folder}/songs"), "n": Binding(path=f"{folder}/out")}
    return Pipeline(Catalog(PLAYS, SONGS, NAMED), [Query(sql)], bindings=bindings, static={"s"})


def test_live_join_reads_the_image_of_its_time(spark, tmp_path):
    songs = UpsertSink(f"{tmp_path}/songs", ["song"], [], compact_every=2)
    name = lambda n, text: songs.write(spark.createDataFrame([("a", text), ("b", "other")], "song string, name string"), n)
    pipeline = joined(tmp_path)
    for n, text in enumerate(["old", "new", "newer"]):
        name(n, text)
        spark.createDataFrame([(n, "a"), (n + 10, "b"), (n + 20, "c")], "id long, song string").write.parquet(f"{tmp_path}/in/{n}")
        pipeline.replay(spark, f"{tmp_path}/checkpoints")
    # Many more batches of the image remove the folders that earlier joins read.
    for n in range(3, 40):
        name(n, f"name {n}")
    spark.createDataFrame([(3, "a")], "id long, song string").write.parquet(f"{tmp_path}/in/3")
    pipeline.replay(spark, f"{tmp_path}/checkpoints")
    rows = {r.id: r.name for r in BatchFolder(f"{tmp_path}/out").read(spark).collect()}
    assert rows == {0: "old", 1: "new", 2: "newer", 3: "name 39", 10: "other", 11: "other", 12: "other"}
    assert len(committed(spark, f"{tmp_path}/songs/snapshots")) < 8 and len(folder_names(spark, f"{tmp_path}/songs/pins/*")) <= 2


def test_a_repeated_batch_reads_its_pinned_image(spark, tmp_path):
    songs = UpsertSink(f"{tmp_path}/songs", ["song"], [], compact_every=2)
    for n in range(12):
        songs.write(spark.createDataFrame([("a", f"v{n}")], "song string, name string"), n)
        if n in (1, 3):
            assert songs.pinned_image(spark, "reader", n).first().name == f"v{n}"
    assert songs.pinned_image(spark, "reader", 3).first().name == "v3"
    assert songs.pinned_image(spark, "other", 0).first().name == "v11"
    assert songs.image(spark).first().name == "v11"


def test_a_join_with_an_image_cannot_aggregate(spark, tmp_path):
    sql = "INSERT INTO [[STREAM:n]] SELECT count(*), s.name FROM [[STREAM:p]] p JOIN [[STREAM:s]] s ON p.song = s.song GROUP BY s.name"
    with pytest.raises(StreamError, match="batch by batch"):
        joined(tmp_path, sql).replay(spark, f"{tmp_path}/checkpoints")


def push(spark, folder, batches, write, schema):
    """Each batch is one micro-batch of a stream."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).write.parquet(f"{folder}/in/{n}")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        finish(each_batch(source, write, f"{folder}/checkpoint"))


def test_late_rows_are_kept_apart(spark, tmp_path):
    rng = random.Random(2)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(100 * b + i, None if i == 7 else at(b * 30 + rng.randrange(-80, 30))) for i in range(20)] for b in range(5)]
    batches[2] = [(200, None)]  # a batch without any time
    target = LateRows(f"{tmp_path}/target", "at", 20)
    push(spark, tmp_path, batches, target.write, "id long, at timestamp")
    late, latest = set(), None
    for batch in batches:
        passed = None if latest is None else latest - dt.timedelta(seconds=20)
        late |= {i for i, t in batch if t and passed and t <= passed}
        latest = max([t for _, t in batch if t] + [latest] * (latest is not None))
    assert len(late) > 10
    found = {r.id for r in target.late(spark).collect()}
    on_time = [r.id for r in target.on_time(spark).collect()]
    assert found == late and sorted([*on_time, *found]) == sorted(i for b in batches for i, _ in b)
    counts = {r.batch: (r.late, r.rows) for r in target.counts(spark).collect()}
    assert sum(l for l, _ in counts.values()) == len(late) and counts[2] == (0, 1)


def test_rows_are_checked_in_passing(spark, tmp_path):
    schema = "a int, `b.c` string"
    batches = [[(1, "x"), (None, "y")], [(2, None)], [(None, None), (3, "z")]]
    target = CheckedRows(f"{tmp_path}/target", ["a", "b.c"])
    push(spark, tmp_path, batches, target.write, schema)
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(target.report(spark)) == key(required_report(rows, ["a", "b.c"]))
    assert key(target.accepted(spark)) == [(1, "x"), (3, "z")] and target.quarantined(spark).count() == 3
    table = CheckedRows(f"{tmp_path}/table", ["a"])
    table.write(rows)
    assert key(table.report(spark)) == [("a", 2, 5)]
