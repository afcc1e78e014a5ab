"""Operators of tables over closed time, over several batches, against their batch forms."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from streamtables.operators import frames, versions, windows
from streamtables.operators.ordered import slots_of_time
from streamtables.operators.ranking import top_k
from streamtables.session import run_dir
from streamtables.streaming.closed import ClosedRows
from streamtables.streaming.run import each_batch, finish
from tests.test_timed import AGGREGATES, BATCHES, DELAY, LAST, SCHEMA, T0, closed, facts, same, stored
from tests.test_timed import versions as versions_of


def replayed(spark, folder, target, batches=BATCHES, twice=None):
    """Pushes batches one at a time through one checkpoint; ``twice`` is written again, as after a failure."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).repartition(2).write.parquet(f"{folder}/in/part{n}")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
        finish(each_batch(source, target.write, f"{folder}/checkpoint"))
        if n == twice:
            target.write(spark.createDataFrame(batch, SCHEMA), n)
    return target.read(spark)


def over_range(rows):
    return frames.over_range(rows, ["k"], "at", 15, AGGREGATES)


def over_rows(rows):
    taken = {"total": F.sum("v"), "n": F.count("v"), "least": F.min("v"), "most": F.max("v")}
    return frames.over_rows(rows, ["k"], [F.col("at").asc(), F.col("id").asc()], 3, taken, slots_of_time("at", 7))


def last_three(rows):
    return top_k(rows, ["k"], [F.col("at").desc(), F.col("id").desc()], 3).drop("row_num")


def as_of(rows):
    return versions.as_of_join(facts(rows), versions_of(rows), ["k"], "at", "since", ["id"], ["version"], "left", 11)


def last_version(rows):
    return versions.keep_last(rows.filter("kind = 'v'"), ["k"], ["at", "id"])


@pytest.mark.parametrize(
    "operator, options",
    [(over_range, {"reach_seconds": 15}), (over_rows, {"carry": last_three}), (as_of, {"carry": last_version})],
)
def test_closed_time_equals_batch(spark, tmp_path, operator, options):
    target = ClosedRows(f"{tmp_path}/out", "at", DELAY, operator, F.col("at"), **options)
    ours = replayed(spark, tmp_path, target, twice=2)
    theirs = closed(operator(stored(spark).filter("at is not null")))
    assert theirs.count() > 50
    same(ours, theirs)


def test_windows_come_once_they_are_closed(spark, tmp_path):
    hop = lambda rows: windows.hop_count_distinct(rows, "at", 20, 5, ["k"], "id", "n")
    target = ClosedRows(f"{tmp_path}/out", "at", DELAY, hop, F.col("window_end"), reach_seconds=20)
    ours = replayed(spark, tmp_path, target, twice=1)
    theirs = closed(hop(stored(spark).filter("at is not null")), "window_end")
    assert theirs.count() > 50
    same(ours, theirs)


def test_the_slower_side_decides_and_late_rows_are_dropped(spark, tmp_path):
    row = lambda i, s, kind: (i, T0 + dt.timedelta(seconds=s), "k", kind, None)
    batches = [[row(1, 0, "f"), row(2, 500, "f")], [row(3, 100, "v")], [row(4, 40, "f"), row(5, 41, "f"), row(6, 300, "v")], []]
    sides = (F.col("kind") == "f", F.col("kind") == "v")
    target = ClosedRows(f"{tmp_path}/out", "at", DELAY, lambda rows: rows, F.col("at"), sides=sides)
    ids = []
    for n, batch in enumerate(batches):
        target.write(spark.createDataFrame(batch, SCHEMA), n)
        ids.append(sorted(r.id for r in target.read(spark).collect()))
    assert ids == [[], [1], [1, 3, 5], [1, 3, 5]]


def test_rows_behind_the_reach_are_removed(spark, tmp_path):
    target = ClosedRows(f"{tmp_path}/out", "at", DELAY, over_range, F.col("at"), reach_seconds=15)
    for n in range(8):
        rows = [(i, T0 + dt.timedelta(seconds=n * DELAY + i), "k", "f", None) for i in range(DELAY)]
        target.write(spark.createDataFrame(rows, SCHEMA), n)
    kept = [f for f in os.listdir(f"{tmp_path}/out/rows") if f.startswith("b=")]
    assert 2 <= len(kept) <= 4
    assert target.read(spark).count() == 7 * DELAY


@pytest.mark.parametrize("name", ["stream_over_range", "stream_over_rows", "stream_join_within", "stream_as_of_join", "stream_hop_distinct"])
def test_queries_hold_no_rows_in_python_state(spark, sf_dir, tmp_path, monkeypatch, name):
    """Rows one by one through Python took most of the time of these queries."""
    from workload import queries

    folders = []
    monkeypatch.setattr(queries, "run_dir", lambda spark, label: folders.append(run_dir(spark, label)) or folders[-1])
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    assert not any(os.path.exists(f"{f}/checkpoint/state") for f in folders)
