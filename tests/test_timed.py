"""Live operators in order of event time, over several batches, against their batch forms."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from streamtables.operators import frames
from streamtables.operators.versions import as_of_join
from streamtables.streaming import timed
from streamtables.streaming.run import append_files, finish

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp, k string, kind string, v decimal(10,2)"
DELAY = 60


def rows_of_time(seed, n, seconds, keys=3, first=0):
    """Rows at random times of a span, a few of one time, a few without key, value or time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=first + rng.randrange(seconds), milliseconds=rng.choice([0, 0, 250]))
        key = None if rng.random() < 0.05 else f"k{rng.randrange(keys)}"
        value = None if rng.random() < 0.1 else Decimal(rng.randrange(1000)) / 4
        rows.append((1000 * seed + i, None if rng.random() < 0.03 else at, key, rng.choice("fv"), value))
    return rows


#: Each batch is at most the delay behind the one before, so none of its rows is late.
BATCHES = [rows_of_time(b + 1, 70, DELAY, first=b * DELAY) for b in range(4)]
LAST = max(r[1] for b in BATCHES for r in b if r[1])


def closed(rows, column="at"):
    return rows.filter(F.col(column) <= F.lit(LAST - dt.timedelta(seconds=DELAY)))


class Steps:
    """Pushes batches one at a time through one checkpoint."""

    def __init__(self, spark, folder, build, batches=BATCHES):
        self.spark, self.folder, self.state = spark, str(folder), []
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).repartition(2).write.parquet(f"{self.folder}/in/part{n}")
            source = spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in/*").withWatermark("at", f"{DELAY} seconds")
            finish(append_files(build(source), f"{self.folder}/out", f"{self.folder}/checkpoint"))
            self.state.append(sum(self.held(name) for name in ("waiting", "carried")))

    def held(self, name):
        """Rows in a list state."""
        reader = self.spark.read.format("statestore").option("stateVarName", name)
        return reader.load(f"{self.folder}/checkpoint").count()

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")


def stored(spark, batches=BATCHES):
    return spark.createDataFrame([r for b in batches for r in b], SCHEMA)


def same(ours, theirs):
    assert ours.columns == theirs.columns
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))


def facts(rows):
    return rows.filter("kind = 'f'").select("id", "at", "k", "v")


def versions(rows):
    return rows.filter("kind = 'v'").select("k", F.col("at").alias("since"), F.col("id").alias("version"), F.col("v").alias("price"))


@pytest.mark.parametrize("how", ["left"])
def test_as_of_join_equals_batch(spark, tmp_path, how):
    join = lambda f, rows, **extra: f(facts(rows), versions(rows), ["k"], "at", "since", ["id"], ["version"], how, **extra)
    steps = Steps(spark, tmp_path, lambda s: join(timed.as_of_join_live, s, salt=2))
    theirs = closed(join(as_of_join, stored(spark).filter("at is not null")))
    assert theirs.count() > 50
    same(steps.out(), theirs)


def test_join_within_equals_batch_and_state_levels_off(spark, tmp_path):
    batches = [rows_of_time(b + 1, 40, DELAY, first=b * DELAY) for b in range(8)]
    steps = Steps(spark, tmp_path, lambda s: timed.join_within(facts(s), versions(s), ["k"], "at", "since", 20), batches)
    rows = stored(spark, batches)
    f, v = facts(rows), versions(rows).withColumnRenamed("k", "vk")
    apart = F.abs(F.unix_micros("at") - F.unix_micros("since"))
    theirs = f.join(v, (F.col("k") == F.col("vk")) & (apart <= 20_000_000)).select("k", "id", "at", "v", "since", "version", "price")
    last = max(r[1] for b in batches for r in b if r[1]) - dt.timedelta(seconds=DELAY)
    theirs = theirs.filter(F.greatest("at", "since") <= F.lit(last))
    assert theirs.count() > 100
    same(steps.out(), theirs)
    # Without a bound it would hold all 320 rows.
    assert max(steps.state) < 200 and max(steps.state[5:]) <= 1.3 * max(steps.state[2:5]), steps.state


def test_idle_keys_leave_state(spark, tmp_path):
    row = lambda i, s, k: (i, T0 + dt.timedelta(seconds=s), k, "f", Decimal(1))
    batches = [[row(i, i, f"idle{i}") for i in range(30)], [row(100, 500, "other")], [row(101, 900, "other")], [row(102, 1500, "other")]]
    steps = Steps(spark, tmp_path, lambda s: timed.join_within(facts(s), versions(s), ["k"], "at", "since", 20), batches)
    assert steps.state[0] >= 30 and steps.state[-1] < 10, steps.state


AGGREGATES = {"total": ("sum", "v"), "n": ("count", "v"), "least": ("min", "v"), "most": ("max", "v")}


def test_range_frames_equal_batch(spark, tmp_path):
    steps = Steps(spark, tmp_path, lambda s: timed.over_range_live(s, ["k"], "at", 15, AGGREGATES))
    rows = stored(spark).filter("at is not null")
    same(steps.out(), closed(frames.over_range(rows, ["k"], "at", 15, AGGREGATES)))


@pytest.mark.parametrize("preceding", [3])
def test_row_frames_equal_batch(spark, tmp_path, preceding):
    steps = Steps(spark, tmp_path, lambda s: timed.over_rows_live(s, ["k"], "at", ["id"], preceding, AGGREGATES))
    rows = stored(spark).filter("at is not null")
    taken = {"total": F.sum("v"), "n": F.count("v"), "least": F.min("v"), "most": F.max("v")}
    same(steps.out(), closed(frames.over_rows(rows, ["k"], [F.col("at").asc(), F.col("id").asc()], preceding, taken)))
