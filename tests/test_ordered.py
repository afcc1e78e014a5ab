"""Slotted and plain forms against brute force, with one key holding most rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streamtables.operators import frames, joins, sets, versions, windows
from streamtables.operators.ordered import SLOT, Carry, Slot, carry_over, cut, settle, slots_of_time, slots_of_values
from streamtables.operators.ranking import rank_rows, top_k

START = dt.datetime(2024, 1, 1)


def make_rows(n=400, seed=1):
    """(key, second, id, value): key 'hot' holds two thirds, one key is null."""
    rng = random.Random(seed)
    keys = ["hot"] * 8 + ["b", "c", "d", None]
    return [(rng.choice(keys), rng.randrange(5000), i, rng.randrange(100)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "k string, s int, id int, v int")
    return df.withColumn("t", (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s")))).cache()


def grouped(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    return groups



@pytest.fixture(scope="module")
def order(spark):
    return [F.col("s").asc(), F.col("id").asc()]


#: How a group is cut; None leaves it whole.
SLOTS = {
    "whole": lambda: None,
    "one": lambda: Slot(F.lit(0)),
    "some": lambda: Slot(F.floor(F.col("s") / 700)),
    "values": lambda: slots_of_values("s"),
    "times": lambda: slots_of_time("t", 60),
}


def test_building_a_plan_runs_nothing(spark, table, order):
    spark.sparkContext.setJobGroup("building", "")
    rank_rows(table, ["k"], order, "n", slots_of_values("s"))
    frames.running_sum(table, ["k"], order, F.col("v"), "total", slots_of_time("t"))
    windows.session_count(table, "t", 5, ["k"], "n")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")


def test_settle_keeps_rows_and_schema(table):
    kept = settle(table)
    assert kept.schema == table.schema and kept.exceptAll(table).count() == 0 and kept.count() == table.count()


@pytest.mark.parametrize("slot", SLOTS)
def test_rank(table, rows, order, slot):
    expected = {r[2]: i + 1 for g in grouped(rows).values() for i, r in enumerate(g)}
    got = {r.id: r.n for r in rank_rows(table, ["k"], order, "n", SLOTS[slot]()).collect()}
    assert got == expected


def test_rank_descending_slots(table, rows):
    slot = slots_of_values("v", falling=True)
    got = {r.id: r.n for r in rank_rows(table, ["k"], [F.col("v").desc(), F.col("id").asc()], "n", slot).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        groups[r[0]].append(r[2])
    assert got == {i: n + 1 for g in groups.values() for n, i in enumerate(g)}


@pytest.mark.parametrize("kind", ["one", "some", "values", "times"])
def test_carry_with_any_slots(table, rows, kind):
    slot = SLOTS[kind]()
    slotted = cut(table, slot)
    carries = [Carry("before", F.count("*"), "sum"), Carry("last_id", F.max("id"), "last")]
    slot_of = {r.id: r[SLOT] for r in slotted.collect()}
    for r in carry_over(slotted, ["k"], slot, carries).collect():
        earlier = [x for x in rows if x[0] == r.k and slot_of[x[2]] < r[SLOT]]
        assert (r.before or 0) == len(earlier)
        if earlier:
            last_slot = max(slot_of[x[2]] for x in earlier)
            assert r.last_id == max(x[2] for x in earlier if slot_of[x[2]] == last_slot)


@pytest.mark.parametrize("k", [1, 3, 1500])
def test_top_k(table, rows, order, k):
    expected = {r[2] for g in grouped(rows).values() for r in g[:k]}
    got = top_k(table, ["k"], order, k)
    assert {r.id for r in got.collect()} == expected


def test_top_k_prunes_before_the_shuffle(table, order):
    plan = top_k(table, ["k"], order, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") and "Partial" in plan


@pytest.mark.parametrize("slot", ["whole", "some", "times"])
@pytest.mark.parametrize("preceding,block", [(2, 3), (7, 4), (0, 5)])
def test_rows_frame(table, rows, order, slot, preceding, block):
    got = {r.id: (r.total, r.n) for r in frames.over_rows(
        table, ["k"], order, preceding, {"total": F.sum("v"), "n": F.count("*")}, SLOTS[slot](), block).collect()}
    for g in grouped(rows).values():
        for i, r in enumerate(g):
            window = [x[3] for x in g[max(0, i - preceding): i + 1]]
            assert got[r[2]] == (sum(window), len(window))
    assert len(got) == len(rows)


@pytest.mark.parametrize("seconds", [1, 50, 300, 9000])
def test_range_frame(table, rows, seconds):
    value = F.when(F.col("v") > 20, F.col("v"))
    aggregates = {"total": ("sum", "w"), "n": ("count", "w"), "low": ("min", "w"), "high": ("max", "w")}
    got = frames.over_range(table.withColumn("w", value), ["k"], "t", seconds, aggregates)
    assert got.columns == ["k", "s", "id", "v", "t", "w", "total", "n", "low", "high"]
    results = {r.id: (r.total, r.n, r.low, r.high) for r in got.collect()}
    assert len(results) == len(rows)
    for r in rows:
        frame = [x[3] for x in rows if x[0] == r[0] and r[1] - seconds <= x[1] <= r[1] and x[3] > 20]
        assert results[r[2]] == ((sum(frame), len(frame), min(frame), max(frame)) if frame else (None, 0, None, None))


@pytest.mark.parametrize("slot", SLOTS)
def test_running_sum_with_null_values(table, rows, order, slot):
    value = F.when(F.col("v") > 50, F.col("v"))
    got = {r.id: r.total for r in frames.running_sum(table, ["k"], order, value, "total", SLOTS[slot]()).collect()}
    for g in grouped(rows).values():
        seen = []
        for r in g:
            seen += [r[3]] if r[3] > 50 else []
            assert got[r[2]] == (sum(seen) if seen else None)


@pytest.mark.parametrize("gap", [5, 40])
def test_sessions_agree(table, rows, gap):
    expected = set()
    for key, g in grouped(rows).items():
        start, last, n = g[0][1], g[0][1], 0
        for r in g:
            if r[1] > last + gap:
                expected.add((key, start, last + gap, n))
                start, n = r[1], 0
            last, n = r[1], n + 1
        expected.add((key, start, last + gap, n))
    seconds = lambda t: int((t - START).total_seconds())
    for slot_seconds in (3, 60, 86_400):
        got = windows.session_count(table, "t", gap, ["k"], "n", slot_seconds).collect()
        assert {(r.k, seconds(r.window_start), seconds(r.window_end), r.n) for r in got} == expected


@pytest.mark.parametrize("slot_seconds", [1, 60, 86_400])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_as_of(spark, table, rows, slot_seconds, how):
    facts = [r for r in rows if r[2] % 3]
    marks = [r for r in rows if not r[2] % 3]
    at = lambda s: START + dt.timedelta(seconds=s)
    got = versions.as_of_join(
        spark.createDataFrame([(r[0], at(r[1]), *r) for r in facts], "k string, at timestamp_ntz, _k string, s int, id int, v int").drop("_k"),
        spark.createDataFrame([(r[0], at(r[1]), *r[1:]) for r in marks], "k string, since_at timestamp_ntz, since int, mark int, mv int"),
        ["k"], "at", "since_at", ["id"], ["mark"], how, slot_seconds,
    ).drop("at", "since_at")
    expected = set()
    for f in facts:
        valid = [(m[1], m[2], m[3]) for m in marks if m[0] is not None and m[0] == f[0] and m[1] <= f[1]]
        if valid or how == "left":
            best = max(valid) if valid else (None, None, None)
            expected.add((f[0], f[1], f[2], f[3], *best))
    assert {tuple(r) for r in got.collect()} == expected


def test_keep_first_and_last(table, rows):
    first = {r.k: r.id for r in versions.keep_first(table, ["k"], ["s", "id"]).collect()}
    last = {r.k: r.id for r in versions.keep_last(table, ["k"], ["s", "id"]).collect()}
    assert first == {k: g[0][2] for k, g in grouped(rows).items()}
    assert last == {k: g[-1][2] for k, g in grouped(rows).items()}


def test_latest_image(spark):
    changes = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("b", 4, None)], "k string, n int, v int")
    image = versions.latest_image(changes, ["k"], ["n"], F.col("v").isNull())
    assert [(r.k, r.v) for r in image.collect()] == [("a", 2)]


@pytest.mark.parametrize("salt", [1, 4])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_enrich(table, rows, spark, salt, how):
    songs = spark.createDataFrame([("hot", 1), ("hot", 2), ("b", 3), (None, 4)], "song string, sid int")
    got = joins.enrich(table.select("k", "id"), songs, "k", "song", how, salt)
    matches = {"hot": [("hot", 1), ("hot", 2)], "b": [("b", 3)]}
    expected = []
    for r in rows:
        hits = matches.get(r[0], [])
        if how in ("inner", "left"):
            expected += [(r[0], r[2], *h) for h in hits] or ([(r[0], r[2], None, None)] if how == "left" else [])
        elif bool(hits) == (how == "left_semi"):
            expected.append((r[0], r[2]))
    columns = ["k", "id", "song", "sid"] if how in ("inner", "left") else ["k", "id"]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_salting_refuses_outer_dimension(table, spark):
    songs = spark.createDataFrame([("hot",)], "song string")
    with pytest.raises(ValueError):
        joins.enrich(table, songs, "k", "song", "full", salt=2)


def test_interval_join(spark, rows):
    left = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows[:200]], "lk string, ls int, lid int")
    right = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows[200:]], "rk string, rs int, rid int")
    at = lambda c: F.timestamp_seconds(F.col(c))
    got = joins.interval_join(left.withColumn("lt", at("ls")), right.withColumn("rt", at("rs")), "lk", "rk", "lt", "rt", 60)
    expected = {(a[2], b[2]) for a in rows[:200] for b in rows[200:] if a[0] and a[0] == b[0] and a[1] <= b[1] <= a[1] + 60}
    pairs = [(r.lid, r.rid) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


@pytest.mark.parametrize("size,slide", [(120, 30), (60, 60)])
def test_hop(table, rows, size, slide):
    expected = defaultdict(int)
    for r in rows:
        for i in range(size // slide):
            expected[(r[0], r[1] // slide * slide - i * slide)] += 1
    got = windows.hop_count(table, "t", size, slide, ["k"], "n").collect()
    assert {(r.k, int((r.window_start - START).total_seconds())): r.n for r in got} == dict(expected)
    assert all((r.window_end - r.window_start).total_seconds() == size for r in got)
    with pytest.raises(ValueError):
        windows.hop_count(table, "t", 100, 30, ["k"])


def test_cumulate(table, rows):
    expected = defaultdict(int)
    for r in rows:
        outer = r[1] // 120 * 120
        for end in range(outer + 30, outer + 121, 30):
            if r[1] < end:
                expected[(r[0], outer, end)] += 1
    got = windows.cumulate_count(table, "t", 120, 30, ["k"], "n").collect()
    seconds = lambda t: int((t - START).total_seconds())
    assert {(r.k, seconds(r.window_start), seconds(r.window_end)): r.n for r in got} == dict(expected)


def test_sets(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    right = spark.createDataFrame([(1, None), (3, "y")], "c int, d string")
    rows_of = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert rows_of(sets.union_all(left, right)) == sorted(map(repr, [(1, None)] * 3 + [(2, "x"), (3, "y")]))
    assert rows_of(sets.union_distinct(left, right)) == sorted(map(repr, [(1, None), (2, "x"), (3, "y")]))
    assert rows_of(sets.intersect_distinct(left, right)) == [repr((1, None))]
    assert rows_of(sets.except_distinct(left, right)) == [repr((2, "x"))]


def test_approximate_distinct_per_window(table, rows):
    got = windows.tumble_aggregate(table, "t", "1 day", [], F.approx_count_distinct("id").alias("n")).first()
    assert abs(got.n - len(rows)) < 0.1 * len(rows)
    with pytest.raises(ValueError):
        windows.grouping_sets(table, "pivot", ["k"])


def test_song_listed_twice_counts_twice(spark):
    from streamtables.plans import charts

    plays = spark.sql("SELECT CAST(x AS BIGINT) AS song_id, 30L AS duration, TIMESTAMP '2024-01-01 00:00:01' AS event_time FROM VALUES (1), (1), (2) AS t(x)")
    songs = spark.sql("SELECT 1L AS id, 'a' AS name, 'g' AS genre, '' AS album, '' AS artist UNION ALL SELECT 1L, 'a', 'g', '', '' UNION ALL SELECT 2L, 'b', 'g', '', ''")
    one_plan = charts.chart_from_plays(plays, songs, 30, "60 seconds", 3)
    two_steps = charts.chart(charts.song_plays(plays, songs, 30), "60 seconds", 3)
    pick = lambda df: sorted((r.song_id, r.play_count) for r in df.collect())
    assert pick(one_plan) == pick(two_steps) == [(1, 4), (2, 1)]
    assert charts.long_plays(plays.withColumn("duration", F.lit(None).cast("long")), 30).count() == 0
