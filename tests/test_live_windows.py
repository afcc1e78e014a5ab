"""Sketches, grouping sets, running top-K, keep-last and parted statements over several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from streamtables.operators import windows
from streamtables.operators.ranking import top_k
from streamtables.plans.pipeline import Query
from streamtables.plans.references import split_ranking
from streamtables.streaming import operators as live_ops
from streamtables.streaming.changelog import fold
from streamtables.streaming.run import append_files, each_batch, finish
from streamtables.streaming.topk import RunningTopK
from streamtables.streaming.upsert import UpsertSink

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "at timestamp, k string, user long"


def rows_of(batch, n=400, users=3000):
    rng = random.Random(batch)
    return [(T0 + dt.timedelta(seconds=600 * batch + rng.randrange(600)), rng.choice(["a", "b", None]), rng.randrange(users)) for _ in range(n)]


BATCHES = [rows_of(b) for b in range(4)]


def replayed(spark, folder, build, batches=BATCHES):
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).write.parquet(f"{folder}/in/{n}")
        live = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*").withWatermark("at", "600 seconds")
        finish(append_files(build(live), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out")


def closed(rows):
    last = max(r[0] for b in BATCHES for r in b) - dt.timedelta(seconds=600)
    return rows.filter(F.col("window_end") <= F.lit(last))


def key(df):
    return sorted(map(repr, df.collect()))


def test_sketches_are_near_exact_counts_and_the_same_live(spark, tmp_path):
    rows = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    about = windows.hop_distinct(rows, "at", 600, 200, ["k"], "user", "n")
    window = F.window("at", "600 seconds", "200 seconds")
    exact = rows.groupBy(window.alias("w"), "k").agg(F.countDistinct("user").alias("exact"))
    both = about.join(exact.select(F.col("w.start").alias("window_start"), F.col("k").alias("k2"), "exact"), "window_start")
    both = both.filter(F.col("k").eqNullSafe(F.col("k2"))).collect()
    assert len(both) == exact.count()
    errors = [abs(r.n - r.exact) / r.exact for r in both]
    assert max(errors) < 0.06 and sum(errors) / len(errors) < 0.02, errors
    live = replayed(spark, tmp_path, lambda s: windows.hop_distinct(s, "at", 600, 200, ["k"], "user", "n"))
    assert key(live) == key(closed(about)) and live.count() > 10


def test_large_sketches_stay_within_their_error(spark):
    rows = spark.range(200_000).select((F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 3600)).alias("at"), F.lit("x").alias("k"), (F.col("id") % 50_000).alias("user"))
    for r in windows.cumulate_distinct(rows, "at", 3600, 900, ["k"], "user", "n").collect():
        exact = rows.filter((F.col("at") >= r.window_start) & (F.col("at") < r.window_end)).select("user").distinct().count()
        assert abs(r.n - exact) / exact < 4 * 0.0163


def test_grouping_sets_live_equal_batch(spark, tmp_path):
    sets = [["k", "odd"], ["odd"], ["k"], []]
    count = [F.count("*").alias("n"), F.max("user").alias("most")]
    build = lambda df: windows.window_sets(df.withColumn("odd", F.col("user") % 2), "at", "300 seconds", ["k", "odd"], sets, *count)
    rows = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    batch = build(rows)
    assert key(replayed(spark, tmp_path, build)) == key(closed(batch))
    start = F.window("at", "300 seconds")["start"]
    daily = rows.withColumn("odd", F.col("user") % 2).withColumn("window_start", start)
    daily.createOrReplaceTempView("daily")
    sql = "SELECT window_start, k, odd, grouping(k) * 2 + grouping(odd) AS g, count(*) AS n, max(user) AS most FROM daily GROUP BY GROUPING SETS ((window_start, k, odd), (window_start, odd), (window_start, k), (window_start))"
    ours = batch.select("window_start", "k", "odd", F.col("grouping_id").alias("g"), "n", "most")
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, spark.sql(sql).collect()), key=repr)
    with pytest.raises(ValueError):
        windows.window_sets(rows, "at", "300 seconds", ["k"], [["k"], ["k"]], *count)


def test_running_top_k_after_every_batch(spark, tmp_path):
    rng = random.Random(5)
    order = [F.col("n").desc(), F.col("item").asc()]
    values = UpsertSink(f"{tmp_path}/values", ["item"], [], F.col("n") == 0, compact_every=3)
    chart = RunningTopK(values, f"{tmp_path}/chart", ["g"], order, 3)
    now = {}
    for number in range(7):
        # Values rise and fall, items go, come back and change their group; a group may vanish.
        changed = {f"i{rng.randrange(9)}": (rng.choice(["g", "h", None]), rng.randrange(6) if number < 6 else 0) for _ in range(4)}
        if number == 6:
            changed = {i: (g, 0) for i, (g, _) in now.items() if g == "h"} or changed
        now |= changed
        batch = spark.createDataFrame([(i, g, n) for i, (g, n) in changed.items()], "item string, g string, n long")
        chart.write(batch, number)
        if number == 3:
            chart.write(batch, number)
        rows = spark.createDataFrame([(i, g, n) for i, (g, n) in now.items() if n], "item string, g string, n long")
        expected = top_k(rows, ["g"], order, 3).select("g", "row_num", "item", "n")
        assert sorted(map(tuple, chart.read(spark).select("g", "row_num", "item", "n").collect()), key=repr) == sorted(
            map(tuple, expected.collect()), key=repr
        )
    folded = fold(chart.chart.read(spark).drop("_gone")).select("g", "row_num", "item", "n")
    assert sorted(map(tuple, folded.collect()), key=repr) == sorted(
        map(tuple, chart.read(spark).select("g", "row_num", "item", "n").collect()), key=repr
    )


def test_last_row_per_key_over_batches(spark, tmp_path):
    sink = UpsertSink(f"{tmp_path}/image", ["k"], [])
    batches = [[(T0, "a", 1), (T0, "b", 1)], [(T0 + dt.timedelta(1), "a", 2)], [(T0, "a", 3), (T0 + dt.timedelta(2), "b", 4)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).write.parquet(f"{tmp_path}/in/{n}")
        last = live_ops.last_seen(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), ["k"], ["at"])
        finish(each_batch(last, sink.write, f"{tmp_path}/checkpoint", mode="update"))
    assert {r.k: r.user for r in sink.image(spark).collect()} == {"a": 2, "b": 4}


RANKED = """SELECT window_start, name, n FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY window_start, genre ORDER BY n DESC) AS row_num
    FROM (SELECT window_start, window_end, name, genre, COUNT(*) AS n -- how many (per window
          FROM TABLE(TUMBLE(TABLE t, DESCRIPTOR(at), INTERVAL '60' SECONDS))
          WHERE name <> 'a (GROUP BY b' GROUP BY window_start, window_end, name, genre))
    WHERE genre <> ')' ) WHERE row_num <= 3"""


def test_a_ranking_over_window_counts_is_parted():
    counts, rest = split_ranking(RANKED)
    assert counts.startswith("SELECT window_start, window_end, name") and "GROUP BY window, window_start" in counts
    assert "ROW_NUMBER" in rest and "COUNT" not in rest and "FROM closed" in " ".join(rest.split())
    assert "'a (GROUP BY b'" in counts and "genre <> ')'" in rest
    assert split_ranking("SELECT a FROM t") is None
    assert split_ranking("SELECT *, ROW_NUMBER() OVER (ORDER BY a) FROM t") is None
    assert split_ranking("SELECT *, ROW_NUMBER() OVER (ORDER BY a) FROM (SELECT a FROM t GROUP BY a)") is None
    top = split_ranking("SELECT *, ROW_NUMBER() OVER (ORDER BY n) FROM (SELECT window_start, count(*) n FROM TABLE(TUMBLE(x)) GROUP BY window_start)")
    assert top[1] == "SELECT *, ROW_NUMBER() OVER (ORDER BY n) FROM closed"
    query = Query(f"INSERT INTO [[STREAM:x]] {RANKED}").for_live()
    assert query.live_sql.startswith("INSERT INTO [[STREAM:x]] SELECT window_start") and query.closed == rest
    by_hand = Query(f"INSERT INTO [[STREAM:x]] {RANKED}", closed="SELECT 1")
    assert by_hand.for_live() is by_hand


def users_by_window(rows, spans):
    """Sets of users (null is none) of every window (start, end) that has a row, by brute force."""
    found = {}
    for at, k, user in rows:
        for span in spans(at):
            found.setdefault((*span, k), set()).update(set() if user is None else {user})
    return sorted(repr((*span, len(users))) for span, users in found.items())


#: More users than a sketch holds one by one, some of them missing, one group without any.
MANY = [[(at, k, None if u % 40 == 0 else u * 1000 + n) for at, k, u in rows_of(b, 1500) for n in range(2)] for b in range(4)]
MANY[1] += [(T0 + dt.timedelta(seconds=700), "nobody", None)]


def hops(at):
    first = T0 + dt.timedelta(seconds=(at - T0).total_seconds() // 200 * 200)
    starts = [first - dt.timedelta(seconds=200 * i) for i in range(3)]
    return [(s, s + dt.timedelta(seconds=600)) for s in starts]


def steps(at):
    start = T0 + dt.timedelta(seconds=(at - T0).total_seconds() // 600 * 600)
    ends = [start + dt.timedelta(seconds=200 * i) for i in range(1, 4)]
    return [(start, e) for e in ends if e > at]


def test_distinct_counts_of_cumulating_windows_are_exact(spark):
    rows = [r for b in MANY for r in b]
    ours = windows.cumulate_count_distinct(spark.createDataFrame(rows, SCHEMA).repartition(5), "at", 600, 200, ["k"], "user", "n")
    assert sorted(repr(tuple(r)) for r in ours.collect()) == users_by_window(rows, steps)


def test_distinct_counts_of_hopping_windows_are_exact(spark):
    rows = [r for b in MANY for r in b]
    ours = windows.hop_count_distinct(spark.createDataFrame(rows, SCHEMA).repartition(5), "at", 600, 200, ["k"], "user", "n")
    assert sorted(repr(tuple(r)) for r in ours.collect()) == users_by_window(rows, hops)


def test_live_distinct_counts_of_hopping_windows_are_exact(spark, tmp_path):
    rows = [r for b in MANY for r in b]
    live = replayed(spark, tmp_path, lambda s: windows.hop_count_distinct(s, "at", 600, 200, ["k"], "user", "n"), MANY)
    last = max(r[0] for r in rows) - dt.timedelta(seconds=600)
    passed = lambda at: [w for w in hops(at) if w[1] <= last]
    assert sorted(repr(tuple(r)) for r in live.collect()) == users_by_window(rows, passed) and live.count() > 20


@pytest.mark.parametrize("name", ["cumulate_distinct_users", "hop_distinct_users", "stream_hop_distinct"])
def test_distinct_users_of_a_large_table_match_the_sql(spark, sf_dir, tmp_path, name):
    """So many users a window that a sketch does not count them exactly."""
    from __spark_entry__ import oracle_sql, queries
    from tests.compare import connect, difference

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(300))))
    shifted = {c: F.col(c) + F.col("_copy") * F.lit(1_000_000).cast("long") for c in ("event_id", "user_id")}
    copies.withColumns(shifted).drop("_copy").write.parquet(f"{tmp_path}/events.parquet")
    connection = connect(sf_dir)
    connection.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert difference(queries()[name](spark, str(tmp_path)), connection, oracle_sql()[name]) is None
