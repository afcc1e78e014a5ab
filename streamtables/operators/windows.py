"""Time-window aggregation: tumbling, hopping, cumulating and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from streamtables.functions.times import flatten_window
from streamtables.operators.ordered import DAY_SECONDS, SLOT, cut, in_order, slots_of_time


def tumble(df: DataFrame, time: str, size: str) -> DataFrame:
    """Add the tumbling window of each row: ``window``, ``window_start`` and ``window_end``.

    The ``window`` struct is what a stream must group by, as it carries the watermark.
    """
    return df.withColumn("window", F.window(time, size)).select(
        "*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")
    )


def hop(df: DataFrame, time: str, size: str, slide: str) -> DataFrame:
    """Add each hopping window a row falls into; a row repeats once per window."""
    return df.withColumn("window", F.window(time, size, slide)).select(
        "*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")
    )


def tumble_aggregate(df: DataFrame, time: str, size: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window and group, with flat window columns.

    Partial aggregation runs before the shuffle, so a hot group sends one row per map task.
    """
    return flatten_window(df.groupBy(F.window(time, size).alias("window"), *by).agg(*aggregates))


def tumble_count(df: DataFrame, time: str, size: str, by: list[str], name: str = "play_count") -> DataFrame:
    return tumble_aggregate(df, time, size, by, F.count("*").alias(name))


def _seconds(column: Column, seconds: int) -> Column:
    """``column`` moved by a number of seconds, keeping its type."""
    return column + F.expr(f"INTERVAL {seconds} SECONDS")


def hop_count(
    df: DataFrame, time: str, size_seconds: int, slide_seconds: int, by: list[str], name: str = "play_count"
) -> DataFrame:
    """COUNT(*) per hopping window and group.

    A batch counts each slide-long pane once and adds up the panes of a window, so raw rows are
    not multiplied by size / slide. A stream uses Spark's own sliding window.
    """
    if size_seconds % slide_seconds:
        raise ValueError("the window size must be a multiple of the slide")
    if df.isStreaming:
        window = F.window(time, f"{size_seconds} seconds", f"{slide_seconds} seconds").alias("window")
        return flatten_window(df.groupBy(window, *by).agg(F.count("*").alias(name)))
    panes = tumble_count(df, time, f"{slide_seconds} seconds", by, "_pane")
    starts = F.array(*[_seconds(F.col("window_start"), -slide_seconds * i) for i in range(size_seconds // slide_seconds)])
    windows = panes.withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", _seconds(F.col("window_start"), size_seconds)
    )
    return windows.groupBy("window_start", "window_end", *by).agg(F.sum("_pane").alias(name))


def cumulate_count(
    df: DataFrame, time: str, max_seconds: int, step_seconds: int, by: list[str], name: str = "play_count"
) -> DataFrame:
    """COUNT(*) per cumulating window: all windows share the start and grow by a step.

    Steps are counted once, then each step's count is added to the windows that contain it.
    """
    return _cumulated(df, time, max_seconds, step_seconds, by, F.count("*"), name)


def _cumulated(df: DataFrame, time: str, max_seconds: int, step_seconds: int, by: list[str], counted: Column, name: str) -> DataFrame:
    """A count per cumulating window and group, added up from the counts of the steps."""
    if max_seconds % step_seconds:
        raise ValueError("the maximum size must be a multiple of the step")
    steps = tumble_aggregate(df, time, f"{step_seconds} seconds", by, counted.alias("_step"))
    n = max_seconds // step_seconds
    outer = F.window("window_start", f"{max_seconds} seconds")
    position = ((F.col("window_end").cast("timestamp").cast("long") - F.col("_outer.start").cast("timestamp").cast("long")) / step_seconds).cast("int")
    grown = (
        steps.withColumn("_outer", outer)
        .withColumn("_length", F.explode(F.sequence(position, F.lit(n))))
        .withColumn("window_start", F.col("_outer.start"))
        .withColumn("window_end", F.col("_outer.start") + F.make_dt_interval(secs=F.col("_length") * F.lit(step_seconds)))
    )
    return grown.groupBy("window_start", "window_end", *by).agg(F.sum("_step").alias(name))


def session_count(
    df: DataFrame,
    time: str,
    gap_seconds: int,
    by: list[str],
    name: str = "play_count",
    slot_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """COUNT(*) per session: rows of a group no further apart than the gap.

    The end is the last row's time plus the gap. A batch cuts each group into slots of
    ``slot_seconds``, which are shuffled once, and finds the sessions of each slot. Only a slot's
    first and last session can go on in another one; these few are put together in order. A
    stream uses Spark's own session windows.
    """
    if df.isStreaming:
        sessions = df.groupBy(F.session_window(time, f"{gap_seconds} seconds").alias("window"), *by)
        return flatten_window(sessions.agg(F.count("*").alias(name)))
    order, slot = [F.col(time).asc()], slots_of_time(time, slot_seconds)
    keys = [*by, SLOT]
    dealt = cut(df.select(*by, time).filter(F.col(time).isNotNull()), slot).repartition(*keys)
    # Rows with one key and one time always share a session. All steps up to the sessions of a
    # slot keep the one partitioning.
    instants = dealt.groupBy(*keys, time).agg(F.count("*").alias("_rows"))
    marked = _starts(instants, time, time, gap_seconds, in_order(by, order, slotted=True))
    parts = marked.groupBy(*keys, "_start").agg(F.max(time).alias("_end"), F.sum("_rows").alias("_rows"))
    whole = Window.partitionBy(*keys)
    edge = (F.col("_start") == F.min("_start").over(whole)) | (F.col("_start") == F.max("_start").over(whole))
    parts = parts.withColumn("_edge", edge)
    edges = parts.filter("_edge").withColumnsRenamed({"_start": "_from"}).drop("_edge", SLOT)
    chained = _starts(edges, "_from", "_end", gap_seconds, in_order(by, [F.col("_from").asc()]))
    joined = chained.groupBy(*by, "_start").agg(F.max("_end").alias("_end"), F.sum("_rows").alias("_rows"))
    sessions = parts.filter("not _edge").select(*joined.columns).unionByName(joined)
    end = _seconds(F.col("_end"), gap_seconds).alias("window_end")
    return sessions.select(F.col("_start").alias("window_start"), end, *by, F.col("_rows").alias(name))


def _starts(rows: DataFrame, begin: str, end: str, gap_seconds: int, ordered: WindowSpec) -> DataFrame:
    """Add ``_start``: where the chain of rows begins that a row belongs to, none further than the gap from the next."""
    before = F.lag(end).over(ordered)
    opens = before.isNull() | (F.col(begin) > before + F.expr(f"INTERVAL {gap_seconds} SECONDS"))
    marked = rows.withColumn("_opens", F.when(opens, F.col(begin)))
    return marked.withColumn("_start", F.last("_opens", ignorenulls=True).over(ordered)).drop("_opens")


def grouping_sets(df: DataFrame, kind: str, by: list[str], *aggregates: Column) -> DataFrame:
    """ROLLUP or CUBE over ``by``."""
    if kind not in ("rollup", "cube"):
        raise ValueError("kind must be rollup or cube")
    return getattr(df, kind)(*by).agg(*aggregates)


def hop_count_distinct(
    df: DataFrame, time: str, size_seconds: int, slide_seconds: int, by: list[str], value: str, name: str
) -> DataFrame:
    """COUNT(DISTINCT value) per hopping window and group; works on a stream too.

    A batch makes values unique in each pane as long as the slide. A value counts where its pane
    opens windows that the value's pane before is not in, so it is sent on at most once a pane and
    counted in the map tasks. A stream, in which nothing can be looked up behind, makes values unique in
    each window and counts them by a second aggregation; state holds each value once a window.
    """
    if size_seconds % slide_seconds:
        raise ValueError("the window size must be a multiple of the slide")
    if df.isStreaming:
        window = F.window(time, f"{size_seconds} seconds", f"{slide_seconds} seconds").alias("window")
        unique = df.groupBy(window, *by, F.col(value).alias("_value")).agg(F.lit(1).alias("_one"))
        return flatten_window(unique.groupBy("window", *by).agg(F.count("_value").alias(name)))
    pane = F.window(time, f"{slide_seconds} seconds")["start"]
    panes = df.select(pane.alias("_pane"), *by, F.col(value).alias("_value")).distinct()
    before = F.lag("_pane").over(Window.partitionBy(*by, "_value").orderBy("_pane"))
    starts = F.array(*[_seconds(F.col("_pane"), -slide_seconds * i) for i in range(size_seconds // slide_seconds)])
    opened = panes.withColumn("_before", before).withColumn("_starts", starts)
    opened = opened.withColumn(
        "window_start", F.explode(F.filter("_starts", lambda s: F.col("_before").isNull() | (s > F.col("_before"))))
    )
    end = _seconds(F.col("window_start"), size_seconds).alias("window_end")
    return opened.groupBy("window_start", end, *by).agg(F.count("_value").alias(name))


def cumulate_count_distinct(
    df: DataFrame, time: str, max_seconds: int, step_seconds: int, by: list[str], value: str, name: str
) -> DataFrame:
    """COUNT(DISTINCT value) per cumulating window and group: a value counts from its first time in the longest window."""
    longest = F.window(time, f"{max_seconds} seconds").alias("_longest")
    first = df.groupBy(longest, *by, F.col(value).alias("_value")).agg(F.min(time).alias("_first"))
    return _cumulated(first, "_first", max_seconds, step_seconds, by, F.count("_value"), name)


#: Logarithm of the number of registers of a distinct sketch; the standard error is 1.04 / sqrt(2**12), 1.6 %.
SKETCH_BITS = 12


def distinct_panes(df: DataFrame, time: str, pane_seconds: int, by: list[str], value: str, bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of the distinct values of each pane and group (``window``, ``by``, ``sketch``).

    Sketches have a fixed size and unite into that of a longer window, so distinct values need
    not be kept, nor sent more than once. Values that are null don't count.
    """
    window = F.window(time, f"{pane_seconds} seconds").alias("window")
    return df.groupBy(window, *by).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def hop_distinct(
    df: DataFrame, time: str, size_seconds: int, slide_seconds: int, by: list[str], value: str, name: str, bits: int = SKETCH_BITS
) -> DataFrame:
    """About how many distinct values each hopping window and group has; works on a stream too.

    Each row is sketched once, in its pane as long as the slide; windows unite their panes.
    """
    if size_seconds % slide_seconds:
        raise ValueError("the window size must be a multiple of the slide")
    panes = distinct_panes(df, time, slide_seconds, by, value, bits)
    window = F.window(F.window_time("window"), f"{size_seconds} seconds", f"{slide_seconds} seconds").alias("_hop")
    united = panes.groupBy(window, *by).agg(F.hll_union_agg("sketch").alias("_sketch"))
    estimate = F.hll_sketch_estimate("_sketch").alias(name)
    return united.select(F.col("_hop.start").alias("window_start"), F.col("_hop.end").alias("window_end"), *by, estimate)


def cumulate_distinct(
    df: DataFrame, time: str, max_seconds: int, step_seconds: int, by: list[str], value: str, name: str, bits: int = SKETCH_BITS
) -> DataFrame:
    """About how many distinct values each cumulating window and group has, from sketches of its steps."""
    if max_seconds % step_seconds:
        raise ValueError("the maximum size must be a multiple of the step")
    steps = distinct_panes(df, time, step_seconds, by, value, bits)
    outer = F.window(F.col("window.start"), f"{max_seconds} seconds")
    passed = F.unix_seconds(F.col("window.end").cast("timestamp")) - F.unix_seconds(F.col("_outer.start").cast("timestamp"))
    lengths = F.sequence((passed / step_seconds).cast("int"), F.lit(max_seconds // step_seconds))
    grown = steps.withColumn("_outer", outer).withColumn("_length", F.explode(lengths))
    end = F.col("_outer.start") + F.make_dt_interval(secs=F.col("_length") * F.lit(step_seconds))
    placed = grown.select(F.col("_outer.start").alias("window_start"), end.alias("window_end"), *by, "sketch")
    united = placed.groupBy("window_start", "window_end", *by).agg(F.hll_union_agg("sketch").alias("_sketch"))
    return united.select("window_start", "window_end", *by, F.hll_sketch_estimate("_sketch").alias(name))


def window_sets(df: DataFrame, time: str, size: str, by: list[str], sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window for several sets of grouping columns at once; works on a stream too.

    ``by`` lists all grouping columns and each of ``sets`` some of them; columns outside a set are
    null in its rows. ``grouping_id`` tells sets apart, with a bit for each column that is outside,
    the first column's highest, as in SQL. Rows are multiplied by the sets before the
    aggregation, which combines them again in the map tasks.
    """
    ids = [sum(1 << i for i, c in enumerate(reversed(by)) if c not in s) for s in sets]
    if len(set(ids)) < len(ids) or any(c not in by for s in sets for c in s):
        raise ValueError("the sets must be different parts of the grouping columns")
    spread = df.withColumn("grouping_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    inside = {c: F.col("grouping_id").bitwiseAND(1 << i) == 0 for i, c in enumerate(reversed(by))}
    # The columns may be read by aggregates, so those to group by have names of their own.
    spread = spread.withColumns({f"_by_{c}": F.when(inside[c], F.col(c)) for c in by})
    window = F.window(time, size).alias("window")
    grouped = spread.groupBy(window, *[F.col(f"_by_{c}").alias(f"_by_{c}") for c in by], "grouping_id").agg(*aggregates)
    named = grouped.withColumnsRenamed({f"_by_{c}": c for c in by})
    return flatten_window(named)
