"""Mixing sources to target weights: a min-cost flow over aggregated membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern; the flow
routes each pattern's tokens to the quotas of its sources, where every repetition of a
document costs more than the one before. Documents are then selected by a seeded hash: a
stretch of the flow becomes a range of hash values, so the selection is a filter.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtables.llm.common import WORD_PATTERN, boxed, id_key, settle, unboxed, whole_text

#: Patterns and sources that may be planned on the driver; more raise an error.
MAX_PATTERNS = 200_000
#: Parts of the hash range for which sizes are added up.
BUCKETS = 4096


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def repeating_weights(sources: Sequence[str | None], cycle: Sequence[float] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights dealt to the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def capped_targets(
    sizes: dict[str | None, int], weights: dict[str | None, float], repeats: int = 3
) -> dict[str | None, float]:
    """Shares of all sizes by weight; what exceeds ``repeats`` times a source is shared again."""
    total, open_, targets = float(sum(sizes.values())), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: total * weights[s] / weight if weight else 0.0 for s in open_}
        full = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not full:
            return targets | share
        for s in full:
            targets[s] = float(repeats * sizes[s])
            total -= targets[s]
        open_ -= full
    return targets


def min_cost_flow(
    capacity: dict[tuple, int], quotas: dict[str | None, int], repeats: int
) -> dict[tuple[tuple, int, str | None], int]:
    """Tokens by (pattern, repetition, source) that fill the quotas at the least cost.

    A pattern, a tuple of sources, offers its tokens ``repeats`` times at costs 0, 1, 3, 6, …
    (convex, so the first pass is used before the second). Successive shortest paths with
    potentials; quotas that no pattern can fill stay partly empty.
    """
    flow: dict[tuple[tuple, int, str | None], int] = defaultdict(int)
    left = {(p, k): c for p, c in capacity.items() for k in range(repeats) if c}
    lacking = {s: q for s, q in quotas.items() if q > 0}
    by_source: dict = defaultdict(list)
    for p in capacity:
        for s in p:
            by_source[s].append(p)
    held = defaultdict(set)  # by pattern and repetition: sources that it feeds
    sources = list(lacking)
    for source in sources:
        while lacking[source] > 0:
            # From the lacking source back over patterns that can feed it, to unused capacity.
            best, previous = {("s", source): 0}, {}
            heap, reached = [(0, 0, ("s", source))], None
            tick = 0
            while heap:
                cost, _, node = heapq.heappop(heap)
                if cost > best[node]:
                    continue
                if node[0] == "p" and left[node[1:]] > 0:
                    reached = node
                    break
                if node[0] == "s":
                    steps = [(("p", p, k), k * (k + 1) // 2) for p in by_source[node[1]] for k in range(repeats) if (p, k) in left]
                else:  # this repetition feeds another source, which could be fed by something else
                    _, p, k = node
                    steps = [(("s", t), -(k * (k + 1) // 2)) for t in held[p, k] if flow[p, k, t] > 0]
                for to, c in steps:
                    if cost + c < best.get(to, 1 << 60):
                        best[to], previous[to] = cost + c, node
                        tick += 1
                        heapq.heappush(heap, (cost + c, tick, to))
            if reached is None:
                break
            path, node = [], reached
            while node != ("s", source):
                path.append((node, previous[node]))
                node = previous[node]
            amount = min([lacking[source], left[reached[1:]], *(flow[b[1], b[2], a[1]] for a, b in path if b[0] == "p")])
            left[reached[1:]] -= amount
            lacking[source] -= amount
            for a, b in path:
                if a[0] == "p":
                    flow[a[1], a[2], b[1]] += amount
                    held[a[1], a[2]].add(b[1])
                else:
                    flow[b[1], b[2], a[1]] -= amount
    return {k: v for k, v in flow.items() if v > 0}


def _pattern(sources: Column) -> Column:
    """The distinct members, by code point and null last, as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))


def mix(
    docs: DataFrame,
    sources: Column,
    seed: int = 7,
    repeats: int = 3,
    weights: dict[str | None, float] | None = None,
    buckets: int = BUCKETS,
) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """How often each document is taken, with the sizes and targets of the sources.

    ``sources`` is an array of the sources that a document belongs to; null counts as one
    source, the last. Returns the columns of ``docs`` with ``size`` (words), ``copies`` and
    ``assigned`` (the source that each copy counts to), which replace columns of those names; a
    dict of source sizes and one of targets. A document whose stretch of words lies with its
    middle inside the flow is taken whole, so a source misses its target by half a document per
    pattern and repetition at most. Rows that repeat both ``doc_id`` and text are taken alike.
    Empty tables give no rows and empty dicts. The seed fixes the selection.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "copies", "assigned")]
    place = F.xxhash64(F.lit(seed), id_key(), whole_text())
    sized = docs.select(
        boxed(own), count_words(F.col("text")).alias("size"), _pattern(sources).alias("_pattern"), place.alias("_place")
    )
    bucket = F.shiftright("_place", 64 - buckets.bit_length() + 1).alias("_bucket")
    narrow = settle(sized.select("_pattern", "size", "_place", bucket), "mix-sizes")

    sums = narrow.groupBy("_pattern").agg(F.sum("size").alias("size"))
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    capacity = {tuple(json.loads(r["_pattern"])): r["size"] for r in found}
    written = {tuple(json.loads(r["_pattern"])): r["_pattern"] for r in found}
    sizes: dict[str | None, int] = defaultdict(int)
    for pattern, size in capacity.items():
        for source in pattern:
            sizes[source] += size
    total = sum(capacity.values())
    chosen = weights or repeating_weights(list(sizes))
    shares = capped_targets(sizes, chosen, repeats) if total else dict.fromkeys(sizes, 0.0)
    flow = min_cost_flow(capacity, {s: round(t) for s, t in shares.items()}, repeats)

    # Stretches of each pattern's words: (repetition, source, first word, last word).
    stretches = []
    for pattern in capacity:
        for k in range(repeats):
            at = 0
            for source in pattern:
                if amount := flow.get((pattern, k, source), 0):
                    stretches.append((written[pattern], k, source, at, at + amount))
                    at += amount
    plan = _ranges(narrow, spark.createDataFrame(stretches, "_pattern string, _k int, _source string, _lo long, _hi long"))
    # At most MAX_PATTERNS rows, so every task can hold them and no text has to move.
    plan = F.broadcast(spark.createDataFrame(plan.collect(), plan.schema))
    taken = F.transform(F.filter("_plan", lambda x: _inside(F.col("_place"), x)), lambda x: x["_source"])
    none = F.expr("cast(array() as array<string>)")
    rows = sized.join(plan, "_pattern", "left").withColumn("assigned", F.coalesce(taken, none))
    return rows.select(*unboxed(own), "size", F.size("assigned").alias("copies"), "assigned"), dict(sizes), shares


def _inside(place: Column, x: Column) -> Column:
    from_ = x["_from"].isNull() | (place >= x["_from"])
    return from_ & (x["_until"].isNull() | (place < x["_until"]))


def _ranges(narrow: DataFrame, stretches: DataFrame) -> DataFrame:
    """Per pattern, the ranges of hash values that its stretches of words cover.

    Running sums over the buckets find the bucket of each border; only those buckets are put in
    order. A border is the first document whose middle word lies at or beyond it.
    """
    before = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("_size"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    borders = (
        stretches.select("_pattern", F.explode(F.array("_lo", "_hi")).alias("_border")).distinct().filter("_border > 0")
    )
    where = borders.join(sums, "_pattern").filter("_before <= _border and _border < _before + _size")
    within = narrow.join(where.select("_pattern", "_bucket", "_before").distinct(), ["_pattern", "_bucket"])
    order = Window.partitionBy("_pattern", "_bucket").orderBy("_place", "size")
    middle = F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    ordered = within.withColumns({"_middle": middle})
    beyond = (
        ordered.join(where.select("_pattern", "_bucket", "_border"), ["_pattern", "_bucket"])
        .groupBy("_pattern", "_border")
        .agg(
            F.min(F.when(F.col("_middle") >= F.col("_border"), F.col("_place"))).alias("_at"),
            F.max("_place").alias("_last"),
        )
        # No middle beyond the border in its bucket: the border lies after the bucket's last row.
        .select("_pattern", "_border", F.coalesce("_at", F.col("_last") + 1).alias("_at"))
    )
    lo, hi = beyond.alias("lo"), beyond.alias("hi")
    cut = (
        stretches.alias("s")
        .join(lo, (F.col("s._pattern") == F.col("lo._pattern")) & (F.col("s._lo") == F.col("lo._border")), "left")
        .join(hi, (F.col("s._pattern") == F.col("hi._pattern")) & (F.col("s._hi") == F.col("hi._border")), "left")
    )
    item = F.struct(
        F.col("s._k").alias("_k"),
        F.col("s._source").alias("_source"),
        F.col("lo._at").alias("_from"),
        F.col("hi._at").alias("_until"),
    )
    return cut.groupBy("s._pattern").agg(F.sort_array(F.collect_list(item)).alias("_plan"))
