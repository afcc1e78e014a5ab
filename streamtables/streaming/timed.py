"""Live operators that need the rows of a key in order of event time.

A stream brings rows out of order. Here the rows of a key are held in state until the watermark
has passed them, which a timer tells, and are then worked on in order of time and tie-break;
what later rows need is carried in state. Nothing that arrives afterwards can come before a row
that was worked on, since Spark drops it as late, so over closed time the result equals that of
the batch operator. Rows whose time is too old to matter leave the carried state, by a timer if no
further row of the key arrives, so state follows the rate of the stream and not its age.

A key's open rows are one task's; joins can spread a hot key (``salt``). Times of the payload travel as numbers of microseconds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from streamtables.operators.joins import SALT, spread

_MICROS = 1_000_000
#: A row in state: time in microseconds, side, tie-break and payload follow each other.
Entry = tuple
#: From what is carried and the closed rows, in order: the results and what is carried on.
Step = Callable[[list[Entry], list[Entry]], tuple[list[tuple], list[Entry]]]


def _sortable(values) -> tuple:
    return tuple((v is not None, v) for v in values)


class InTimeOrder(StatefulProcessor):
    """Hands closed rows of a key to ``step`` in order of their first ``ordered`` columns.

    ``keep`` is how many microseconds a carried row may matter after its time (None: for ever).
    """

    def __init__(self, columns: list[str], schema: str, ordered: int, step: Step, keep: int | None, named: list[str]):
        self.columns, self.schema, self.ordered, self.step, self.keep = columns, schema, ordered, step, keep
        self.result = Row(*named)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.carried = handle.getListState("carried", self.schema)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(row[c] for c in self.columns) for row in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        closed, open_ = [], []
        for row in map(tuple, self.waiting.get()):
            (closed if row[0] <= passed else open_).append(row)
        carried = [tuple(row) for row in self.carried.get()]
        results, kept = [], carried
        if closed:
            closed.sort(key=lambda row: _sortable(row[: self.ordered]))
            results, kept = self.step(carried, closed)
            if open_:
                self.waiting.put(open_)
                self._wake(min(row[0] for row in open_))
            else:
                self.waiting.clear()
        if self.keep is not None:
            # Rows to come are later than the watermark.
            kept = [row for row in kept if row[0] + self.keep > passed]
        if kept != carried:
            if kept:
                self.carried.put(kept)
            else:
                self.carried.clear()
        if kept and self.keep is not None:
            self._wake(min(row[0] for row in kept) + self.keep)
        for values in results:
            yield self.result(*key, *values)

    def close(self) -> None:
        pass


@dataclass
class _Column:
    """A column of the payload: its name, its type, and its type in state."""

    name: str
    dtype: T.DataType

    @property
    def timed(self) -> bool:
        return isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType))

    @property
    def stored(self) -> str:
        return "long" if self.timed else self.dtype.simpleString()

    def into(self, alias: str):
        column = F.col(f"`{self.name}`")
        return (F.unix_micros(column.cast("timestamp")) if self.timed else column).alias(alias)

    def back(self, alias: str):
        column = F.col(alias)
        return (F.timestamp_micros(column).cast(self.dtype) if self.timed else column).alias(self.name)


def _payload(df: DataFrame, columns: list[str]) -> list[_Column]:
    return [_Column(c, df.schema[c].dataType) for c in columns]


def _line(df: DataFrame, by: list[str], time: str, side: int, tie: list[str], payload: list[_Column], prefix: str, ties: int) -> DataFrame:
    """Rows of one side on the common time line."""
    tied = _payload(df, tie)
    return df.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col(time).alias("_time"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("_t"),
        F.lit(side).alias("_side"),
        *[c.into(f"_o{side}_{i}") for i, c in enumerate(tied)],
        *[c.into(f"{prefix}{i}") for i, c in enumerate(payload)],
    )


def _run(line: DataFrame, by_count: int, state: list[str], ordered: int, step: Step, keep: int | None, result: list[tuple[str, str]]) -> DataFrame:
    keys = [f"_k{i}" for i in range(by_count)]
    types = {f.name: f.dataType.simpleString() for f in line.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in state)
    out = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"`{n}` {t}" for n, t in result)])
    processor = InTimeOrder(state, schema, ordered, step, keep, [*keys, *(n for n, _ in result)])
    # Rows without a time are in no order; like late rows they have no place.
    return line.filter(F.col("_t").isNotNull()).groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")


def _named_keys(by: list[str]) -> list:
    return [F.col(f"_k{i}").alias(c) for i, c in enumerate(by)]


def _two_sides(
    left: DataFrame, right: DataFrame, by: list[str], times: tuple[str, str], ties: tuple[list[str], list[str]], right_first: bool
) -> tuple[DataFrame, list[str], int, list[_Column], list[_Column]]:
    """The union of both sides, the columns kept in state, how many of them order it, and the payloads."""
    one = _payload(left, [c for c in left.columns if c not in by])
    other = _payload(right, [c for c in right.columns if c not in by])
    lines = [
        _line(left, by, times[0], int(right_first), ties[0], one, "_l", len(ties[0])),
        _line(right, by, times[1], int(not right_first), ties[1], other, "_r", len(ties[1])),
    ]
    line = lines[0].unionByName(lines[1], allowMissingColumns=True)
    order = [c for side in (0, 1) for c in line.columns if c.startswith(f"_o{side}_")]
    state = ["_t", "_side", *order, *[f"_l{i}" for i in range(len(one))], *[f"_r{i}" for i in range(len(other))]]
    return line, state, 2 + len(order), one, other


def as_of_join_live(
    facts: DataFrame,
    versions: DataFrame,
    by: list[str],
    fact_time: str,
    version_time: str,
    fact_order: list[str],
    version_order: list[str] | None = None,
    how: str = "inner",
    salt: int = 1,
) -> DataFrame:
    """Each fact with the version of its key that was valid at the fact's time, once the watermark has passed it.

    The live form of ``as_of_join``, with its columns. Both streams have a watermark on their time;
    the slower one decides. State holds the facts and versions the watermark has not passed and
    one version for each key. ``salt`` > 1 spreads the facts of a hot key over that many state
    partitions, each of which gets all versions.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    versions = versions.dropna(subset=by)  # a missing key equals nothing
    if salt > 1:
        facts, versions = spread(facts, versions, salt)
        times = (fact_time, version_time)
        return as_of_join_live(facts, versions, [*by, SALT], *times, fact_order, version_order, how).drop(SALT)
    line, state, ordered, one, other = _two_sides(
        facts, versions, by, (fact_time, version_time), (fact_order, version_order or []), right_first=True
    )
    first, then = ordered, ordered + len(one)
    inner, blank = how == "inner", (None,) * len(other)

    def step(carried: list[Entry], closed: list[Entry]) -> tuple[list[tuple], list[Entry]]:
        valid, found = (carried[0] if carried else None), []
        for row in closed:
            if row[1] == 0:
                valid = row
            elif valid is not None or not inner:
                found.append((*row[first:then], *(valid[then:] if valid else blank)))
        return found, [valid] if valid else []

    result = [(f"_l{i}", c.stored) for i, c in enumerate(one)] + [(f"_r{i}", c.stored) for i, c in enumerate(other)]
    joined = _run(line, len(by), state, ordered, step, None, result)
    return joined.select(
        *_named_keys(by), *[c.back(f"_l{i}") for i, c in enumerate(one)], *[c.back(f"_r{i}") for i, c in enumerate(other)]
    )


def join_within(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, keep_seconds: float, salt: int = 1
) -> DataFrame:
    """Pairs with equal ``by`` whose times are at most ``keep_seconds`` apart, in either direction.

    The bounded form of a join of two streams: a row leaves state ``keep_seconds`` after its time, by a timer.
    The result is that of a batch join under the same bound; a null key equals nothing. ``salt`` > 1
    spreads the left rows of a hot key over that many state partitions, each with all right rows.
    """
    if salt > 1:
        left, right = spread(left, right, salt)
        return join_within(left, right, [*by, SALT], left_time, right_time, keep_seconds).drop(SALT)
    keep = int(keep_seconds * _MICROS)
    left, right = left.dropna(subset=by), right.dropna(subset=by)
    line, state, ordered, one, other = _two_sides(left, right, by, (left_time, right_time), ([], []), right_first=False)
    first, then = ordered, ordered + len(one)

    def step(carried: list[Entry], closed: list[Entry]) -> tuple[list[tuple], list[Entry]]:
        sides = deque(r for r in carried if r[1] == 0), deque(r for r in carried if r[1] == 1)
        found = []
        for row in closed:
            for kept in sides:
                while kept and kept[0][0] + keep < row[0]:
                    kept.popleft()
            for met in sides[1 - row[1]]:
                a, b = (row, met) if row[1] == 0 else (met, row)
                found.append((*a[first:then], *b[then:]))
            sides[row[1]].append(row)
        return found, [*sides[0], *sides[1]]

    result = [(f"_l{i}", c.stored) for i, c in enumerate(one)] + [(f"_r{i}", c.stored) for i, c in enumerate(other)]
    joined = _run(line, len(by), state, ordered, step, keep, result)
    return joined.select(
        *_named_keys(by), *[c.back(f"_l{i}") for i, c in enumerate(one)], *[c.back(f"_r{i}") for i, c in enumerate(other)]
    )


class _Frame:
    """Aggregates of a frame that only moves forward; each row enters and leaves it once."""

    def __init__(self, kind: str, at: int):
        self.kind, self.at = kind, at
        self.total, self.n, self.best = 0, 0, deque()

    def enter(self, number: int, row: Entry) -> None:
        value = row[self.at]
        if value is None:
            return
        if self.kind in ("sum", "count"):
            self.n += 1
            self.total += value if self.kind == "sum" else 0
            return
        beats = (lambda old: old >= value) if self.kind == "min" else (lambda old: old <= value)
        while self.best and beats(self.best[-1][1]):
            self.best.pop()
        self.best.append((number, value))

    def leave(self, number: int, row: Entry) -> None:
        value = row[self.at]
        if value is None:
            return
        if self.kind in ("sum", "count"):
            self.n -= 1
            self.total -= value if self.kind == "sum" else 0
        elif self.best and self.best[0][0] == number:
            self.best.popleft()

    def value(self):
        if self.kind == "count":
            return self.n
        if self.kind == "sum":
            return self.total if self.n else None
        return self.best[0][1] if self.best else None


_KINDS = ("sum", "count", "min", "max")


def _framed(
    df: DataFrame, by: list[str], time: str, order: list[str], aggregates: dict[str, tuple[str, str]], step_of, keep: int | None
) -> DataFrame:
    payload = _payload(df, [c for c in df.columns if c not in by])
    names = [c.name for c in payload]
    if wrong := [k for k, _ in aggregates.values() if k not in _KINDS]:
        raise ValueError(f"aggregates are {', '.join(_KINDS)}, not {wrong[0]}")
    line = _line(df, by, time, 0, order, payload, "_l", len(order))
    ordered = 2 + len(order)
    state = ["_t", "_side", *[f"_o0_{i}" for i in range(len(order))], *[f"_l{i}" for i in range(len(payload))]]
    takes = [(kind, ordered + names.index(column)) for kind, column in aggregates.values()]
    types = []
    for kind, column in aggregates.values():
        dtype = df.schema[column].dataType
        if kind == "sum":
            dtype = df.limit(0).agg(F.sum(column)).schema[0].dataType if not df.isStreaming else _sum_type(dtype)
        types.append(_Column("", T.LongType() if kind == "count" else dtype))
    result = [(f"_l{i}", c.stored) for i, c in enumerate(payload)] + [(f"_a{i}", t.stored) for i, t in enumerate(types)]
    framed = _run(line, len(by), state, ordered, step_of(takes, ordered), keep, result)
    values = [_Column(n, t.dtype).back(f"_a{i}") for i, (n, t) in enumerate(zip(aggregates, types, strict=True))]
    named = {**dict(zip(by, _named_keys(by), strict=True)), **{c.name: c.back(f"_l{i}") for i, c in enumerate(payload)}}
    return framed.select(*[named[c] for c in df.columns], *values)


def _sum_type(dtype: T.DataType) -> T.DataType:
    """The type of Spark's SUM."""
    if isinstance(dtype, T.DecimalType):
        return T.DecimalType(min(38, dtype.precision + 10), dtype.scale)
    return T.LongType() if isinstance(dtype, T.IntegralType) else T.DoubleType()


def over_range_live(df: DataFrame, by: list[str], time: str, range_seconds: float, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates over the rows of the last ``range_seconds`` up to each row's time, rows of that time included.

    The live form of ``over_range``: a row comes out once the watermark has passed it. State holds
    the rows the watermark has not passed and those of the last ``range_seconds``.
    """
    reach = int(range_seconds * _MICROS)

    def step_of(takes, ordered):
        def step(carried: list[Entry], closed: list[Entry]) -> tuple[list[tuple], list[Entry]]:
            rows = [*carried, *closed]
            frames = [_Frame(kind, at) for kind, at in takes]
            first = entered = 0
            found = []
            for row in closed:
                while entered < len(rows) and rows[entered][0] <= row[0]:
                    for frame in frames:
                        frame.enter(entered, rows[entered])
                    entered += 1
                while rows[first][0] < row[0] - reach:
                    for frame in frames:
                        frame.leave(first, rows[first])
                    first += 1
                found.append((*row[ordered:], *[frame.value() for frame in frames]))
            return found, rows[first:]

        return step

    return _framed(df, by, time, [], aggregates, step_of, reach)


def over_rows_live(
    df: DataFrame, by: list[str], time: str, order: list[str], preceding: int, aggregates: dict[str, tuple[str, str]]
) -> DataFrame:
    """Aggregates over each row and the ``preceding`` rows before it, by ``time`` and then ``order``.

    The live form of ``over_rows``. State holds the rows the watermark has not passed and the last
    ``preceding`` ones of each key.
    """

    def step_of(takes, ordered):
        def step(carried: list[Entry], closed: list[Entry]) -> tuple[list[tuple], list[Entry]]:
            rows = [*carried, *closed]
            frames = [_Frame(kind, at) for kind, at in takes]
            found, first = [], 0
            for number, row in enumerate(rows):
                for frame in frames:
                    frame.enter(number, row)
                if number - first > preceding:
                    for frame in frames:
                        frame.leave(first, rows[first])
                    first += 1
                if number >= len(carried):
                    found.append((*row[ordered:], *[frame.value() for frame in frames]))
            return found, rows[len(rows) - preceding :] if preceding and len(rows) > preceding else rows if preceding else []

        return step

    return _framed(df, by, time, order, aggregates, step_of, None)
