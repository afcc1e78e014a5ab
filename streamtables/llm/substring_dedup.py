"""Substring deduplication by level-wise doubling of repeated word windows.

A passage repeats only if its parts do. So windows of a quarter of the final length are looked
at first; those that occur once are done with, the others are extended to twice their length,
and again, until they have the final length or no candidates survive.

The first level does not need every window. In each final window the short window with the
smallest hash is its anchor, and windows that lie in the same surroundings share one. A run of
windows with one anchor, together with the words it covers, is a *stretch*. Stretches that
repeat as a whole (copies) are settled at once: all but the first are removed. Of each class of
equal stretches only the first goes on, and only if its anchor occurs in another class too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.llm.common import NULL_ID, by_batches, id_key, mix64, settle, whole_text, words_of

WINDOW = 20
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)

# Where a stretch stands is one number: the word at which its first window starts, 20 bits of
# the text's hash (to tell apart texts with the same doc_id), the places of anchor and last
# window behind the first.
_GEO_BITS, _TIE_BITS = 12, 20
_START_SHIFT = _GEO_BITS + _TIE_BITS


class _Powers:
    """Powers of the multiplier and of its inverse, as far as the longest text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _M), ("down", _M_INVERSE)):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))


_POWERS = _Powers()


def tie_of(raw: bytes) -> int:
    """Tells texts of one id apart; ``_tie`` is the same in Spark."""
    return xxhash.xxh64_intdigest(raw, 42) & ((1 << _TIE_BITS) - 1)


def _tie() -> Column:
    return F.xxhash64("_text").bitwiseAND((1 << _TIE_BITS) - 1)


class Words:
    """The words of a text with hashes of any of its ranges in constant time."""

    def __init__(self, text: str | None):
        self.words = words_of(text)
        digest = xxhash.xxh64_intdigest
        self.tie = tie_of((text or "").encode())
        self.n = len(self.words)
        _POWERS.upto(self.n + 1)
        hashes = np.array([digest(w) for w in self.words], dtype=np.uint64)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(hashes * _POWERS.up[: self.n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [start, stop)."""
        return mix64((self.sums[stop] - self.sums[start]) * _POWERS.down[start])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of so many words."""
        n = self.n - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self.sums[length:] - self.sums[:n]) * _POWERS.down[:n])


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its first smallest value."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        span += step
    return place


def stretches(words: Words, window: int, base: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, stretch hash, first window, anchor and last window of every stretch of a text."""
    short = words.windows(base)
    anchor = _first_smallest(short, window - base + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    at = anchor[first]
    whole = words.ranges(first, last + window)
    geometry = ((at - first) << (_GEO_BITS // 2)) | (last - first)
    return short[at], mix64(whole + geometry.astype(np.uint64)), first, at, last


def _place(tie: int, first: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << _START_SHIFT) | (tie << _GEO_BITS) | ((at - first) << (_GEO_BITS // 2)) | (last - first)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, ...]:
    half = (1 << (_GEO_BITS // 2)) - 1
    first = place >> _START_SHIFT
    return first, first + ((place >> (_GEO_BITS // 2)) & half), first + (place & half), (place >> _GEO_BITS) & ((1 << _TIE_BITS) - 1)


# What a row of the first level is: a stretch to compare, one known to repeat an earlier one, or
# a sign that an anchor occurs in several stretches of one batch.
_COMPARE, _REPEATED, _SIGN = 0, 1, 2
_LEVEL_ONE = "_group long, _kind int, _anchor long, _stretch long, _id long, _place long"


def _first_level(docs: DataFrame, window: int, base: int) -> DataFrame:
    """Stretches of all texts. A batch settles its own copies, so a large group of copies leaves
    one stretch for each batch, and deals anchors that it has several times by their stretch."""

    def step(batch: pa.RecordBatch):
        parts = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = Words(text.as_py())
            if words.n >= window:
                anchor, whole, first, at, last = stretches(words, window, base)
                parts.append((anchor, whole, np.full(len(anchor), doc, dtype=np.int64), _place(words.tie, first, at, last)))
        if not parts:
            return None
        anchor, whole, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, whole, anchor))
        anchor, whole, doc, place = anchor[order], whole[order], doc[order], place[order]
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
        # The same row twice is one document given twice, not a repetition.
        twice = ~new & np.concatenate([[False], (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
        kind = np.where(new, _COMPARE, _REPEATED)
        classes = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
        group = np.where(classes > 1, mix64(anchor ^ mix64(whole)), anchor)
        group = np.where(new, group, mix64(doc.astype(np.uint64) + place.astype(np.uint64)))
        sign = new_anchor & (classes > 1)
        keep = ~twice
        return {
            "_group": np.concatenate([group[keep], anchor[sign]]).view(np.int64),
            "_kind": np.concatenate([kind[keep], np.full(sign.sum(), _SIGN)]),
            "_anchor": np.concatenate([anchor[keep], anchor[sign]]).view(np.int64),
            "_stretch": np.concatenate([whole[keep], np.zeros(sign.sum(), dtype=np.uint64)]).view(np.int64),
            "_id": np.concatenate([doc[keep], np.zeros(sign.sum(), dtype=np.int64)]),
            "_place": np.concatenate([place[keep], np.zeros(sign.sum(), dtype=np.int64)]),
        }

    return by_batches(docs.select("_id", "_text"), _LEVEL_ONE, step)


_REMOVE, _GO_ON = 0, 1


def _anchor_groups(first_level: DataFrame) -> DataFrame:
    """(``_id``, ``_place``, ``_what``): stretches to remove, and those that go on to the next level."""
    order = Window.partitionBy("_group").orderBy("_stretch", "_anchor", "_kind", "_id", "_place")
    group = Window.partitionBy("_group")
    compare = F.col("_kind") == _COMPARE
    # Rows of one stretch follow each other. A group has one row for each batch at most, but for
    # rows dealt alone, which need no comparison.
    seen = first_level.withColumns(
        {
            "_same": compare
            & (F.lag("_stretch").over(order) == F.col("_stretch"))
            & (F.lag("_anchor").over(order) == F.col("_anchor")),
            "_same_row": (F.lag("_id").over(order) == F.col("_id")) & (F.lag("_place").over(order) == F.col("_place")),
            "_low": F.min(F.when(compare, F.col("_stretch"))).over(group),
            "_high": F.max(F.when(compare, F.col("_stretch"))).over(group),
            "_signs": F.max((F.col("_kind") == _SIGN).cast("int")).over(group),
        }
    )
    dealt_by_stretch = F.col("_group") != F.col("_anchor")
    several = dealt_by_stretch | (F.col("_low") != F.col("_high")) | (F.col("_signs") == 1)
    same = F.coalesce("_same", F.lit(False))
    what = (
        F.when(F.col("_kind") == _REPEATED, _REMOVE)
        .when(F.col("_kind") == _SIGN, None)
        .when(same, F.when(~F.coalesce("_same_row", F.lit(False)), _REMOVE))
        .when(several, _GO_ON)
    )
    return seen.select("_id", "_place", what.alias("_what")).filter("_what is not null")


_CANDIDATES = "_id long, _place long, _left long, _right long, _windows binary"


def _candidates(docs: DataFrame, going_on: DataFrame, window: int, base: int) -> DataFrame:
    """The next levels' hashes of the stretches that go on, from their texts."""
    tie = F.shiftright("_place", _GEO_BITS).bitwiseAND((1 << _TIE_BITS) - 1).alias("_tie")
    per_doc = going_on.groupBy("_id", tie).agg(F.collect_list("_place").alias("_places"))
    texts = _packed(docs).join(per_doc, ["_id", "_tie"]).select("_id", "_packed", "_places")

    def step(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("_id", "_place", "_left", "_right", "_windows")}
        unpack = zstandard.ZstdDecompressor()
        for doc, packed, places in zip(*(batch.column(i) for i in range(3)), strict=True):
            words = Words(unpack.decompress(packed.as_py()).decode())
            place = np.sort(places.values.to_numpy())
            first, at, last, tie = _unplace(place)
            fits = (tie == words.tie) & (last + window <= words.n)
            full = words.windows(window)
            for p, f, a, z in zip(place[fits], first[fits], at[fits], last[fits], strict=True):
                left = words.ranges(np.array([a - base]), np.array([a + base]))[0] if a >= base else None
                right = words.ranges(np.array([a]), np.array([a + 2 * base]))[0] if a + 2 * base <= words.n else None
                row = (doc.as_py(), int(p), left, right, full[f : z + 1].tobytes())
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        for side in ("_left", "_right"):
            out[side] = [None if x is None else int(x.view(np.int64)) for x in out[side]]
        return out

    return by_batches(texts, _CANDIDATES, step)


def _packed(docs: DataFrame) -> DataFrame:
    """Compressed texts, so that joins move less."""

    @F.pandas_udf(T.BinaryType())
    def pack(text: pd.Series) -> pd.Series:
        tool = zstandard.ZstdCompressor(level=3)
        return pd.Series([tool.compress(t.encode()) for t in text], dtype=object)

    return docs.select("_id", _tie().alias("_tie"), pack("_text").alias("_packed"))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)


def _surviving_windows(candidates: DataFrame, window: int, base: int) -> DataFrame:
    """(``_id``, ``_start``, ``_hash``) of windows whose parts of twice the base length all repeat."""
    halves = candidates.select(
        "_id",
        "_place",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("_left").alias("hash")),
                F.struct(F.lit(1).alias("side"), F.col("_right").alias("hash")),
            )
        ).alias("_half"),
    ).select("_id", "_place", F.col("_half.side").alias("_side"), F.col("_half.hash").alias("_hash"))
    halves = halves.filter("_hash is not null")
    # The same row of a document that is given twice counts once.
    repeated = _repeated(halves.distinct(), "_hash")
    alive = halves.join(repeated, "_hash", "left_semi").groupBy("_id", "_place").agg(
        F.max((F.col("_side") == 0).cast("int")).alias("_l"), F.max((F.col("_side") == 1).cast("int")).alias("_r")
    )
    kept = candidates.join(alive, ["_id", "_place"])

    def step(batch: pa.RecordBatch):
        ids, starts, hashes = [], [], []
        doc, place, left, right = (batch.column(i).to_numpy() for i in range(4))
        first, at, _, _ = _unplace(place)
        left, right, raw = left.astype(bool), right.astype(bool), batch.column(4)
        for i in range(batch.num_rows):
            full = np.frombuffer(raw[i].as_py(), dtype=np.int64)
            start = first[i] + np.arange(len(full))
            # A window holds the longer part to the left or right of its anchor if there is room.
            holds_left = at[i] - base >= start
            holds_right = at[i] + 2 * base <= start + window
            alive = (~holds_left | left[i]) & (~holds_right | right[i])
            ids.append(np.full(int(alive.sum()), doc[i], dtype=np.int64))
            starts.append((start[alive] << _TIE_BITS) | ((place[i] >> _GEO_BITS) & ((1 << _TIE_BITS) - 1)))
            hashes.append(full[alive])
        return {"_id": np.concatenate(ids), "_start": np.concatenate(starts), "_hash": np.concatenate(hashes)}

    return by_batches(kept.select("_id", "_place", "_l", "_r", "_windows"), "_id long, _start long, _hash long", step)


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(``_id``, ``_tie``, ``_first``, ``_until``): ranges of words to remove; ``docs`` has ``_id``, ``_text``."""
    if window % 4 or not 4 <= window <= 64:
        raise ValueError("the window must be a multiple of 4 from 4 to 64: two doublings lead to it")
    base = window // 4
    level = settle(_anchor_groups(_first_level(docs, window, base)), "stretches")
    candidates = settle(_candidates(docs, level.filter(F.col("_what") == _GO_ON), window, base), "candidates")
    windows = settle(_surviving_windows(candidates, window, base).distinct(), "windows")
    first = windows.groupBy("_hash").agg(F.min(F.struct("_id", "_start")).alias("_least"), F.count("*").alias("_n"))
    first = settle(first.filter("_n > 1").select("_hash", "_least"), "first-windows")
    later = windows.join(first, "_hash").filter(F.struct("_id", "_start") != F.col("_least"))
    tie_mask = (1 << _TIE_BITS) - 1
    start = F.shiftright("_start", _TIE_BITS)
    single = later.select("_id", F.col("_start").bitwiseAND(tie_mask).alias("_tie"), start.alias("_first"), (start + window).alias("_until"))
    half = (1 << (_GEO_BITS // 2)) - 1
    begin = F.shiftright("_place", _START_SHIFT)
    whole = level.filter(F.col("_what") == _REMOVE).select(
        "_id",
        F.shiftright("_place", _GEO_BITS).bitwiseAND(tie_mask).alias("_tie"),
        begin.alias("_first"),
        (begin + F.col("_place").bitwiseAND(half) + window).alias("_until"),
    )
    return whole.unionByName(single)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word of a window of ``window`` words that also starts earlier.

    Earlier is a smaller ``doc_id`` or an earlier start in the same document; windows are judged
    on the input. Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (the kept words
    joined by one space), a row for each row of ``docs``.

    A null text has no words. A null ``doc_id`` comes before all others. Rows that share a
    ``doc_id`` are one document in the order: the earlier start is first. Rows that repeat both
    ``doc_id`` and text are one document given twice, and get the same result.
    """
    rows = docs.select("doc_id", id_key().alias("_id"), whole_text().alias("_text"))
    ranges = repeated_ranges(rows, window).groupBy("_id", "_tie").agg(
        F.collect_list(F.struct("_first", "_until")).alias("_ranges")
    )
    joined = _packed(rows).join(ranges, ["_id", "_tie"], "left")

    def step(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text")}
        unpack = zstandard.ZstdDecompressor()
        for doc, packed, found in zip(*(batch.column(i) for i in range(3)), strict=True):
            raw = unpack.decompress(packed.as_py())
            words, gone = raw.split(), 0
            kept = words
            if found.is_valid and words:
                first, until = (x.to_numpy() for x in found.values.flatten())
                fits = until <= len(words)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, first[fits], 1)
                np.add.at(edge, until[fits], -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            row = (doc.as_py(), len(words), gone, b" ".join(kept).decode())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return out

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    done = by_batches(joined.select("_id", "_packed", "_ranges"), schema, step)
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
