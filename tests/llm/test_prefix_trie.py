from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from streamtables.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, _pos string"


def _talks(seed, convs, longest, words=2):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None][: words + 2]), 1, "x"))
    return rows


def _odd():
    same = [(c, t, "user", f"t{t}", 0, None) for c in (50, 51, 52, 57) for t in range(8 if c < 57 else 11)]
    ties = [(60, None, "user", "n", 0, None), (60, 1, "b", "z", 0, None), (60, 1, "a", "z", 0, None), (60, 1, "a", "z", 0, None)]
    return [*same, *ties, (None, 3, "user", "no id", 0, None), (None, None, None, None, 0, None), (-7, 0, "user", "t0", 0, None)]


def _ordered(rows):
    talks: dict = {}
    for c, t, role, text, *_ in rows:
        role, text = role or "", text or ""
        said = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        talks.setdefault(c, []).append(((t is not None, t or 0), said, (role, text)))
    return {c: [x for *_, x in sorted(v, key=lambda r: r[:2])] for c, v in talks.items()}


def _rebuilt(talks, step=5, most=9):
    out = {}
    for c, own in talks.items():
        if c is None:
            out[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % step) * (1 if c >= 0 else -1)
        out[c] = talks.get(base, [])[:h] + own[h:]
    return out


def _key(c):
    return -(2**63) if c is None else c


def _expected(talks):
    members: dict = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(1 for p in below if not any(q[:-1] == p and q for q in members))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in convs if c is not None and len(talks[c]) == len(path))
        children = sum(1 for q in members if q and q[:-1] == path)
        first = min(convs, key=_key)
        parent = min(members[path[:-1]], key=_key) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        rows.append((first, len(path), parent, len(convs), children, leaves, saved, digest))
    return sorted(rows, key=repr)


def _nodes(spark, rows, block, rebuild):
    turns = P.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    conv = F.col("_conv")
    count = F.crc32(conv.cast("string").cast("binary")) % 9 if rebuild else F.lit(0)
    turns, everyone = P.borrowed_starts(turns, conv - conv % 5, count, 8)
    return sorted(map(tuple, P.prefix_nodes(turns, everyone, block).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_nodes_equal_brute_force(spark, block):
    rows = _talks(1, 40, 9) + _odd()
    assert _nodes(spark, rows, block, True) == _expected(_rebuilt(_ordered(rows)))


def test_nodes_without_rebuilding(spark):
    rows = _talks(2, 60, 14, 1) + _odd()
    assert _nodes(spark, rows, 4, False) == _expected(_ordered(rows))


def test_long_conversations_are_put_together_from_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 3)
    rows = [(c, t, "user", f"t{t}" if t < 40 + c else f"own{c}", 0, None) for c in range(3) for t in range(60)]
    assert _nodes(spark, rows, 2, False) == _expected(_ordered(rows))


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(P, "JOINED", 20)
    rows = [(c, t, "user", "same", 0, None) for c in range(300) for t in range(2)]
    assert _nodes(spark, rows, 4, False) == _expected(_ordered(rows))


def test_no_conversations(spark):
    assert _nodes(spark, [], 4, True) == []
