from __future__ import annotations

import math
import random

import numpy as np
import pytest

from streamtables.llm import hard_negatives as H

SCHEMA = "vec_id long, label long, vector array<long>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (70, 33, 65), (64, 64, 64), (129, 40, 97)])
def test_strassen_is_the_product(shape):
    n, k, m = shape
    rng = np.random.default_rng(n)
    a, b = rng.integers(-300, 300, (n, k)), rng.integers(-300, 300, (k, m))
    assert (H.strassen(a, b, leaf=4) == a @ b).all()


def test_scores_that_fit_survive_wrapping():
    a = np.array([[1 << 40, 3], [-(1 << 40), 5], [7, 9]] * 3, dtype=np.int64)
    b = np.array([[1 << 14, -1, 2], [11, 13, 1 << 20]] * 1, dtype=np.int64)
    exact = a.astype(object) @ b.astype(object)
    assert (H.strassen(a, b, leaf=1).astype(object) == exact).all()
    scores, fits = H._scores(np.array([[1 << 62], [3]]), np.array([[8], [1]]))
    assert fits.tolist() == [[False, True], [True, True]] and scores[1].tolist() == [24, 3]


def _expected(rows, anchors, n_positives=5, n_negatives=3, low=50, high=95):
    out = []
    for a, label, x in anchors:
        score = lambda y: sum(p * q for p, q in zip(x, y))  # noqa: B023, E731
        near = sorted([(-score(y), i) for i, l, y in rows if l == label and i != a])[:n_positives]
        others = sorted([(-score(y), i) for i, l, y in rows if l != label])
        for s, p in near:
            within = [(t, i) for t, i in others if low * -s <= 100 * -t <= high * -s][:n_negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(within)]
    return sorted(out)


def _rows(seed, n, dims=6, spread=8, labels=4):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(labels), [rng.randint(-1, spread) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, 0, [spread] * dims) for i in range(30)]  # copies, ties
    rows += [(2000, 1, [5, 5]), (2001, 2, [5] * (dims + 3)), (2002, 3, [])]  # other lengths
    return rows


def test_mining_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "CANDIDATES", 40)
    rows = _rows(3, 230)
    anchors = [r for r in rows if r[0] % 10 == 0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = H.mine(df, df.filter("vec_id % 10 = 0"))
    expected = _expected(rows, anchors)
    assert len(expected) > 100 and sorted(map(tuple, found.collect())) == expected
    few = H.mine(df, df.filter("vec_id = 20"), n_positives=2, n_negatives=1, window=(0, 60))
    assert sorted(map(tuple, few.collect())) == _expected(rows, [r for r in rows if r[0] == 20], 2, 1, 0, 60)


def test_mining_equals_brute_force_over_many_groups(spark, monkeypatch):
    for name, value in (("ANCHORS", 7), ("CANDIDATES", 20), ("LEAST", 1), ("MOST", 2)):
        monkeypatch.setattr(H, name, value)
    rows = _rows(4, 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = _expected(rows, [r for r in rows if r[0] % 10 == 0])
    assert len(expected) > 100 and sorted(map(tuple, H.mine(df, df.filter("vec_id % 10 = 0")).collect())) == expected


def test_no_blocks_pass_through_the_driver(spark):
    """Blocks are far larger than their compressed files, by which joins would choose to broadcast them."""
    df = spark.createDataFrame(_rows(5, 60), SCHEMA)
    plan = H.mine(df, df.filter("vec_id % 10 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_tiles_keep_the_first_of_a_group():
    low = -(1 << 63)
    parts = [[np.array(c) for c in ([1, 1, 1], [0, 0, 2], [9, 4, 3], [5, low, 7])], [np.array(c) for c in ([1, 1], [0, 0], [2, 1], [5, 6])]]
    assert [c.tolist() for c in H._merged(parts, 2)] == [[1, 1, 1], [0, 0, 2], [1, 2, 3], [6, 5, 7]]
    assert [len(c) for c in H._merged([], 2)] == [0] * 4


@pytest.mark.parametrize("top", [0, 127, 128, 32768, 1 << 31, 1 << 62])
def test_blocks_keep_every_integer(top):
    packed = H._packed([2, 1], [0, 0], [np.array([top, -top]), np.array([-top - 1])])
    block = H.Block(*packed)
    assert block.ids.tolist() == [1, 2] and block.values.tolist() == [[-top - 1, 0], [top, -top]]


def test_large_scores_are_exact(spark):
    rows = [(i, i % 2, [(1 << 30) + i, 3 - i]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, H.mine(df, df.filter("vec_id % 7 = 0"), window=(0, 100)).collect())) == _expected(
        rows, [r for r in rows if r[0] % 7 == 0], low=0, high=100
    )


def test_rows_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [nan]), (6, 1, [inf]), (7, 1, [1e300]), (8, 1, []), (None, 2, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")
    kept = {r.vec_id: r.vector for r in H.integer_vectors(df, "vector", 256).collect()}
    assert kept == {1: [128, -1], 8: [], None: [256]}


def test_no_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.mine(none, none).count() == 0
    some = spark.createDataFrame([(0, 1, [2]), (0, 1, [2]), (1, 1, [2]), (2, 2, [1]), (None, 2, [1])], SCHEMA)
    assert H.mine(none, some).count() == 0 and H.mine(some, none).count() == 0
    found = sorted(map(tuple, H.mine(some, some.filter("vec_id = 0")).collect()), key=repr)
    assert found == sorted([(0, 1, 1, None, 4, 2), (0, 1, 2, 2, 4, 2)] * 2, key=repr)
