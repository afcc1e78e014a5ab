from __future__ import annotations

import random

import numpy as np
import pytest

from streamtables.llm import minmax_dedup as M
from tests.llm.fixtures import SCHEMA, no_docs, odd_docs, odd_rows, prose


def _shingles(text, length):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()


def _edited(text, edits, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.random()}"
    return " ".join(words)


def near_rows():
    """Copies with more and more edits, chains of edits, and large groups of copies of one original."""
    rng = random.Random(5)
    texts = []
    for seed in range(40):
        base = prose(100 + seed, 300, 5000)
        texts += [base, _edited(base, 1 + seed % 14, rng)]
    chain = prose(7, 200, 5000)
    for _ in range(8):
        chain = _edited(chain, 3, rng)
        texts.append(chain)
    for seed, most in ((8, 6), (9, 14)):  # the second one is mostly too far apart to be linked directly
        base = prose(seed, 120, 5000)
        texts += [_edited(base, rng.randrange(1, most), rng) for _ in range(70)]
    rng.shuffle(texts)
    return [(i, t, "en", "a", len(t), "x", None, "kept", i) for i, t in enumerate(texts)]


def _number(value):
    return -(2**63) if value is None else value


def _expected(rows, length, percent):
    """(id, number of shingles, component) of every row by comparing all."""
    sets = [_shingles(r[1], length) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 2**63), _number(r[0]))
    return sorted((_number(r[0]), len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("length", "percent", "values"), [(3, 85, 8), (5, 80, 6)])
def test_components_equal_brute_force(spark, length, percent, values):
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = M.dedup_similar(docs, length, percent, values).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _expected(rows, length, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows_and_no_rows(spark):
    got = M.dedup_similar(odd_docs(spark)).collect()
    found = sorted((_number(r.doc_id), r.n_shingles, _number(r.component_id)) for r in got)
    assert found == _expected(odd_rows(), 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert M.dedup_similar(no_docs(spark)).count() == 0


def test_extremes_of_one_evaluation():
    found = M.shingles(prose(3, 5000, 3000))
    least, most = M.extremes(found, 12)
    xors, factors = M._permutations(12)
    values = (found[:, None] ^ xors) * factors
    assert (least == values.min(axis=0)).all() and (most == values.max(axis=0)).all()
    assert M.band_keys(found, M.Bands()).shape == (M.Bands().count,)


def test_signatures_agree_as_often_as_sets_are_alike():
    """Minima and maxima together estimate the similarity without bias."""
    rng = random.Random(2)
    errors = []
    for _ in range(40):
        base = prose(rng.randrange(10**6), 400, 10**6)
        a, b = M.shingles(base), M.shingles(_edited(base, 20, rng))
        both = len(np.intersect1d(a, b))
        pairs = [np.concatenate(M.extremes(x, 200)) for x in (a, b)]
        errors.append((pairs[0] == pairs[1]).mean() - both / (len(a) + len(b) - both))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_sketches_never_exceed_the_difference():
    rng = random.Random(3)
    for n in (1, 5, 60, 900):
        base = prose(n, n + 10, 10**6)
        a, b = M.shingles(base), M.shingles(_edited(base, n // 6 + 1, rng))
        bits = int(np.bitwise_count((M.odd_sketch(a) ^ M.odd_sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_bands_miss_one_in_a_million():
    for bands in (M.Bands(85, 8), M.Bands(80, 6), M.Bands(90, 10)):
        assert (1 - (bands.percent / 100) ** bands.values) ** bands.count <= M.MISS


def test_one_row_of_each_group_stays(spark):
    rows = [*near_rows(), (5, near_rows()[5][1] + " tail", "en", "b", 1, "shared id", None, None, 900), (950, None, "en", "b", None, "x", None, None, 950)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = M.one_per_group(docs, M.similar_groups(docs, 5, 80, 6))
    assert left.columns == docs.columns
    components = _expected(rows, 5, 80)
    kept = {r._row for r in left.collect()}
    assert 950 in kept, "a text without words has no copies"
    assert len(kept) == len({c for _, n, c in components if n}) + 1
    assert not {5, 900} <= kept, "rows that share an id are copies of each other like any others"
