from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from streamtables.llm import golay, simhash_dedup
from tests.llm.fixtures import no_docs, odd_docs, odd_rows


def _plain(text):
    words = [w.lower() for w in (text or "").encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    """Root (smallest position) of each fingerprint by comparing all."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_code_is_perfect():
    errors, near = golay._tables()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    for word, keys in zip(words, golay.near_codewords(words), strict=True):
        codes = [int(k) << 11 for k in keys]
        codes = [c | int(golay._remainder(np.array([c]))[0]) for c in codes]
        assert all((c ^ int(word)).bit_count() <= 4 for c in codes)


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64) for _ in range(2))
    one, two = simhash_dedup.fuzzy_keys(x), simhash_dedup.fuzzy_keys(x ^ a ^ b)
    assert (one[:, :, None] == two[:, None, :]).any((1, 2)).all()


def test_odd_documents(spark):
    got = simhash_dedup.dedup_near(odd_docs(spark)).collect()
    rows = [(-(2**63) if i is None else i, _plain(t), r) for i, t, *_, r in odd_rows()]
    roots = _components([fp for _, fp, _ in rows])
    least = {root: min(i for (i, _, _), o in zip(rows, roots, strict=True) if o == root) for root in set(roots)}
    expected = {r: (f"{fp:016x}", least[root]) for (_, fp, r), root in zip(rows, roots, strict=True)}
    assert {r._row: (r.fingerprint, -(2**63) if r.component_id is None else r.component_id) for r in got} == expected


@pytest.mark.parametrize("largest_bucket", [1, 5, 64])
def test_links_of_fingerprints(spark, largest_bucket):
    """Chains, clusters around a centre and strangers, with small and large buckets."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(prints)[:4]:
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(30)}
    x = rng.getrandbits(64)
    for _ in range(12):
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints.add(x)
    prints = sorted(simhash_dedup._signed(p) for p in prints)
    distinct = spark.createDataFrame([(p,) for p in prints], "_fp long")
    found = simhash_dedup.components(simhash_dedup.links(distinct, largest_bucket)).collect()
    roots = {r["_node"]: r["_root"] for r in found}
    expected = [prints[i] for i in _components([p % (1 << 64) for p in prints])]
    assert [roots.get(p, p) for p in prints] == expected


def test_empty_table(spark):
    assert simhash_dedup.dedup_near(no_docs(spark)).count() == 0
