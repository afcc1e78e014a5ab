from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streamtables.llm import substring_dedup, syncmers
from streamtables.llm.queries import QUERIES
from tests.llm.fixtures import no_docs, odd_docs, odd_rows, prose


def _brute(rows, window):
    """Kept words per row; the first of equal windows by id and start is the earliest."""
    first: dict[tuple, tuple] = {}
    split = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for doc_id, words in split:
        for s in range(len(words) - window + 1):
            at = (doc_id, s)
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, at), at)
    out = Counter()
    for (doc_id, _), (key, words) in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (key, s):
                gone.update(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out[(doc_id, len(words), len(gone), kept)] += 1
    return out


def _got(docs, window):
    rows = substring_dedup.dedup_substrings(docs, window).collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows)


def test_odd_documents(spark):
    # Rows 12 are one row twice; the two rows 13 are one document in the order.
    assert _got(odd_docs(spark), 20) == _brute([r[:2] for r in odd_rows()], 20)


@pytest.mark.parametrize(("window", "seed", "partitions"), [(4, 1, 1), (8, 2, 5), (20, 3, 7)])
def test_random_repeats(spark, window, seed, partitions):
    """Few words, so that windows repeat by chance, overlap and repeat inside documents."""
    rows = [(i, prose(1000 * seed + i, 5 + 7 * i, vocabulary=2 + i % 4)) for i in range(24)]
    passage = prose(seed, 45)
    rows += [(100 + i, f"{prose(seed + i, i)} {passage} {prose(seed - i, 2 * i)}") for i in range(12)]
    rows += [(200 + i, passage) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert _got(docs, window) == _brute(rows, window)


def test_range_hashes_equal_window_hashes():
    words = substring_dedup.Words(prose(9, 300))
    starts = np.arange(words.n - 7)
    assert (words.ranges(starts, starts + 8) == words.windows(8)).all()


def test_window_must_double_twice(spark):
    with pytest.raises(ValueError, match="multiple of 4"):
        substring_dedup.repeated_ranges(no_docs(spark), 10)


def test_empty_table(spark):
    assert substring_dedup.dedup_substrings(no_docs(spark)).count() == 0
    assert syncmers.fingerprint_pairs(no_docs(spark)).count() == 0
    assert syncmers.anchors(no_docs(spark)).count() == 0


def test_edited_texts_and_likeness(spark):
    rows = sorted(((-(2**63) if i is None else i, t or "", i) for i, t, *_ in odd_rows()), key=lambda r: r[:2])
    expected = Counter()
    for n, (_, text, doc_id) in enumerate(rows):
        half, following = len(text) // 2, rows[(n + 1) % len(rows)][1]
        expected[(doc_id, len(text), text[: len(text) - half] + following[:half])] += 1
    got = syncmers.fingerprint_pairs(odd_docs(spark)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_text) for r in got) == expected
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    texts = {(i, len(t or "")): t or "" for i, t, *_ in odd_rows()}
    for r in got:
        assert by_text.setdefault(texts[(r.doc_id, r.n_chars)], r.fingerprint) == r.fingerprint
    long_one = next(r for r in got if r.doc_id == 8)
    assert long_one.near_next == 1.0 and 0.1 < long_one.near_edited < 1
    assert next(r for r in got if r.doc_id == 9).near_next > 0.8


def _xx(value, seed=42):
    raw = value.encode() if isinstance(value, str) else (value & (1 << 64) - 1).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _chained(values):
    seed = 42
    for v in values:
        seed = _xx(v, seed)
    return seed


def _all_anchors(text, k=9, s=3):
    """Closed syncmers by looking at every k-mer on its own."""
    found = []
    for i in range(len(text) - k + 1):
        inner = [_signed(_chained(text[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner[0], inner[-1]) <= min(inner[1:-1]):
            found.append((i, _chained([inner[j] for j in range(0, k - s + 1, s)]) & 0xFFFFFFFF))
    return found


def _divisor(n):
    wanted = 32 * math.sqrt(max(1.0, n / 2048))
    return 1 << int(max(0.0, math.floor(math.log2(max(1.0, n * 2 / 7 / wanted)))))


def _print(text):
    found = [(p, a) for p, a in _all_anchors(text) if a % _divisor(len(text)) == 0]
    return found or ([(0, _xx(text) & 0xFFFFFFFF)] if text else [])


def _alike(a, b, x, y):
    coarse = max(_divisor(len(a)), _divisor(len(b)))

    def keyed(found):
        seen, keys = Counter(), {}
        for p, h in found:
            if h % coarse == 0:
                seen[h] += 1
                keys[h, seen[h]] = p
        return keys

    one, other = keyed(x), keyed(y)
    if not one and not other:
        return 1.0 if x == y else 0.0
    last, n = -1, 0
    for _, p in sorted((p, other[k]) for k, p in one.items() if k in other):
        n, last = n + (p > last), p
    return n / (len(one) + len(other) - n)


def test_fingerprints_and_likeness_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PART", 700)
    passage = prose(5, 300)
    words = passage.split()
    texts = [passage, " ".join(words[150:] + words[:150]), passage + " " + passage, passage[:400], "short text", "abcdefgh", "é\U0001f600" * 40, "", "x" * 3000, prose(6, 2000), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in syncmers.fingerprint_pairs(docs).collect()}
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        following = plain[(i + 1) % len(plain)]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        written = lambda t: " ".join(f"{a:08x}:{p}" for p, a in _print(t))
        assert got[i].fingerprint == written(text) and got[i].edited_fingerprint == written(edited)
        assert got[i].near_edited == pytest.approx(_alike(text, edited, _print(text), _print(edited)))
        assert got[i].near_next == pytest.approx(_alike(text, following, _print(text), _print(following)))
    assert got[0].near_next < 1, "the same passages in another order"
    assert got[1].near_next < 0.6, "a passage and the same passage twice"


def _alike_by_all(a, b):
    def keyed(found):
        seen, keys = Counter(), {}
        for p, h in found:
            seen[h] += 1
            keys[h, seen[h]] = p
        return keys

    one, other = keyed(a), keyed(b)
    last, n = -1, 0
    for _, p in sorted((p, other[k]) for k, p in one.items() if k in other):
        n, last = n + (p > last), p
    return n / (len(one) + len(other) - n)


def test_whole_fingerprints_have_every_anchor_and_exact_likeness(spark, tmp_path, monkeypatch):
    """What op4 returns: all closed syncmers, not a share of them."""
    monkeypatch.setattr(syncmers, "PART", 700)
    passage = prose(5, 300)
    words = passage.split()
    texts = [passage, " ".join(words[150:] + words[:150]), f"{passage} {passage}", passage[:400], "short text", "abcdefgh", "é\U0001f600" * 40, "", "x" * 3000, "ab" * 900 + passage, prose(6, 900), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op4_syncmers"](spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    whole = lambda t: _all_anchors(t) or ([(0, _xx(t) & 0xFFFFFFFF)] if t else [])
    written = lambda t: " ".join(f"{a:08x}:{p}" for p, a in whole(t))
    for i, text in enumerate(plain):
        following = plain[(i + 1) % len(plain)]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i].fingerprint == written(text) and got[i].edited_fingerprint == written(edited)
        if text or following:
            assert got[i].near_edited == pytest.approx(_alike_by_all(whole(text), whole(edited)) if text else 1.0)
            assert got[i].near_next == pytest.approx(_alike_by_all(whole(text), whole(following)))
    assert len(got[0].fingerprint.split()) > 300


def test_whole_fingerprints_of_long_texts(spark):
    """One word over and over: 40,000 occurrences of an anchor are matched without comparing all pairs."""
    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of a long text, "), F.lit(40_000)).alias("text"))
    first, _ = syncmers.fingerprint_pairs(rows, share=False).collect()
    assert first.near_next == 1.0 and len(first.fingerprint.split()) > 200_000


def test_likeness_estimates_the_common_anchors(spark):
    """Error of the likeness against all anchors of texts that share a beginning."""
    errors = []
    rows = [(n, prose(n, 400, 10**6)) for n in range(40)]
    for r in syncmers.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.doc_id][1]
        one, other = ({a for _, a in _all_anchors(t)} for t in (text, r.edited_text))
        errors.append(r.near_edited - len(one & other) / len(one | other))
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_a_long_text_fits_small_memory(spark):
    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of a long text, "), F.lit(40_000)).alias("text"))
    first, _ = syncmers.fingerprint_pairs(rows).collect()
    assert first.n_chars == 1_080_000 and first.near_next == 1.0


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    got = syncmers.fingerprint_pairs(odd_docs(spark)).select("edited_text", "edited_fingerprint")
    again = got.withColumn("_s", syncmers.fingerprint("edited_text")).withColumn("again", syncmers.as_text("_s"))
    assert again.filter("again <> edited_fingerprint").count() == 0


def test_anchors_are_context_free(spark):
    passage = prose(5, 40)
    docs = spark.createDataFrame([(1, passage), (2, "x" * 50 + passage)], "doc_id long, text string")
    found = {(r.doc_id, r.position, r.anchor) for r in syncmers.anchors(docs).collect()}
    first = {(p, a) for d, p, a in found if d == 1}
    second = {(p - 50, a) for d, p, a in found if d == 2 and p >= 50}
    assert first and first == second
