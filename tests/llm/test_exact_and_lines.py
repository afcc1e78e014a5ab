from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from streamtables.llm import block_names, line_dedup
from tests.llm.fixtures import no_docs, odd_docs, odd_rows

LEAST = -(2**63)


def _expected_groups():
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        groups[text or ""].append(LEAST if doc_id is None else doc_id)
    return groups


@pytest.mark.parametrize("route", [F.xxhash64, lambda block: F.length(block).cast("long") % 3])
def test_exact_groups_with_and_without_colliding_routes(spark, route):
    judged = block_names.dedup_exact(odd_docs(spark), block_bytes=16, route=route)
    groups, rows = _expected_groups(), judged.collect()
    assert len(rows) == len(odd_rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        keep = max(ids)
        assert r.keep_id == (None if keep == LEAST else keep)
        assert r.group_size == len(ids)
        assert r.kept == (keep == (LEAST if r.doc_id is None else r.doc_id))
        assert r._id.startswith("id") and r._row is not None  # the row's own columns are unchanged


def test_one_row_per_text_stays(spark):
    rows = block_names.keep_one_row(odd_docs(spark)).collect()
    assert Counter(r.text or "" for r in rows) == Counter(set(_expected_groups()))


def test_identities_do_not_depend_on_where_blocks_end(spark):
    texts = ["ab" * 8, "ab" * 9, "a" * 16 + "b" * 16, "b" * 16 + "a" * 16, "a" * 16, "a" * 32, "a" * 48]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert block_names.dedup_exact(docs, block_bytes=16).filter("kept").count() == len(texts)


def test_lines(spark):
    rows = odd_rows()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(LEAST if doc_id is None else doc_id)
    expected = Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        own = LEAST if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == own]
        expected[(doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = line_dedup.dedup_lines(odd_docs(spark)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected
    assert sum(r.n_dropped for r in got) == 6


def test_empty_tables(spark):
    docs = no_docs(spark)
    assert block_names.dedup_exact(docs).count() == 0
    assert block_names.keep_one_row(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
