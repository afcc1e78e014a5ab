"""The corpus pipeline against brute force, stage by stage and as a whole."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamtables.llm import language_id, mixing, queries
from streamtables.llm.queries import default_tokenizer
from tests.llm.test_minmax import _edited, _expected
from tests.llm.test_models import PARTS, _text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, `a.b` string"


def _corpus():
    rng = random.Random(12)
    texts = [(_text(rng, lang, 60), lang) for lang in PARTS for _ in range(30)]
    base = list(texts)
    for text, lang in base[::6]:
        texts += [(text, lang), (text, lang)]  # exact copies
        texts += [(_edited(text, edits, rng), lang) for edits in (1, 2)]  # similar by 0.8 or more, or not
    texts += [(None, "aa"), ("", None), ("12 + 34 = 46", "bb"), ("щы" * 300, None)]
    rng.shuffle(texts)
    sources = ["wide", "wide", "wide", "rare", None]
    return [(i, t, lang, sources[i % 5], None if t is None else len(t), i, "x") for i, (t, lang) in enumerate(texts)]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def _known(spark, rows):
    """The stage's rule, judged text by text on the driver."""
    docs = spark.createDataFrame(rows, SCHEMA)
    models = language_id.train(docs.filter(~queries.held_out(4, 2)).select("doc_id", "text", "lang"))
    return [r for r in rows if not models.predict(r[1])[2]]


def _one_per_text(rows):
    last = {}
    for r in sorted(rows, key=lambda r: r[0]):
        last[r[1] or ""] = r
    return sorted(last.values())


def _one_per_group(rows):
    least = {i for i, _, component in _expected(rows, 5, 80) if i == component}
    return [r for r in rows if r[0] in least]


def test_stages_and_run_equal_brute_force(spark, folder):
    rows = _corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources", "packing"]
    row = lambda df: sorted(tuple(r) for r in df.collect())

    known = _known(spark, rows)
    assert 0 < len(known) < len(rows)
    out = stages["language ID"](spark, docs, folder)
    assert out.columns == docs.columns and row(out) == sorted(known)

    single = _one_per_text(known)
    assert len(single) < len(known)
    out = stages["exact dedup"](spark, spark.createDataFrame(known, SCHEMA), folder)
    assert row(out) == single

    apart = _one_per_group(single)
    assert len(apart) < len(single)
    out = stages["SimHash near-dedup"](spark, spark.createDataFrame(single, SCHEMA), folder)
    assert out.columns == docs.columns and row(out) == sorted(apart)

    mixed = stages["mixing sources"](spark, spark.createDataFrame(apart, SCHEMA), folder)
    copies = Counter(r[0] for r in mixed.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in apart:
        sizes[r[3]] += len(r[1].split())
        taken[r[3]] += len(r[1].split()) * copies[r[0]]
    targets = mixing.capped_targets(sizes, mixing.repeating_weights(list(sizes)), 3)
    longest = max(len(r[1].split()) for r in apart)
    assert set(copies) <= {r[0] for r in apart} and max(copies.values()) <= 3
    assert all(abs(taken[s] - targets[s]) <= 2 * longest for s in sizes), (taken, targets)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    final = corpus_pipeline.run(spark, folder).collect()
    text = {r[0]: r[1] for r in rows}
    ids = {d: [*tokenizer.encode(text[d], add_special_tokens=False).ids, 0] for d in copies}
    pieces = defaultdict(Counter)
    for r in final:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.doc_tokens == len(ids[r.doc_id]) and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        pieces[r.doc_id][r.start, r.length] += 1
    assert set(pieces) == set(copies)
    for d, found in pieces.items():
        assert set(found.values()) == {copies[d]} and sum(n for _, n in found) == len(ids[d])
    assert len({r.sequence_id for r in final}) == len(final)


def test_no_documents(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_every_registered_query_covers_its_table(spark, sf_dir):
    """Each query runs as it is registered and has a row for each document (or more)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    whole = {name: f for name, f in queries.QUERIES.items() if name not in ("op10_format_chat", "op11_prefix_trie", "op12_hard_negatives")}
    for name, query in whole.items():
        found = query(spark, sf_dir)
        assert found.select("doc_id").distinct().count() == docs, name
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert queries.op10_format_chat(spark, sf_dir).count() == convs + 1
    assert queries.op11_prefix_trie(spark, sf_dir).filter("depth = 0").first().n_convs == convs
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = queries.op12_hard_negatives(spark, sf_dir)
    assert found.select("anchor_id").distinct().count() <= vectors.filter(F.col("vec_id") % 50 == 0).count()
