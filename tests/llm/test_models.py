from __future__ import annotations

import random

import numpy as np
import pytest

from streamtables.llm import language_id, quality
from tests.llm.fixtures import no_docs, odd_docs, odd_rows

PARTS = {
    "aa": ["the", "and", "ing", "her", "tion", "ly", "of"],
    "bb": ["der", "ung", "ein", "sch", "lich", "zu", "ß"],
    "cc": ["que", "eau", "les", "ment", "ç", "oi", "ê"],
}


def _text(rng, language, words):
    return " ".join("".join(rng.choices(PARTS[language], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def models():
    rng = random.Random(4)
    return language_id.build({k: [_text(rng, k, 30) for _ in range(40)] for k in PARTS})


def test_languages_of_unseen_texts(models):
    rng = random.Random(5)
    for language in PARTS:
        for words in (6, 40, 2000):
            name, score, rejected = models.predict(_text(rng, language, words))
            assert name == language and 0.5 < score <= 1 and not rejected


def test_what_is_not_a_language(models):
    assert models.predict(None) == models.predict("") == models.predict("12 + 3!") == ("und", 0.0, True)
    name, _, rejected = models.predict("щы" * 400)
    assert name in PARTS and rejected
    assert models.predict("\U0001f600 the")[0] in PARTS


def test_probabilities_sum_to_one(models):
    """After any context, the probabilities of all letters of a language add up to about one."""
    letters = sorted({c for parts in PARTS.values() for p in parts for c in p})
    points = np.array([0] + [ord(c) for c in letters], dtype=np.uint32)
    for context in ("the", "ung", "xyz"):
        total = np.zeros(3)
        for p in points:
            row = np.array([0, *map(ord, context), p], dtype=np.uint32)
            gram = language_id._hashes(row, 4)
            level = models._level(4, gram, language_id._contexts(gram), slice(len(gram[3]) - 1, len(gram[3])))
            total += np.exp(level[0])
        assert (total <= 1.0001).all() and (total > 0.8).all()


def test_long_texts_are_scored_whole(models):
    rng = random.Random(6)
    text = _text(rng, "aa", 60_000) + " " + _text(rng, "bb", 200_000)
    assert models.predict(text)[0] == "bb"


def test_identify_keeps_odd_rows(spark, models):
    rows = language_id.identify(odd_docs(spark), models).collect()
    assert sorted(r._row for r in rows) == list(range(len(odd_rows())))
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    assert language_id.identify(no_docs(spark), models).count() == 0


def test_no_training_texts(spark):
    empty = language_id.train(no_docs(spark))
    assert [r.lang_pred for r in language_id.identify(odd_docs(spark), empty).collect()] == ["und"] * len(odd_rows())


def test_held_out_language_accuracy(spark, sf_dir):
    from streamtables.llm.queries import op9_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = op9_language_id(spark, sf_dir).filter("held_out").join(docs, "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_quality_separates_unseen_texts():
    rng = random.Random(7)
    good = [_text(rng, "aa", 80) for _ in range(120)]
    bad = [" | ".join(_text(rng, "bb", 1) for _ in range(80)) for _ in range(60)]
    model = quality.fit(good[:100], bad[:40])
    assert np.mean([model.score(t) for t in good[100:]]) > 0.8
    assert np.mean([model.score(t) for t in bad[40:]]) < 0.3
    assert 0 <= model.score(None) <= 1 and model.score(None) == model.score("")


def test_quality_without_labels(spark):
    model = quality.fit([], [])
    assert model.score("x") == 0.5 and quality.fit(["a", "b", "c"], []).score("x") == 1.0
    assert quality.score(odd_docs(spark), model).count() == len(odd_rows())
    assert quality.score(no_docs(spark), model).count() == 0


def test_held_out_quality(spark):
    from streamtables.llm.queries import op3_quality

    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = op3_quality(spark, sf_dir).filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_counting_in_parts_changes_nothing(monkeypatch):
    texts = {"a": ["the cat sat on the mat " * 3, "a dog and a cat"] * 9, "b": ["le chat est sur le tapis", "un chien"] * 9}
    whole = language_id.build(texts)
    monkeypatch.setattr(language_id, "COUNTED_AT_ONCE", 10)
    parts = language_id.build(texts)
    assert all((x == y).all() for x, y in zip(whole.log_p, parts.log_p, strict=True))
    assert whole.limits == parts.limits and whole.predict("the dog") == parts.predict("the dog")


def test_training_texts_of_one_letter():
    assert language_id.build({"a": ["a"], "b": ["b"]}).predict("a")[0] == "a"


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")


def test_long_texts_are_learned_from(spark):
    rng = random.Random(9)
    rows = [(i, _text(rng, k, 6000), k, 0) for i, k in enumerate(["aa", "bb"] * 10)]
    assert min(len(r[1]) for r in rows) > language_id.SAMPLE_CHARS
    docs = _labelled(spark, rows)
    models = language_id.train(docs)
    named = language_id.identify(docs, models).collect()
    assert all(r.lang_pred == r.lang for r in named)
    texts = language_id.sample(docs, "lang", 4, 500)
    whole = {k: [t for _, t, l, _ in rows if l == k] for k in ("aa", "bb")}
    assert {k: len(v) for k, v in texts.items()} == {"aa": 4, "bb": 4}
    assert all(len(t) == 500 and any(t in w for w in whole[k]) for k, v in texts.items() for t in v)
    scored = quality.score(docs, quality.fit(["good text"] * 4, ["bad"] * 4))
    assert scored.columns == ["doc_id", "text", "lang", "a.b", "score", "predicted"] and scored.count() == 20


def test_sample_is_the_smallest_hashes_of_each_label(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 90}", ["x", "y", None][i % 3], 0) for i in range(270)]
    docs = _labelled(spark, rows).repartition(5)
    texts = language_id.sample(docs, "lang", 7, 100)
    hashed = docs.withColumn("h", F.xxhash64(F.lit(11), "text")).collect()
    for label in ("x", "y"):
        expected = [t for _, t in sorted({(r.h, r.text) for r in hashed if r.lang == label})][:7]
        assert texts[label] == expected
    assert set(texts) == {"x", "y"}


def test_rare_quality_label_is_sampled_in_full(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, "aa", 20), 1) for i in range(900)] + [(1000 + i, _text(rng, "bb", 20), 0) for i in range(30)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(labelled, per_label=100)
    assert model.prior == pytest.approx(900 / 930)
    assert np.mean([model.score(t) for _, t, q in rows if q == 0]) < 0.5 < np.mean([model.score(t) for _, t, q in rows if q == 1])


def test_entropy_equals_kneser_ney_by_counting():
    """Interpolated Kneser-Ney worked out with dictionaries of strings."""
    import math
    from collections import Counter, defaultdict

    order, texts = 3, ["abab ca", "abba bac", "baab", "aaba c b", "cab"]
    models = language_id.build({"x": texts}, order=order)
    shown = [f" {t} " for t in texts]
    grams = {n: Counter(t[i : i + n] for t in shown for i in range(len(t) - n + 1)) for n in range(1, order + 1)}
    alphabet = 1 + len(grams[1])
    p, backoff = {0: {"": 1.0 / alphabet}}, {}
    for n in range(1, order + 1):
        if n == order:
            count = dict(grams[n])
        else:
            before = Counter(g[1:] for g in grams[n + 1])
            count = {g: before.get(g, 1) for g in grams[n]}
        once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
        discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in count.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        backoff[n] = {c: discount * kinds[c] / total[c] for c in total}
        lower = (lambda g: 1.0 / alphabet) if n == 1 else (lambda g, n=n: p[n - 1][g[1:]])
        p[n] = {g: max(c - discount, 0) / total[g[:-1]] + backoff[n][g[:-1]] * lower(g) for g, c in count.items()}

    def log_p(gram):
        n = len(gram)
        if n == 0:
            return math.log(1.0 / (alphabet + 1000))
        if gram in p[n]:
            return math.log(p[n][gram])
        return log_p(gram[1:]) + math.log(backoff[n].get(gram[:-1], 1.0))

    for text in [*texts, "cc bb aa", "abcabc", "zz a", "b"]:
        shown_text = f" {text} "
        scored = [log_p(shown_text[max(0, i - order + 1) : i + 1]) for i in range(1, len(shown_text))]
        entropy, count = models.entropy(text)
        assert count == len(scored) and entropy[0] == pytest.approx(-sum(scored) / len(scored), abs=1e-9), text


def test_quality_fit_solves_its_equations():
    """Sizes are those of plain zstandard; the weighted likelihood has no slope left."""
    import zstandard

    rng = random.Random(8)
    good = [_text(rng, "aa", 40) for _ in range(30)]
    bad = [_text(rng, "bb", 40) for _ in range(20)]
    model = quality.fit(good, bad, share=0.9)
    rows, labels = [], []
    for text, label in [(t, 1) for t in good[1::2]] + [(t, 0) for t in bad[1::2]]:
        sizes = []
        for content in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            tool = zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False, write_dict_id=False)
            sizes.append(len(tool.compress(text.encode())))
        difference = sizes[1] - sizes[0]
        rows.append([difference / len(text.encode()), difference / sum(sizes)])
        labels.append(label)
    x, y = np.array(rows), np.array(labels)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6)
    a = np.hstack([np.ones((len(z), 1)), z])
    w = np.array(model.weights)
    p = 1 / (1 + np.exp(-(a @ w)))
    weight = np.where(y == 1, 0.9 / y.mean(), 0.1 / (1 - y.mean()))
    assert np.abs(a.T @ (weight * (y - p)) - 0.1 * w).max() < 1e-6
    assert [model.score(t) for t in good[1::2]] == pytest.approx(p[: len(good[1::2])].tolist(), abs=1e-6)
