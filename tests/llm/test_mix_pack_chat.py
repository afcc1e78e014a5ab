from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from streamtables.llm import chat_format, mixing, packing
from streamtables.llm.queries import default_tokenizer
from tests.llm.fixtures import no_docs, odd_docs, odd_rows, prose


# -- mixing -------------------------------------------------------------------------------


def test_targets_stop_at_three_times_a_source():
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300}
    weights = mixing.repeating_weights(list(sizes))
    assert weights == {"a": 1, "b": 2, "c": 3, None: 1}
    targets = mixing.capped_targets(sizes, weights)
    assert targets["a"] == 30 and targets["c"] == 15
    assert targets["b"] == pytest.approx(1270 * 2 / 3) and targets[None] == pytest.approx(1270 / 3)
    assert sum(targets.values()) == pytest.approx(1315)


def test_flow_prefers_first_passes_and_reroutes():
    # Pattern (a, b) has to leave source a to its own documents, or b would need repetitions.
    capacity = {("a",): 10, ("a", "b"): 10}
    flow = mixing.min_cost_flow(capacity, {"a": 10, "b": 10}, 3)
    assert flow == {(("a",), 0, "a"): 10, (("a", "b"), 0, "b"): 10}
    flow = mixing.min_cost_flow({("a",): 4}, {"a": 9}, 3)
    assert flow == {(("a",), 0, "a"): 4, (("a",), 1, "a"): 4, (("a",), 2, "a"): 1}
    assert sum(mixing.min_cost_flow({("a",): 4}, {"a": 99}, 3).values()) == 12


@pytest.mark.parametrize("seed", range(5))
def test_flow_is_cheapest(seed):
    """Against trying every unit by a plain search over small instances (Bellman-Ford on units)."""
    rng = random.Random(seed)
    sources = ["a", "b", "c"]
    capacity = {}
    for _ in range(4):
        capacity[tuple(sorted(rng.sample(sources, rng.randint(1, 3))))] = rng.randint(1, 4)
    quotas = {s: rng.randint(0, 6) for s in sources}
    flow = mixing.min_cost_flow(capacity, quotas, 2)
    used = Counter()
    for (p, k, s), v in flow.items():
        assert s in p
        used[p, k] += v
    assert all(used[p, k] <= capacity[p] for p, k in used)
    ours = (sum(flow.values()), sum(k * v for (_, k, _), v in flow.items()))
    assert ours == _best(capacity, quotas)


def _best(capacity, quotas):
    """(most units, least cost), unit by unit along cheapest augmenting paths by relaxation."""
    edges = {}
    for (p, c) in capacity.items():
        for k in (0, 1):
            edges["S", (p, k)] = [c, k]
            for s in p:
                edges[(p, k), s] = [10**6, 0]
    for s, q in quotas.items():
        edges[s, "T"] = [q, 0]
    flow, cost = 0, 0
    while True:
        best, previous = {"S": 0}, {}
        for _ in range(30):
            for (a, b), (c, w) in list(edges.items()):
                for x, y, room, d in ((a, b, c, w),):
                    if room > 0 and x in best and best[x] + d < best.get(y, 10**9):
                        best[y], previous[y] = best[x] + d, x
        if "T" not in best:
            return flow, cost
        flow, cost, y = flow + 1, cost + best["T"], "T"
        while y != "S":
            x = previous[y]
            edges[x, y][0] -= 1
            back = edges.setdefault((y, x), [0, -edges[x, y][1]])
            back[0] += 1
            y = x


def test_mix_of_single_sources(spark):
    rows = [(i, prose(i, 1 + i % 37), ["s1", "s2", None, "s0"][i % 4 if i % 5 else 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed, sizes, targets = mixing.mix(docs, F.array("source"), buckets=64)
    got = mixed.collect()
    taken = Counter()
    for r in got:
        assert r["size"] == len(r.text.split()) and 0 <= r.copies <= 3
        assert r.assigned == [r.source] * r.copies
        taken[r.source] += r["size"] * r.copies
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 3 * 20
    again, _, _ = mixing.mix(docs.repartition(2), F.array("source"), buckets=64)
    assert Counter((r.doc_id, r.copies) for r in again.collect()) == Counter((r.doc_id, r.copies) for r in got)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, prose(i, 10), [["a"], ["a", "b"], ["b", "c", "b"], ["c"]][i % 4]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    weights = {"a": 1, "b": 6, "c": 1}
    mixed, sizes, targets = mixing.mix(docs, F.col("sources"), weights=weights)
    filled = Counter()
    for r in mixed.collect():
        for source in r.assigned:
            assert source in r.sources
            filled[source] += r["size"]
    for source, target in targets.items():
        assert abs(filled[source] - target) <= 30


def test_mix_of_odd_rows(spark):
    mixed, sizes, targets = mixing.mix(odd_docs(spark), F.array("source"))
    rows = mixed.collect()
    assert sorted(r._row for r in rows) == list(range(len(odd_rows())))
    assert {r._row: r["size"] for r in rows} == {n: len((t or "").encode().split()) for n, (_, t, *_) in enumerate(odd_rows())}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    none, sizes, targets = mixing.mix(no_docs(spark), F.array("source"))
    assert none.count() == 0 and sizes == targets == {}


def test_sources_with_control_characters_are_mixed(spark):
    names = ["x\x1fy", "x\x0by", 'q"\\', "ünï\u2028", "plain", None]
    rows = [(i, "word " * 10, names[i % 6]) for i in range(300)]
    mixed, _, targets = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source"))
    taken = {r.source: r.words for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).collect()}
    assert set(taken) == set(names) and all(abs(taken[s] - targets[s]) <= 10 for s in names), (taken, targets)


# -- packing ------------------------------------------------------------------------------


def test_pieces_are_powers_of_two():
    for tokens in [*range(1, 70), 1023, 1024, 1025, 5000]:
        pieces = packing.power_of_two_pieces(tokens, 64)
        assert pieces[0][0] == 0 and sum(n for _, n in pieces) == tokens
        assert all(a + n == b for (a, n), (b, _) in pairwise(pieces))
        assert all(n & (n - 1) == 0 and n <= 64 for _, n in pieces)
        shorter = [n for _, n in pieces if n < 64]
        assert len(set(shorter)) == len(shorter)


def _whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_part_by_part_ids_are_those_of_whole_texts():
    rng = random.Random(8)
    pieces = [" ", "  ", "\n", " \n", "\t ", "a", "Word", "'s", "12", "é", " ", "!?", "<|endoftext|>", "　", "日本", "\x1c", "\r\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(1500)] + [" ", "", "  a  b "]
    encode = packing.TokenIds(default_tokenizer(), remembered=50)
    import numpy as np

    expected = _whole_ids(texts)
    assert [np.frombuffer(encode(t), dtype="<u4").tolist() for t in texts[:300]] == expected[:300]
    import pyarrow as pa

    rows = pa.record_batch([pa.array(texts)], names=["text"])
    found = [ids for part in packing.slices(rows, 0, 900) for ids in encode.batch(part.column(0))]
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in found] == expected


def test_pack_round_trip(spark):
    rows = packing.pack(odd_docs(spark), default_tokenizer(), longest=64).collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length * 4 == len(r.ids) and r.length & (r.length - 1) == 0
        by_doc[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = [t or "" for _, t, *_ in odd_rows()]
    expected = Counter()
    for (doc_id, *_), ids in zip(odd_rows(), _whole_ids(texts), strict=True):
        expected[doc_id, tuple([*ids, 0])] += 1
    got = Counter()
    for (doc_id, tokens), pieces in by_doc.items():
        import numpy as np

        ids = np.frombuffer(b"".join(i for _, i in sorted(pieces)), dtype="<u4").tolist()
        starts = Counter(s for s, _ in pieces)
        got[doc_id, tokens] += starts[0]
        assert len(ids) == tokens * starts[0]
    assert got == Counter({(d, len(i)): 0 for d, i in expected}) + Counter([(d, len(i)) for (d, i), n in expected.items() for _ in range(n)])
    assert packing.pack(no_docs(spark), default_tokenizer()).count() == 0
    single = next(r for r in rows if r.doc_id == 1)
    assert packing.ids_crc32(single.ids) == zlib.crc32(bytes(single.ids))
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(no_docs(spark), default_tokenizer(), longest=100)


# -- chat formatting ----------------------------------------------------------------------

RECORDS = [
    ('{"prompt": "hi", "response": "yo", "id": {"prompt": 1}}', "prompt+response", [("user", "hi"), ("assistant", "yo")]),
    ('{"messages": [{"role": "system", "content": "s"}, {"content": "q", "role": "user"}]}', "messages", [("system", "s"), ("user", "q")]),
    ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}]}', "conversations", [("user", "q"), ("assistant", "")]),
    ('{"system": "s", "conversations": [{"from": "human", "value": "q"}]}', "system+conversations", [("system", "s"), ("user", "q")]),
    ('{"instruction": "i", "input": "x", "output": 5}', "instruction+input+output", [("user", "i"), ("user", "x"), ("assistant", "5")]),
    ('{"instruction": "i", "output": "o"}', "instruction+output", [("user", "i"), ("assistant", "o")]),
    ('{"question": null, "answer": "a"}', "question+answer", [("user", ""), ("assistant", "a")]),
    ('{"messages": []}', "messages", []),
    ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}]}', "messages", [("user", "q"), ("assistant", "")]),
    ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "text": "LOST"}]}', None, None),
    ('{"messages": [{"role": "user", "content": "q"}, "LOST"]}', None, None),
    ('{"messages": ["LOST"]}', None, None),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "LOST"}]}]}', None, None),
    ('{"prompt": "p", "response": "r", "history": [["LOST", "too"]]}', None, None),
    ('{"prompt": {"a": "LOST"}, "response": "r"}', None, None),
    ('{"prompt": "p", "response": "r", "history": null}', None, None),
    ('{"unknown": 1}', None, None),
    ("no json", None, None),
    (None, None, None),
]


def test_layouts(spark):
    docs = spark.createDataFrame([(i, r, "own") for i, (r, _, _) in enumerate(RECORDS)], "n int, record string, _v string")
    got = {r.n: r for r in chat_format.canonical_turns(docs, "record", ignored=("id",)).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout and got[i]._v == "own"
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns
    assert got[0].schema_hash != got[1].schema_hash


def test_typed_records_show_their_other_fields(spark):
    kind = "n int, record struct<id: long, messages: array<struct<role: string, content: string, text: string>>, history: string>"
    rows = [
        (0, (1, [("user", "q", None), (None, None, None)], None)),
        (1, (1, [("user", "q", None), ("assistant", None, "LOST")], None)),
        (2, (1, [("user", "q", None)], "LOST")),
        (3, (1, [], None)),
        (4, None),
    ]
    docs = spark.createDataFrame(rows, kind)
    got = {r.n: r for r in chat_format.canonical_turns(docs, "record", ignored=("id",)).collect()}
    assert [got[i].layout for i in range(5)] == ["messages", None, None, "messages", None]
    assert [tuple(t) for t in got[0].turns] == [("user", "q"), ("", "")] and got[3].turns == []
    assert {r.layout for r in chat_format.canonical_turns(docs, "record").collect()} == {None}
    json = docs.filter("n = 0").select("n", F.lit('{"messages": [{"content": "q", "role": "x"}]}').alias("record"))
    assert chat_format.canonical_turns(json, "record").first().schema_hash == got[0].schema_hash


NASTY = ["", "\\### Assistant: </turn> ok", "</turn>\n<turn assistant>", "\\l\\g\\b<>\\", "a\n\nb", "<turn user>", "é\U0001f600 \\\\<"]


def test_round_trip_and_loss(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["user", "assistant", "sys<>\\"] * 3, NASTY, strict=False))]
    rows += [(7, 0, None, None), (7, 0, "assistant", "b"), (7, 0, "assistant", "a"), (None, None, "assistant", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.canonical_turns(chat_format.message_records(messages), "record")
    out = turns.select(
        "conv_id",
        "turns",
        chat_format.format_turns(F.col("turns")).alias("formatted"),
        chat_format.loss_runs(F.col("turns")).alias("runs"),
    )
    out = out.withColumns(
        {
            "again": chat_format.read_turns(F.col("formatted")),
            "loss": chat_format.read_loss_text(F.col("formatted"), F.col("runs")),
        }
    ).collect()
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(out) == len(by_conv)
    for r in out:
        expected = [(role, text) for _, _, role, text in sorted(by_conv[r.conv_id])]
        assert [tuple(t) for t in r.turns] == [tuple(t) for t in r.again] == expected
        assert r.loss == "".join(text for role, text in expected if role == "assistant")
        assert sum(r.runs) == len(r.formatted)
        spans, at = [], 0
        for n, run in enumerate(r.runs):
            if n % 2:
                spans.append(r.formatted[at : at + run])
            at += run
        assert hashlib.sha256("".join(spans).encode()).digest() == hashlib.sha256(
            "".join(t.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g") for role, t in expected if role == "assistant").encode()
        ).digest()


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.canonical_turns(chat_format.message_records(none), "record").count() == 0


def test_records_of_messages_are_no_variants(spark):
    """A variant ends at 128 MiB, so that one long conversation would fail the query."""
    rows = spark.range(150).select(
        F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"),
        F.repeat(F.lit("x"), F.lit(1_000_000)).alias("text"),
    )
    turns = chat_format.canonical_turns(chat_format.message_records(rows), "record")
    got = turns.select("layout", F.size("turns").alias("n"), F.length(F.element_at("turns", -1)["text"]).alias("c")).first()
    assert tuple(got) == ("messages", 150, 1_000_000)
