"""The registered queries of this package: each operator over its whole table.

The operators return texts, pieces and turns; the queries derive the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtables.llm import (
    block_names,
    chat_format,
    hard_negatives,
    language_id,
    line_dedup,
    minmax_dedup,
    mixing,
    packing,
    prefix_trie,
    quality,
    simhash_dedup,
    substring_dedup,
    syncmers,
)
from streamtables.llm.common import table
from streamtables.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(parts: int, held: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


@query
def op1_substring_dedup(spark, sf_dir):
    cleaned = substring_dedup.dedup_substrings(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op2_exact_dedup(spark, sf_dir):
    judged = block_names.dedup_exact(documents(spark, sf_dir))
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op3_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(labels, docs=docs.filter(~held_out(5, 0)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


@query
def op4_syncmers(spark, sf_dir):
    pairs = syncmers.fingerprint_pairs(documents(spark, sf_dir), share=False)
    edited = F.sha2("edited_text", 256).alias("edited_sha256")
    return pairs.select(
        "doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query
def op5_line_dedup(spark, sf_dir):
    cleaned = line_dedup.dedup_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_simhash_dedup(spark, sf_dir):
    return simhash_dedup.dedup_near(documents(spark, sf_dir))


@query
def op7_mix_sources(spark, sf_dir):
    docs = documents(spark, sf_dir, "source")
    mixed, sizes, targets = mixing.mix(docs, F.array("source"))
    rows = [(s, sizes[s], float(targets[s])) for s in sizes]
    # One row per source; mix() has checked how many there are.
    known = F.broadcast(spark.createDataFrame(rows, "_source string, source_size long, target double"))
    joined = mixed.join(known, F.col("source").eqNullSafe(F.col("_source")))
    taken = (F.col("size") * F.col("copies")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query
def op8_pack(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir), default_tokenizer())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query
def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir, "lang")
    models = language_id.train(docs.filter(~held_out(4, 2)))
    named = language_id.identify(docs.select("doc_id", "text"), models)
    return named.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


CHECK_TEXT = r"\### Assistant: </turn> ok"


@query
def op10_format_chat(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    records = chat_format.message_records(conversations)
    pair = F.struct(F.lit(CHECK_TEXT).alias("prompt"), F.lit(CHECK_TEXT).alias("response"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_variant_object(pair).alias("record"))
    both = [chat_format.canonical_turns(r, "record").select("conv_id", "turns") for r in (records, extra)]
    turns = both[0].unionByName(both[1])
    written = turns.select(
        "conv_id", chat_format.format_turns(F.col("turns")).alias("formatted"), chat_format.loss_runs(F.col("turns")).alias("runs")
    )
    read = written.select(
        "conv_id",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss_text(F.col("formatted"), F.col("runs")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op11_prefix_trie(spark, sf_dir):
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("_conv")
    borrowed = F.crc32(conv.cast("string").cast("binary")) % 9
    rebuilt, everyone = prefix_trie.borrowed_starts(turns, conv - conv % 5, borrowed, 8)
    return prefix_trie.prefix_nodes(rebuilt, everyone)


@query
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    vectors = hard_negatives.integer_vectors(rows, "vector", 256)
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    vectors = vectors.withColumn("label", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query
def op13_minmax_dedup(spark, sf_dir):
    return minmax_dedup.dedup_similar(documents(spark, sf_dir))
