"""A corpus pipeline: language, exact copies, near copies, source mix, packed sequences.

Each stage gets the documents that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtables.llm import block_names, language_id, minmax_dedup, mixing, packing, simhash_dedup
from streamtables.llm.queries import default_tokenizer, held_out
from streamtables.session import run_dir

#: Near copies: words in a shingle, shared shingles in a hundred, values in a band of hashes.
SHINGLE, PERCENT, BAND_VALUES = 5, 80, 6


def own_columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; the others go.

    The models learn from the labelled documents of the stage's own input.
    """
    models = language_id.train(docs.filter(~held_out(4, 2)).select("doc_id", "text", "lang"))
    judged = language_id.identify(docs, models)
    return judged.filter(~F.col("rejected")).select(*own_columns(docs))


def one_per_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, the one with the largest id."""
    return block_names.keep_one_row(docs)


def one_per_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies share at least 0.8 of their five-word shingles. Components of SimHash
    fingerprints of such shingles are candidates; copies of that similarity differ in up to 18 of
    64 bits, beyond what fuzzy keys can find, so bands of min-max hashes give the others. Every
    link is confirmed on the full sets.
    """
    texts = docs.select("doc_id", "text")
    marked = texts.withColumn("text_hash", F.xxhash64("text"))
    fingerprints = simhash_dedup.dedup_near(marked, shingle=SHINGLE)
    groups = minmax_dedup.similar_groups(texts, SHINGLE, PERCENT, BAND_VALUES, fingerprints)
    return minmax_dedup.one_per_group(docs, groups)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times."""
    taken, _, _ = mixing.mix(docs, F.array("source"))
    copies = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return copies.select(*own_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the mix; every copy of a document is packed."""
    pieces = packing.pack(docs, default_tokenizer())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_per_text),
    ("SimHash near-dedup", one_per_component),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: Language models, shingles and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        path = f"{run_dir(spark, f'pipeline-{number}')}/rows"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
