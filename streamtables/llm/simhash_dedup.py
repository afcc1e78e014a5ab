"""Near-duplicates by SimHash fingerprints, matched with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most two
bits, some segment has no error (pigeonhole), and every other segment has at most two, so it has
a near codeword in common. A key is therefore an exact segment with one codeword near the next
segment. Fingerprints that share a key are compared; links become connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtables.llm.common import NULL_ID, boxed, by_batches, id_key, settle, unboxed, words_of
from streamtables.llm.golay import near_codewords

BITS = 64
SHINGLE = 3
#: Differing bits of linked fingerprints; the keys find up to two.
ERRORS = 2
#: Lowest bit and number of bits of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys that more fingerprints share are matched by their neighbourhoods instead.
LARGEST_BUCKET = 64


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in more than half of the shingles' hashes (XXH64, seed 42)."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower changes A-Z only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(grams), 1 << 16):
        hashes = np.array([digest(g, 42) for g in grams[at : at + (1 << 16)]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams), bitorder="little").tobytes(), "little")


def _fingerprint(text: str, shingle: int) -> Column:
    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprint(text)


def fuzzy_keys(fingerprints: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, one row each: every choice of the exact segment and of near codewords.

    Two fingerprints within two bits share a key. It has 21 or 22 exact bits and a codeword of
    12; the third segment would multiply the keys by up to six and is left to the comparison.
    """
    x = fingerprints.astype(np.uint64)
    parts = [((x >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    keys = []
    for exact in range(3):
        fuzzy = near[(exact + 1) % 3]
        # Exact bits, codeword and the number of the exact segment side by side.
        keys.append((parts[exact][:, None] << 14) | (fuzzy << 2) | exact)
    return np.concatenate(keys, axis=1)


def _with_keys(distinct: DataFrame) -> DataFrame:
    """(``_key``, ``_fp``) for every fingerprint, repeated keys once."""

    def step(batch):
        fp = batch.column(0).to_numpy()
        keys = np.sort(fuzzy_keys(fp.view(np.uint64)), axis=1)
        first = np.ones(keys.shape, dtype=bool)
        first[:, 1:] = keys[:, 1:] != keys[:, :-1]
        return {"_key": keys[first], "_fp": np.repeat(fp, first.sum(axis=1))}

    return by_batches(distinct.select("_fp"), "_key long, _fp long", step)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, largest_bucket: int = LARGEST_BUCKET) -> DataFrame:
    """Pairs (``_a``, ``_b``) of different fingerprints that connect all that are within ERRORS bits.

    Buckets of up to ``largest_bucket`` fingerprints are joined with themselves and verified in
    the join. Fingerprints in a larger bucket are linked, exactly and without comparing pairs,
    through the words that differ from them in at most one bit: two fingerprints within two bits
    share such a word, all fingerprints at a word are within two bits of each other, and there
    are at most 65 of them.
    """
    keyed = _with_keys(distinct)
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    members = settle(keyed.join(counts, "_key"), "golay-keys")
    usual = members.filter(F.col("_n") <= largest_bucket).select("_key", "_fp")
    a, b = usual.alias("a"), usual.alias("b")
    near = _distance(F.col("a._fp"), F.col("b._fp")) <= ERRORS
    pairs = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a._fp") < F.col("b._fp")) & near)
    pairs = pairs.select(F.col("a._fp").alias("_a"), F.col("b._fp").alias("_b"))

    # A pair that shares only large buckets has both its fingerprints here.
    crowded = members.filter(F.col("_n") > largest_bucket).select("_fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    words = crowded.select("_fp", F.explode(flips).alias("_flip")).select(
        "_fp", F.col("_fp").bitwiseXOR(F.col("_flip")).alias("_word")
    )
    firsts = words.groupBy("_word").agg(F.min("_fp").alias("_a"), F.count("*").alias("_n")).filter("_n > 1")
    stars = words.join(firsts, "_word").filter(F.col("_a") < F.col("_fp")).select("_a", F.col("_fp").alias("_b"))
    return settle(pairs.unionByName(stars).distinct(), "links")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(``_node``, ``_root``) of every node of ``edges`` (``_a``, ``_b``): the smallest node it reaches.

    Large-star and small-star steps alternate until nothing changes; each is two aggregations
    over the edges, written to the shared folder.
    """
    current = settle(edges.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct(), "edges")
    state = None
    while True:
        # Large star: all larger neighbours of a node point to its smallest neighbour.
        both = current.unionByName(current.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.first("_u")).alias("_m"))
        large = both.join(least, "_u").filter(F.col("_v") > F.col("_u")).select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        large = settle(large.distinct(), "large-star")
        # Small star: a node and its smaller neighbours point to the smallest of these.
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        joined = large.join(least, "_u")
        small = joined.filter(F.col("_v") != F.col("_m")).select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        small = small.unionByName(least.select("_u", F.col("_m").alias("_v")))
        current = settle(small.distinct(), "small-star")
        # Unchanged edges are stars whose centres are the smallest nodes.
        new = current.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    leaves = current.select(F.col("_u").alias("_node"), F.col("_v").alias("_root"))
    roots = current.select(F.col("_v").alias("_node"), F.col("_v").alias("_root")).distinct()
    return leaves.unionByName(roots)


def dedup_near(docs: DataFrame, largest_bucket: int = LARGEST_BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of every document, by shingles of ``shingle`` words.

    Returns the columns of ``docs`` but ``text``, with ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest ``doc_id`` that links reach; columns of ``docs`` with these
    names are replaced. A text without words has fingerprint zero, linked like any other; one of
    fewer words than a shingle is one shingle. A null ``doc_id`` is the smallest. Rows that repeat a
    ``doc_id`` are rows of their own with their own fingerprints.
    """
    own = [c for c in docs.columns if c not in ("text", "fingerprint", "component_id")]
    marked = docs.select(boxed(own), _fingerprint("text", shingle).alias("_fp"), id_key().alias("_id"))
    marked = settle(marked, "fingerprints")
    distinct = settle(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    rooted = settle(components(links(distinct, largest_bucket)), "roots")
    placed = distinct.join(rooted, F.col("_fp") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = placed.groupBy("_root").agg(F.min("_least").alias("_component"))
    classes = placed.join(least, "_root").select("_fp", "_component")
    result = marked.join(classes, "_fp")
    return result.select(
        *unboxed(own),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.nullif("_component", F.lit(NULL_ID)).alias("component_id"),
    )
