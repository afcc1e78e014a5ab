"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get the same integer name,
different blocks different names, by sorting the distinct blocks. Then names of adjacent pairs
are named in the same way, level by level, until one name per document is left. Names come from
sorted contents, never from hashes alone, so identities cannot collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtables.llm.common import NULL_ID, boxed, id_key, settle, unboxed, whole_text

#: Bytes of a block. Most documents are one block, so most need one level.
BLOCK_BYTES = 4096


def _numbered(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Integers for distinct rows: sorted inside each hash partition, then numbered on."""
    return distinct.sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def name_texts(
    texts: DataFrame, block_bytes: int = BLOCK_BYTES, route: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per distinct (``_id``, ``_sha``) of ``texts`` with its identity (``_level``, ``_name``).

    ``texts`` has ``_id``, ``_sha`` and ``_text``. ``route`` is a number by which blocks find
    their names without travelling themselves. Where blocks of different content share that
    number, their rows are named by the content.
    """
    cut = F.expr(f"transform(sequence(0, greatest(0, (octet_length(_text) - 1) div {block_bytes})), i -> cast(i as int))")
    blocks = texts.select("_id", "_sha", F.encode("_text", "UTF-8").alias("_bytes"), F.explode(cut).alias("_i"))
    blocks = blocks.select(
        "_id", "_sha", "_i", F.expr(f"substring(_bytes, _i * {block_bytes} + 1, {block_bytes})").alias("_block")
    ).withColumn("_h", route(F.col("_block")))
    distinct = _numbered(blocks.select("_h", "_block").distinct(), ["_h", "_block"], "_name")
    names = settle(distinct.select("_h", "_name"), "block-names")
    per_number = names.groupBy("_h").agg(F.min("_name").alias("_name"), F.count("*").alias("_n"))
    # The rows of blocks, without the blocks; repeated rows of a document are one.
    rows = settle(blocks.groupBy("_id", "_sha", "_i", "_h").agg(F.lit(1).alias("_one")).drop("_one"), "block-rows")
    plain = rows.join(per_number.filter("_n = 1"), "_h").select("_id", "_sha", "_i", "_name")
    level = plain
    if per_number.filter("_n > 1").limit(1).count():
        contested = per_number.filter("_n > 1").select("_h")
        content = settle(
            _numbered(blocks.join(contested, "_h", "left_semi").select("_block").distinct(), ["_block"], "_name"),
            "block-contents",
        )
        # Names below zero, so that they differ from those of the other blocks.
        hard = blocks.join(contested, "_h", "left_semi").join(content, "_block")
        level = plain.unionByName(hard.select("_id", "_sha", "_i", (-F.col("_name") - 1).alias("_name")).distinct())
    return _pair_up(settle(level, "names-0"))


def _pair_up(level: DataFrame) -> DataFrame:
    """Name adjacent pairs until each document has one name; the level counts the pairings."""
    done, depth = [], 0
    while True:
        ordered = level.groupBy("_id", "_sha").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_i", "_name"))), lambda x: x["_name"]).alias("_names")
        )
        single = ordered.filter(F.size("_names") == 1)
        done.append(single.select("_id", "_sha", F.lit(depth).alias("_level"), F.col("_names")[0].alias("_name")))
        # The last of an odd number of names is paired with nothing.
        pairs = ordered.filter(F.size("_names") > 1).select(
            "_id",
            "_sha",
            F.explode(
                F.expr(
                    "transform(sequence(0, (size(_names) - 1) div 2), i -> struct(i as _i, _names[2 * i] as _a,"
                    " get(_names, 2 * i + 1) as _b))"
                )
            ).alias("_pair"),
        )
        pairs = settle(pairs.select("_id", "_sha", "_pair.*"), f"pairs-{depth}")
        if pairs.limit(1).count() == 0:
            break
        names = settle(_numbered(pairs.select("_a", "_b").distinct(), ["_a", "_b"], "_name"), f"pair-names-{depth}")
        match = (F.col("p._a") == F.col("n._a")) & F.col("p._b").eqNullSafe(F.col("n._b"))
        level = pairs.alias("p").join(names.alias("n"), match).select("_id", "_sha", "_i", "_name")
        depth += 1
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    return named


def dedup_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Groups of identical texts; the row with the largest ``doc_id`` stays.

    Returns the columns of ``docs`` (``text`` unchanged) with ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``; columns of ``docs`` with these names are replaced. A null text
    counts as empty. A null ``doc_id`` is smaller than all others. Rows that repeat both
    ``doc_id`` and text each count in ``group_size`` and share one verdict, as nothing tells
    them apart; ``keep_one_row`` removes repeats.
    """
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(
        boxed(own), id_key().alias("_id"), F.sha2(whole_text(), 256).alias("_sha"), whole_text().alias("_text")
    )
    named = settle(name_texts(rows.select("_id", "_sha", "_text"), block_bytes, route), "identities")
    counted = rows.groupBy("_id", "_sha").agg(F.count("*").alias("_rows"))
    groups = (
        named.join(counted, ["_id", "_sha"])
        .groupBy("_level", "_name")
        .agg(F.max("_id").alias("_keep"), F.sum("_rows").alias("group_size"), F.count("*").alias("_members"))
    )
    several = groups.filter("_members > 1 or group_size > 1")
    verdicts = named.join(several, ["_level", "_name"]).select("_id", "_sha", "_keep", "group_size")
    judged = rows.drop("_text").join(verdicts, ["_id", "_sha"], "left")
    keep = F.coalesce("_keep", "_id")
    return judged.select(
        *unboxed(own),
        F.nullif(keep, F.lit(NULL_ID)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep == F.col("_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one_row(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` for one row per text: the one with the largest ``doc_id``.

    Of rows that repeat that ``doc_id`` with the same text one stays, chosen by a hash of the
    whole row.
    """
    marked = docs.select("doc_id", "text", boxed(docs.columns))
    kept = dedup_exact(marked, block_bytes).filter("kept")
    single = kept.filter("group_size = 1").select(*unboxed(docs.columns))
    several = kept.filter("group_size > 1")
    ties = several.groupBy("text_sha256", "doc_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return single.unionByName(ties.select(*unboxed(docs.columns)))
