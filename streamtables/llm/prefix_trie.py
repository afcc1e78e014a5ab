"""The prefix trie of conversations, by fixed-length block hashing.

Turns are cut into blocks of fixed length and each block is digested. Conversations are grouped
by their successive block digests first. Where all conversations of a group go on with the same
block, the nodes inside it have the group's members and are read off one of them; where a
conversation is alone in its group, the rest of its nodes are its own. Only in blocks where
siblings diverge (or one of them ends) are turns looked at, to find the boundary.

A prefix is named by its depth and 128 bits: the exclusive or of its turns' digests, each mixed
with its position. Names of neighbouring prefixes follow from each other in either direction,
and parts of a long conversation can be digested apart, so no conversation has to fit one task.

Sums over subtrees need no walk through the tree: every node belongs to its smallest member, so
a sum over the nodes below one is a sum over its members of what they own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtables.llm.common import NULL_ID, id_key, settle, whole_text
from streamtables.operators.ordered import Slot
from streamtables.operators.ranking import rank_rows

#: Turns in a block.
BLOCK = 4
#: Blocks (or values of ``turn``) of one conversation that are put in order at once.
CHUNK = 1024
#: Characters of joined ids in one row.
JOINED = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

_KEY = ["_depth", "_z1", "_z2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(``_conv``, ``_pos``, ``_d1``, ``_d2``, ``_bytes``): the digested turns in order, from 1.

    The order is that of ``turn``, a null one first; turns of one number follow the MD5 of their
    role and text. A null role or text is empty; a null ``conv_id`` is a conversation of its own.
    """
    role, text = whole_text("role"), whole_text("text")
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        id_key("conv_id").alias("_conv"), turn.alias("_turn"), said.alias("_said"), F.octet_length(text).cast("long").alias("_bytes")
    )
    order = [F.col("_turn").asc_nulls_first(), F.col("_said").asc()]
    ranked = rank_rows(rows, ["_conv"], order, "_pos", Slot(F.floor(F.col("_turn") / CHUNK)))
    half = lambda at: F.conv(F.substring("_said", at, 15), 16, 10).cast("long")
    return ranked.select("_conv", F.col("_pos").cast("long"), half(1).alias("_d1"), half(16).alias("_d2"), "_bytes")


def borrowed_starts(turns: DataFrame, base: Column, count: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of another, and all conversations.

    ``base`` and ``count`` are functions of ``_conv``; ``count`` is at most ``longest``. The first
    ``count`` turns of ``base`` (all if fewer, none if there is no such conversation) are followed by
    a conversation's own turns after its first ``count``. A null ``conv_id`` keeps its own turns.
    """
    own = turns.groupBy("_conv").agg(F.count("*").alias("_n"))
    known = F.col("_conv") != NULL_ID
    own = own.withColumns({"_base": F.when(known, base), "_take": F.when(known, count).otherwise(0)})
    lent = own.select(F.col("_conv").alias("_base"), F.col("_n").alias("_there"))
    convs = own.join(lent, "_base", "left").select("_conv", "_base", "_take", F.least("_take", F.coalesce("_there", F.lit(0))).alias("_got"))
    convs = settle(convs, "conversations")
    heads = turns.filter(F.col("_pos") <= longest).withColumnRenamed("_conv", "_base")
    first = convs.filter("_got > 0").join(heads, "_base").filter("_pos <= _got").select(*turns.columns)
    rest = turns.join(convs, "_conv").filter("_pos > _take").withColumn("_pos", F.col("_pos") - F.col("_take") + F.col("_got"))
    return settle(first.unionByName(rest.select(*turns.columns)), "turns"), convs.select("_conv")


def _xor(column: str) -> Column:
    return F.bit_xor(column)


def _before(blocks: DataFrame) -> DataFrame:
    """Adds what a conversation's earlier blocks come to: ``_b1``, ``_b2`` (digests) and ``_pre`` (bytes)."""
    chunked = blocks.withColumn("_chunk", F.floor(F.col("_block") / CHUNK))
    take = {"1": lambda c: _xor(f"{c}1"), "2": lambda c: _xor(f"{c}2"), "b": lambda c: F.sum(f"{c}b")}
    sums = chunked.groupBy("_conv", "_chunk").agg(*[f("_x").alias(f"_c{k}") for k, f in take.items()])
    earlier = Window.partitionBy("_conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_conv", "_chunk", *[f("_c").over(earlier).alias(f"_e{k}") for k, f in take.items()])
    inside = Window.partitionBy("_conv", "_chunk").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    joined = chunked.join(sums, ["_conv", "_chunk"])
    joined = joined.withColumns({f"_i{k}": F.coalesce(f("_x").over(inside), F.lit(0)) for k, f in take.items()})
    earlier = {k: F.coalesce(F.col(f"_e{k}"), F.lit(0)) for k in take}
    return joined.select(
        *blocks.columns,
        F.col("_i1").bitwiseXOR(earlier["1"]).alias("_b1"),
        F.col("_i2").bitwiseXOR(earlier["2"]).alias("_b2"),
        (F.col("_ib") + earlier["b"]).alias("_pre"),
    )


def _blocks(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Every block with its digest and that of what is before it; a conversation that ends with a full block has an empty one more."""
    made = turns.groupBy("_conv", "_block").agg(
        _xor("_z1").alias("_x1"), _xor("_z2").alias("_x2"), F.sum("_bytes").alias("_xb"), F.count("*").alias("_len")
    )
    last = made.groupBy("_conv").agg(F.max("_block").alias("_last"), F.max_by("_len", "_block").alias("_len"))
    empty = convs.join(last, "_conv", "left").filter(F.coalesce("_len", F.lit(block)) == block)
    zero = [F.lit(0).cast("long").alias(c) for c in ("_x1", "_x2", "_xb", "_len")]
    empty = empty.select("_conv", (F.coalesce("_last", F.lit(-1)) + 1).alias("_block"), *zero)
    return settle(_before(made.unionByName(empty)), "blocks")


def _ends(blocks: DataFrame, block: int) -> DataFrame:
    """(key, ``_ends``): SHA-256 of the ids of the conversations that end at a node.

    Ids are put in order over all tasks and joined to long strings, so the task that a node with
    very many ends falls to reads few rows.
    """
    ending = blocks.filter(F.col("_len") < block).select(
        (F.col("_block") * block + F.col("_len")).alias("_depth"),
        F.col("_b1").bitwiseXOR(F.col("_x1")).alias("_z1"),
        F.col("_b2").bitwiseXOR(F.col("_x2")).alias("_z2"),
        "_conv",
    )
    ending = ending.filter(F.col("_conv") != NULL_ID)
    joined_schema = pa.schema([*[(c, pa.int64()) for c in (*_KEY, "_conv")], ("_ids", pa.string())])
    hashed_schema = pa.schema([*[(c, pa.int64()) for c in _KEY], ("_ends", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def written(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, first, ids, size = [], None, None, [], 0
        for *at, conv in rows(batches):
            if ids and (at != key or size > JOINED):
                out.append((*key, first, ",".join(ids)))
                ids, size = [], 0
                if len(out) >= 1000:
                    yield written(joined_schema, out)
                    out = []
            if not ids:
                key, first = at, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if ids:
            yield written(joined_schema, [*out, (*key, first, ",".join(ids))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, state = [], None, None
        for *at, _, ids in rows(batches):
            if at != key:
                if key:
                    out.append((*key, state.hexdigest()))
                    if len(out) >= 1000:
                        yield written(hashed_schema, out)
                        out = []
                key, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if key:
            yield written(hashed_schema, [*out, (*key, state.hexdigest())])

    longs = "_depth long, _z1 long, _z2 long"
    ordered = ending.repartitionByRange(*_KEY, "_conv").sortWithinPartitions(*_KEY, "_conv")
    joined = ordered.mapInArrow(join_ids, f"{longs}, _conv long, _ids string")
    return joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "_conv").mapInArrow(digest, f"{longs}, _ends string")


def prefix_nodes(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node: every distinct sequence of first turns of a conversation, the empty one too.

    ``turns`` has ``_conv``, ``_pos`` (from 1, without gaps), ``_d1``, ``_d2`` (digest of the turn)
    and ``_bytes``; ``conversations`` has every ``_conv`` once, turnless ones too. Returns

    - ``conv_id``, the smallest member (a null id is the smallest), and ``depth``, which name a node;
    - ``parent_conv_id``; null for the root;
    - ``n_convs``, ``n_children`` and ``n_leaves``, the childless nodes of the subtree;
    - ``saved_tokens``: bytes that one copy of each turn saves in the subtree;
    - ``ends_sha256``, of the members without further turns; a null id is not among them.

    Without conversations there are no nodes.
    """
    position = F.col("_pos")
    digested = turns.select(
        "_conv",
        "_pos",
        F.floor((position - 1) / block).alias("_block"),
        "_bytes",
        F.xxhash64("_pos", "_d1", "_d2").alias("_z1"),
        F.xxhash64(F.lit("second"), "_pos", "_d1", "_d2").alias("_z2"),
    )
    blocks = _blocks(digested, conversations, block)
    start = ["_block", "_b1", "_b2"]
    full = F.min("_len") == block
    groups = blocks.groupBy(*start).agg(
        F.count("*").alias("_n"),
        F.min("_conv").alias("_first"),
        (full & (F.min("_x1") == F.max("_x1")) & (F.min("_x2") == F.max("_x2"))).alias("_closed"),
    )
    placed = settle(blocks.join(groups, start), "placed-blocks")

    # The turns that make nodes, with the prefix before and after each.
    wanted = placed.filter("_n = 1 or not _closed or _conv = _first")
    wanted = wanted.select("_conv", "_block", "_b1", "_b2", "_pre", "_n", ((F.col("_n") > 1) & ~F.col("_closed")).alias("_open"))
    inside = Window.partitionBy("_conv", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    z1 = _xor("_z1").over(inside).bitwiseXOR(F.col("_b1"))
    z2 = _xor("_z2").over(inside).bitwiseXOR(F.col("_b2"))
    # Where sums over the members are found: at the node itself, or where its closed block starts.
    at_start = (F.col("_n") > 1) & ~F.col("_open")
    steps = digested.join(wanted, ["_conv", "_block"]).select(
        "_conv",
        "_open",
        "_n",
        "_bytes",
        F.col("_pos").alias("_depth"),
        z1.alias("_z1"),
        z2.alias("_z2"),
        z1.bitwiseXOR(F.col("_z1")).alias("_p1"),
        z2.bitwiseXOR(F.col("_z2")).alias("_p2"),
        (F.sum("_bytes").over(inside) - F.col("_bytes") + F.col("_pre")).alias("_pre"),
        F.when(at_start, F.col("_block") * block).otherwise(F.col("_pos")).alias("_s"),
        F.when(at_start, F.col("_b1")).otherwise(z1).alias("_s1"),
        F.when(at_start, F.col("_b2")).otherwise(z2).alias("_s2"),
        (F.col("_open") | (F.pmod(position - 1, F.lit(block)) == 0)).alias("_ask"),
    )
    steps = settle(steps, "steps")
    detail = ["_bytes", "_pre", "_p1", "_p2", "_s", "_s1", "_s2", "_ask"]
    refined = steps.filter("_open").groupBy(*_KEY).agg(
        F.min("_conv").alias("_conv"), F.count("*").alias("_n"), *[F.first(c).alias(c) for c in detail]
    )
    zero = F.lit(0).cast("long")
    root = placed.filter("_block = 0").agg(F.min("_conv").alias("_conv"), F.count("*").alias("_n")).filter("_n > 0")
    root = root.select(
        *[zero.alias(c) for c in _KEY],
        "_conv",
        "_n",
        *[F.lit(False).alias(c) if c == "_ask" else zero.alias(c) for c in detail],
    )
    same = steps.filter("not _open").select(*_KEY, "_conv", "_n", *detail)
    nodes = settle(same.unionByName(refined).unionByName(root), "nodes")

    # Parents: the same conversation's, unless others may have left it there.
    parents = nodes.select(
        (F.col("_depth") + 1).alias("_depth"), F.col("_z1").alias("_p1"), F.col("_z2").alias("_p2"), F.col("_conv").alias("_parent")
    )
    asked = nodes.filter("_ask").join(parents, ["_depth", "_p1", "_p2"])
    told = nodes.filter("not _ask").withColumn("_parent", F.when(F.col("_depth") > 0, F.col("_conv")))
    family = settle(told.unionByName(asked), "family")
    children = family.filter("_depth > 0").groupBy(F.col("_parent").alias("_conv"), (F.col("_depth") - 1).alias("_depth"))
    family = family.join(children.agg(F.count("*").alias("_children")), ["_conv", "_depth"], "left")
    family = settle(family.withColumn("_children", F.coalesce("_children", zero)), "children")

    owned = family.groupBy("_conv").agg(
        F.sum("_bytes").alias("_own"), F.max((F.col("_children") == 0).cast("long")).alias("_leaf")
    )
    total = blocks.groupBy("_conv").agg(F.sum("_xb").alias("_total"))
    each = total.join(owned, "_conv", "left").na.fill(0, ["_own", "_leaf"])
    members = placed.filter("_n > 1").select((F.col("_block") * block).alias("_s"), F.col("_b1").alias("_s1"), F.col("_b2").alias("_s2"), "_conv")
    turning = steps.filter(F.col("_open") & (F.pmod("_depth", F.lit(block)) != 0))
    members = members.unionByName(turning.select(F.col("_depth").alias("_s"), F.col("_z1").alias("_s1"), F.col("_z2").alias("_s2"), "_conv"))
    each = settle(each, "members")
    sums = members.join(each, "_conv").groupBy("_s", "_s1", "_s2")
    sums = sums.agg(F.sum("_total").alias("_totals"), F.sum("_own").alias("_owns"), F.sum("_leaf").alias("_leaves"))
    shared = family.filter("_n > 1").join(sums, ["_s", "_s1", "_s2"]).join(each, "_conv")
    saved = (
        F.col("_totals") - F.col("_n") * F.col("_pre") - (F.col("_owns") - F.col("_own")) - (F.col("_total") - F.col("_pre"))
    )
    columns = [*_KEY, "_conv", "_parent", "_n", "_children"]
    summed = shared.select(*columns, "_leaves", saved.alias("_saved"))
    alone = family.filter("_n = 1").select(*columns, F.lit(1).cast("long").alias("_leaves"), zero.alias("_saved"))
    result = summed.unionByName(alone).join(_ends(blocks, block), _KEY, "left")
    return result.select(
        F.nullif("_conv", F.lit(NULL_ID)).alias("conv_id"),
        F.col("_depth").alias("depth"),
        F.nullif("_parent", F.lit(NULL_ID)).alias("parent_conv_id"),
        F.col("_n").alias("n_convs"),
        F.col("_children").alias("n_children"),
        F.col("_leaves").alias("n_leaves"),
        F.col("_saved").alias("saved_tokens"),
        F.coalesce("_ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
