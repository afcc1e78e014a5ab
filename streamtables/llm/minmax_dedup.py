"""Near-duplicates by min-max hashing.

A permutation of a text's shingles gives two values, its smallest and its largest hash. Both
agree between two texts with a probability equal to their Jaccard similarity, so a signature of
n values takes n / 2 hash evaluations, and as the two lean against each other its estimate has a
lower variance than n minima would have. A band is a few of these pairs; texts that agree in all values
of a band are candidates, and every link is confirmed on the full sets.

No bucket is compared in pairs. Each has a *centre*, the member with most company in all its
buckets, and all members are compared with it; together they are the centre's *canopy*. What the
links so found leave apart is compared by the differences from the centre: of two sets, the
symmetric difference is that of their differences from a third, so two members can only be alike
if their differences share one of their rarest shingles (a prefix filter), and if the parities of
their hashes (an odd sketch, which never exceeds the symmetric difference) allow it. Both
filters are exact: a pair that shares a band is linked if it is similar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtables.llm.common import NULL_ID, by_batches, id_key, mix64, settle
from streamtables.llm.simhash_dedup import components

SHINGLE = 3
#: Shared shingles in a hundred of all that two linked texts have.
PERCENT = 85
#: Chance that a pair of exactly that similarity shares no band.
MISS = 1e-6
#: Bits of an odd sketch.
SKETCH = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 10


@dataclass(frozen=True)
class Bands:
    """How many values a band has (half minima, half maxima), and as many bands as ``MISS`` needs."""

    percent: int = PERCENT
    values: int = 8

    @property
    def count(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.values)))

    @property
    def permutations(self) -> int:
        return self.count * self.values // 2


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def _folded(values: np.ndarray) -> np.ndarray:
    """One hash for each row of hashes, in order."""
    folded = np.zeros(len(values), dtype=np.uint64)
    for column in values.T:
        folded = mix64(folded * _STEP + column)
    return folded


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle, none has none."""
    words = text.encode().lower().split() if text else []  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, 42) for w in words], dtype=np.uint64)
    return np.unique(_folded(np.lib.stride_tricks.sliding_window_view(hashes, min(length, len(words)))))


def extremes(found: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest hash under each permutation, of one evaluation each."""
    xors, factors = _permutations(permutations)
    least = np.full(permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
    most = np.zeros(permutations, dtype=np.uint64)
    for at in range(0, len(found), _AT_ONCE):
        values = (found[at : at + _AT_ONCE, None] ^ xors) * factors
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    return least, most


def band_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """A key for each band, of the minima and maxima of its own permutations."""
    least, most = (x.reshape(bands.count, -1) for x in extremes(found, bands.permutations))
    return mix64(_folded(np.hstack([least, most])) + np.arange(bands.count, dtype=np.uint64)).view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """For each value of eight bits of the hashes, whether an odd number of shingles has it."""
    counts = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


_SKETCH_COLUMNS = [f"_odd{i}" for i in range(SKETCH // 64)]
_MARKS = "_id long, _text long, _hi long, _lo long, _n int, _keys array<long>, " + ", ".join(f"{c} long" for c in _SKETCH_COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """(``_id``, ``_text``, ``text``): rows that repeat a ``doc_id`` are told apart by their text's hash."""
    return docs.select(id_key().alias("_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("string"))


def _marked(docs: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """Every row with the name of its set of shingles (128 bits), its size, band keys and sketch."""

    def step(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("_hi", "_lo", "_n", "_keys", *_SKETCH_COLUMNS)}
        for text in batch.column(2):
            found = shingles(text.as_py(), shingle)
            name = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=">i8").tolist()
            row = (*name, len(found), band_keys(found, bands), *odd_sketch(found).tolist())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return {"_id": batch.column(0), "_text": batch.column(1), **out}

    return by_batches(_rows(docs), _MARKS, step)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(``_node``, ``_set``) of the nodes ``wanted``, whose ``_id`` and ``_text`` name a row."""

    def step(batch: pa.RecordBatch):
        return {"_node": batch.column(0), "_set": [shingles(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]}

    texts = _rows(docs).join(wanted.select("_id", "_text", "_node"), ["_id", "_text"]).select("_node", "text")
    return by_batches(texts, "_node long, _set array<long>", step).dropDuplicates(["_node"])


def _alike(difference: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of ``a`` and ``b`` elements, of which so many are in one only, are similar enough."""
    return difference * (100 + percent) <= (a + b) * (100 - percent)


def _sketches_differ(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _SKETCH_COLUMNS]
    return sum(bits[1:], bits[0])


def _possible(a: str, b: str, percent: int) -> Column:
    """What sizes and sketches say: a necessary condition."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & _alike(_sketches_differ(a, b), n, m, percent)


def _side(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("_node", *columns)])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a_node``, ``b_node``) whose full sets are similar enough."""
    both = pairs.select("a_node", "b_node").join(_side(sets, "a", "_set"), "a_node").join(_side(sets, "b", "_set"), "b_node")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    difference = F.size("a_set") + F.size("b_set") - 2 * shared
    return both.filter(_alike(difference, F.size("a_set"), F.size("b_set"), percent)).select("a_node", "b_node")


def _canopies(nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(``a_node``, ``b_node``): each centre with every node that shares a bucket it is the centre of."""
    keyed = nodes.select("_node", F.explode("_keys").alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_size")).filter("_size > 1")
    members = keyed.join(sizes, "_key")
    if groups is not None:
        members = members.unionByName(groups.select("_node", F.col("_group").alias("_key"), "_size"))
    members = settle(members, "bands")
    company = members.groupBy("_node").agg(F.sum("_size").alias("_company"))
    centre = F.max_by("_node", F.struct("_company", "_node")).alias("a_node")
    centres = members.join(company, "_node").groupBy("_key").agg(centre)
    pairs = members.join(centres, "_key").select("a_node", F.col("_node").alias("b_node"))
    return settle(pairs.filter("a_node != b_node").distinct(), "canopies")


def _apart(canopies: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of canopies that are in several components, with their ``_root`` and whether it is another than the centre's."""
    own = F.coalesce("b_root", "b_node").alias("_root")
    main = F.coalesce("a_root", "a_node")
    rooted = canopies.join(_side(roots, "b", "_root"), "b_node", "left").join(_side(roots, "a", "_root"), "a_node", "left")
    rooted = rooted.select("a_node", "b_node", own, (own != main).alias("_apart"))
    several = rooted.groupBy("a_node").agg(F.count("*").alias("_members"), F.max("_apart").alias("_any"))
    return rooted.join(several.filter("_any and _members > 1").select("a_node"), "a_node")


def _others(canopies: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that their differences from a centre leave possible."""
    sized = _side(nodes, "b", "_n", *_SKETCH_COLUMNS)
    members = _apart(canopies, roots).join(_side(sets, "a", "_set"), "a_node").join(_side(sets, "b", "_set"), "b_node")
    difference = F.concat(F.array_except("a_set", "b_set"), F.array_except("b_set", "a_set"))
    members = settle(members.select("a_node", "b_node", "_root", "_apart", difference.alias("_difference")), "differences")
    shingle = members.select("a_node", "b_node", F.explode("_difference").alias("_shingle"))
    common = shingle.groupBy("a_node", "_shingle").agg(F.count("*").alias("_in")).filter("_in > 1")
    ranked = shingle.join(common, ["a_node", "_shingle"]).groupBy("a_node", "b_node")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("_in", "_shingle"))).alias("_common"))
    rows = members.select("a_node", "b_node", "_root", "_apart", F.size("_difference").alias("_d"))
    rows = rows.join(ranked, ["a_node", "b_node"]).join(sized, "b_node")
    # How many shingles of its difference a member shares at least with one it is similar to. That
    # one is not linked to the centre directly, unless the member itself is apart.
    d, n = F.col("_d"), F.col("b_n")
    near = F.floor(d * percent / (100 + percent)).cast("int") + 1
    far = F.greatest(F.lit(1), F.ceil(d - n * (100 - percent) / percent - 1e-9).cast("int"))
    prefix = d - F.when(F.col("_apart"), far).otherwise(near) + 1
    # Shingles of a single member come first in the order and meet no other.
    take = F.greatest(F.lit(0), prefix - (d - F.size("_common")))
    rare = F.explode(F.transform(F.slice("_common", F.lit(1), take), lambda s: s["_shingle"])).alias("_shingle")
    keys = ["a_node", "b_node", "_root", "_apart", "_d", "b_n", *[f"b{c}" for c in _SKETCH_COLUMNS]]
    prefixes = settle(rows.select(*keys, rare), "prefixes")
    a = prefixes.filter("_apart").select(
        *[F.col(c).alias(f"x{c[1:]}" if c.startswith("b_") else f"x{c}" if c != "a_node" else "x_centre") for c in (*keys, "_shingle")]
    )
    b = prefixes.select(
        *[F.col(c).alias(f"y{c[1:]}" if c.startswith("b_") else f"y{c}" if c != "a_node" else "y_centre") for c in (*keys, "_shingle")]
    )
    meet = (F.col("x_centre") == F.col("y_centre")) & (F.col("x_shingle") == F.col("y_shingle"))
    once = ~F.col("y_apart") | (F.col("x_node") < F.col("y_node"))
    fits = _alike(F.abs(F.col("x_d") - F.col("y_d")), F.col("x_n"), F.col("y_n"), percent)
    pairs = a.join(b, meet & (F.col("x_root") != F.col("y_root")) & once & fits & _possible("x", "y", percent))
    return pairs.select(F.col("x_node").alias("a_node"), F.col("y_node").alias("b_node")).distinct()


def links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, groups: DataFrame | None = None) -> DataFrame:
    """Pairs (``_a``, ``_b``) of nodes that connect all similar nodes which share a band or a group."""
    canopies = _canopies(nodes, groups)
    both = canopies.select(F.col("a_node").alias("_node")).union(canopies.select("b_node")).distinct()
    sets = settle(_sets(docs, nodes.join(both, "_node"), shingle), "shingles")
    sized = ("_n", *_SKETCH_COLUMNS)
    stars = canopies.join(_side(nodes, "a", *sized), "a_node").join(_side(nodes, "b", *sized), "b_node")
    starred = settle(_confirmed(stars.filter(_possible("a", "b", percent)), sets, percent), "star-links")
    as_edges = lambda pairs: pairs.select(F.col("a_node").alias("_a"), F.col("b_node").alias("_b"))
    roots = settle(components(as_edges(starred)), "star-roots")
    others = _confirmed(settle(_others(canopies, nodes, sets, roots, percent), "possible-pairs"), sets, percent)
    return settle(as_edges(starred.unionByName(others)), "links")


def similar_groups(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, values: int = 8, groups: DataFrame | None = None
) -> DataFrame:
    """(``_id``, ``_text``, ``_n``, ``_group``, ``_component``) of every row of ``docs`` (``doc_id``, ``text``).

    ``_text`` is the XXHASH64 of the text, ``_group`` a number of the component (null without
    shingles), ``_component`` its smallest id. ``groups`` (``doc_id``, ``text_hash``,
    ``component_id``) names further candidates: rows of one component are compared too.
    """
    bands = Bands(percent, values)
    marked = settle(_marked(docs.select("doc_id", "text"), shingle, bands), "min-max")
    alike = marked.filter("_n > 0").groupBy("_hi", "_lo").agg(
        F.min(F.struct("_id", "_text")).alias("_first"),
        *[F.first(c).alias(c) for c in ("_n", "_keys", *_SKETCH_COLUMNS)],
    )
    named = alike.select(F.monotonically_increasing_id().alias("_node"), "_first.*", "*").drop("_first")
    nodes = settle(named, "shingle-sets")
    own = marked.select("_id", "_text", "_n", "_hi", "_lo").join(nodes.select("_hi", "_lo", "_node"), ["_hi", "_lo"], "left")
    further = None
    if groups is not None:
        grouped = groups.select(id_key().alias("_id"), F.col("text_hash").alias("_text"), id_key("component_id").alias("_group"))
        grouped = own.filter("_node is not null").join(grouped, ["_id", "_text"]).select("_node", "_group").distinct()
        sizes = grouped.groupBy("_group").agg(F.count("*").alias("_size")).filter("_size > 1")
        # Their keys are hashes, so as not to be those of bands.
        further = grouped.join(sizes, "_group").withColumn("_group", F.xxhash64(F.lit("group"), "_group"))
    edges = links(docs, nodes, shingle, percent, further)
    rooted = settle(components(edges), "roots")
    placed = nodes.select("_node", "_id").join(rooted, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    classes = placed.join(placed.groupBy("_root").agg(F.min("_id").alias("_component")), "_root")
    result = own.join(classes.select("_node", F.col("_root").alias("_group"), "_component"), "_node", "left")
    return result.select("_id", "_text", "_n", "_group", F.coalesce("_component", "_id").alias("_component"))


def one_per_group(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``similar_groups`` the row with the smallest ``doc_id``.

    Of rows that share this id one text stays, too; a row that repeats id and text is the same
    document. Rows without shingles stay.
    """
    least = found.filter("_n > 0").groupBy("_group").agg(F.min(F.struct("_id", "_text")).alias("_first")).select("_first.*")
    kept = least.unionByName(found.filter("_n = 0").select("_id", "_text")).distinct().alias("kept")
    own = docs.alias("docs")
    same = (id_key("docs.doc_id") == F.col("kept._id")) & (F.xxhash64("docs.text") == F.col("kept._text"))
    return own.join(kept, same, "left_semi").select(*[F.col(f"docs.`{c}`") for c in docs.columns])


def dedup_similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, values: int = 8) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked if they share at least ``percent`` of a hundred of all their
    distinct shingles; ``component_id`` is the smallest ``doc_id`` that links reach, and the
    document that has it is kept. Letter case of A-Z does not count. A null or wordless text has
    no shingle and is linked with nothing; one of fewer words than a shingle is one shingle. A
    null ``doc_id`` is the smallest. Rows that repeat a ``doc_id`` are rows of their own with their
    own links; those that are in the component of that id are kept together.
    """
    found = similar_groups(docs, shingle, percent, values)
    doc, component = (F.nullif(c, F.lit(NULL_ID)) for c in ("_id", "_component"))
    return found.select(
        doc.alias("doc_id"),
        F.col("_n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("_id") == F.col("_component")).alias("kept"),
    )
