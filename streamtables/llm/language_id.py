"""Language identification with interpolated Kneser-Ney character models.

For each language, n-gram counts of a bounded training sample are smoothed by interpolated
Kneser-Ney. All languages share one sorted array of n-gram hashes per order, with a column of
log probabilities for each language, so a text is scored for all languages by one search per
character and order. The language with the lowest cross-entropy per character wins; scores and
rejection are calibrated on a part of the sample that the models have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtables.llm.common import boxed, mix64, unboxed
from streamtables.operators.ranking import top_k

ORDER = 4
UNDETERMINED = "und"
#: Training texts of each language; fewer if there are not as many. A sixth calibrates.
SAMPLE_DOCS = 1200
#: Of a longer text the training sample has a slice of so many characters, at a place that its hash gives (it is scored whole like all others).
SAMPLE_CHARS = 20_000
#: Parts in which the smallest hashes of a label are found before they meet.
SAMPLE_PARTS = 64
#: Labels a sample may have.
MOST_LABELS = 1000
#: Characters whose n-grams are held before they are added to the counts.
COUNTED_AT_ONCE = 200_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _letter(point: int) -> int:
    """The code point in lower case, or 0 if it is no letter."""
    char = chr(point)
    return ord(char.lower()[0]) if char.isalpha() else 0


@cache
def _letters() -> np.ndarray:
    return np.array([_letter(p) for p in range(0x10000)], dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    """Letters in lower case; whatever stands between two words is one 0, and so are both ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = _letters()[np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        for p in np.unique(raw[raw > 0xFFFF]):
            points[raw == p] = _letter(int(p))
    padded = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    return padded[keep]


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 … ``order``: hash of the n-gram that ends at each position (for i >= n - 1)."""
    x = mix64(points.astype(np.uint64) + np.uint64(1))
    grams, current = [x], x
    for n in range(2, order + 1):
        # The gram of n ending at i: the gram of n - 1 ending at i, and the character before it.
        shifted = x[: len(x) - n + 1] * np.uint64(pow(_MULTIPLIER, n - 1, 1 << 64))
        current = current[1:] + shifted
        # Sums of mixed characters are spread already; the top bits are made to depend on all.
        grams.append((current ^ (current >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53))
    return grams


def _contexts(grams: list[np.ndarray]) -> list[np.ndarray]:
    """For n = 1 …: hash of the n - 1 characters before each position."""
    none = np.zeros(len(grams[0]), dtype=np.uint64)
    return [none, *[g[:-1] for g in grams[:-1]]]


class Keys:
    """A sorted array of hashes. As hashes are spread evenly, the top bits tell where to look."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = min(20, max(1, len(hashes).bit_length() + 1))
        tops = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange(1 << self.bits)).astype(np.int32)
        self.probes = int(np.bincount(tops, minlength=1).max())
        self.padded = np.append(hashes, np.uint64(2**64 - 1))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the array, and whether the hash is there."""
        place = self.start[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)]
        for _ in range(self.probes):
            place = place + (self.padded[place] < wanted)
        place = np.minimum(place, len(self.hashes) - 1)
        return place, self.hashes[place] == wanted


def _added(table: dict[str, np.ndarray] | None, parts: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """The distinct n-grams of ``table`` and ``parts`` (grams, contexts, tails), with their counts."""
    gram, context, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.ones(len(gram), dtype=np.int64)
    if table is not None:
        gram, context = np.append(table["gram"], gram), np.append(table["context"], context)
        tail, count = np.append(table["tail"], tail), np.append(table["count"], count)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    place = order[first]
    count = np.add.reduceat(count[order], first)
    return {"gram": gram[first], "context": context[place], "tail": tail[place], "count": count}


def _count(texts: list[str], order: int) -> list[dict[str, np.ndarray]]:
    """Distinct n-grams per order, with counts, their contexts and their shorter grams.

    Orders that no text is long enough for are left out. Counts are put together every
    ``COUNTED_AT_ONCE`` characters, so memory follows the distinct n-grams.
    """
    tables: list[dict[str, np.ndarray] | None] = [None] * order
    parts: list[list[tuple]] = [[] for _ in range(order)]
    waiting = 0
    for i, text in enumerate(texts):
        grams = _hashes(code_points(text), order)
        contexts = _contexts(grams)
        waiting += len(grams[0])
        for n in range(1, order + 1):
            if len(grams[n - 1]):
                tail = grams[n - 2][1:] if n > 1 else np.zeros(len(grams[0]), dtype=np.uint64)
                parts[n - 1].append((grams[n - 1], contexts[n - 1][-len(grams[n - 1]) :], tail))
        if waiting >= COUNTED_AT_ONCE or i == len(texts) - 1:
            tables = [_added(t, own) if own else t for t, own in zip(tables, parts, strict=True)]
            parts, waiting = [[] for _ in range(order)], 0
    return [t for t in tables if t is not None]


def _discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _kneser_ney(counted: list[dict[str, np.ndarray]], alphabet: int) -> list[dict[str, np.ndarray]]:
    """Probabilities and back-off weights of one language.

    The highest order uses counts; lower orders count the distinct characters before a gram.
    """
    order, model = len(counted), []
    lower: dict[str, np.ndarray] | None = None
    for n in range(1, order + 1):
        table = counted[n - 1]
        if n == order:
            count = table["count"].astype(float)
        else:
            longer = counted[n]
            known, times = np.unique(longer["tail"], return_counts=True)
            at = np.minimum(np.searchsorted(known, table["gram"]), len(known) - 1)
            count = np.where(known[at] == table["gram"], times[at], 1).astype(float)
        discount = _discount(count)
        context, where = np.unique(table["context"], return_inverse=True)
        total = np.bincount(where, weights=count)
        kinds = np.bincount(where)
        backoff = discount * kinds / total
        if lower is None:
            below = np.full(len(count), 1.0 / alphabet)
        else:
            below = lower["p"][np.searchsorted(lower["gram"], table["tail"])]
        p = np.maximum(count - discount, 0) / total[where] + backoff[where] * below
        lower = {"gram": table["gram"], "p": p, "context": context, "backoff": backoff}
        model.append(lower)
    return model


@dataclass
class Models:
    """Sorted n-gram hashes per order with log probabilities per language, and the calibration."""

    languages: list[str]
    grams: list[Keys]
    log_p: list[np.ndarray]
    contexts: list[Keys]
    log_backoff: list[np.ndarray]
    floor: float
    sharpness: float = 1.0
    limits: dict[str, tuple[float, float]] | None = None

    def _level(self, n: int, gram: list[np.ndarray], context: list[np.ndarray], at: np.ndarray | slice) -> np.ndarray:
        """Log probabilities of order n at positions ``at`` of the grams of order n."""
        if n == 0:
            return np.full((len(gram[0][at]), len(self.languages)), self.floor)
        place, hit = self.grams[n - 1].find(gram[n - 1][at])
        out = self.log_p[n - 1][place]
        if not hit.all():
            missing = np.flatnonzero(~hit)
            rest = missing + at.start if isinstance(at, slice) else at[missing]
            below = self._level(n - 1, gram, context, rest + (n > 1))
            place, known = self.contexts[n - 1].find(context[n - 1][rest])
            out[missing] = below + np.where(known[:, None], self.log_backoff[n - 1][place], 0.0)
        return out

    def entropy(self, text: str) -> tuple[np.ndarray, int]:
        """Nats per character in each language, and the number of characters."""
        points = code_points(text)
        order, total = len(self.grams), np.zeros(len(self.languages))
        step = 1 << 20  # long texts are scored part by part
        for begin in range(0, len(points), step):
            lead = min(begin, order - 1)
            part = points[begin - lead : begin + step]
            longest = min(order, len(part))
            gram = _hashes(part, longest)
            context = _contexts(gram)
            if begin == 0:  # the first characters have short contexts; the 0 before the text is given
                for n in range(2, longest):
                    total += self._level(n, gram, context, np.array([0]))[0]
            out = self._level(longest, gram, context, slice(0, len(gram[-1])))
            total += np.ones(len(out)) @ out
        count = max(1, len(points) - 1)
        return -total / count, count

    def scaled(self, entropy: np.ndarray, count: int) -> np.ndarray:
        """Evidence grows with the length, but less than in proportion."""
        return -entropy * np.sqrt(count)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the text is rejected as none of them."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        entropy, count = self.entropy(text)
        best = int(np.argmin(entropy))
        z = self.sharpness * self.scaled(entropy, count)
        score = 1.0 / float(np.exp(z - z[best]).sum())
        mean, spread = (self.limits or {}).get(self.languages[best], (np.inf, 0.0))
        return self.languages[best], score, bool(entropy[best] > mean + spread * (1.0 + 8.0 / np.sqrt(count)))


def build(samples: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models from texts per language; every sixth text calibrates and does not train."""
    samples = {k: [t for t in v if has_letter(t)] for k, v in samples.items()}
    samples = {k: v for k, v in sorted(samples.items()) if v}
    if not samples:
        return Models([], [], [], [], [], 0.0)
    train = {k: [t for i, t in enumerate(v) if i % 6 or len(v) < 12] for k, v in samples.items()}
    seen = {k: _count(v, order) for k, v in train.items()}
    order = min(map(len, seen.values()))  # texts of a single letter have no long n-grams
    seen = {k: c[:order] for k, c in seen.items()}
    alphabet = 1 + len(np.unique(np.concatenate([c[0]["gram"] for c in seen.values()])))
    own = {k: _kneser_ney(c, alphabet) for k, c in seen.items()}
    models = Models(list(samples), [], [], [], [], float(np.log(1.0 / (alphabet + 1000))))
    lower_p: list[np.ndarray] = []
    for n in range(1, order + 1):
        gram, first = np.unique(np.concatenate([c[n - 1]["gram"] for c in seen.values()]), return_index=True)
        context = np.concatenate([c[n - 1]["context"] for c in seen.values()])[first]
        tail = np.concatenate([c[n - 1]["tail"] for c in seen.values()])[first]
        contexts = np.unique(context)
        log_p, backoffs, ps = [], [], []
        for j, language in enumerate(models.languages):
            model = own[language][n - 1]
            at = np.minimum(np.searchsorted(model["context"], contexts), len(model["context"]) - 1)
            backoff = np.where(model["context"][at] == contexts, model["backoff"][at], 1.0)
            if n == 1:
                below = np.full(len(gram), 1.0 / alphabet)
            else:
                below = lower_p[j][np.searchsorted(models.grams[n - 2].hashes, tail)]
            unseen = backoff[np.searchsorted(contexts, context)] * below
            at = np.minimum(np.searchsorted(model["gram"], gram), len(model["gram"]) - 1)
            p = np.where(model["gram"][at] == gram, model["p"][at], unseen)
            ps.append(p)
            log_p.append(np.log(p))
            backoffs.append(np.log(backoff))
        lower_p = ps
        models.grams.append(Keys(gram))
        models.log_p.append(np.stack(log_p, axis=1))
        models.contexts.append(Keys(contexts))
        models.log_backoff.append(np.stack(backoffs, axis=1))
    held = {k: [t for i, t in enumerate(v) if not i % 6] or v for k, v in samples.items()}
    _calibrate(models, held)
    return models


def _calibrate(models: Models, held: dict[str, list[str]]) -> None:
    """The sharpness with the best likelihood, and a limit that no calibration text exceeds."""
    rows, limits = [], {}
    for j, language in enumerate(models.languages):
        own = []
        for text in held[language]:
            entropy, count = models.entropy(text)
            rows.append((j, models.scaled(entropy, count)))
            own.append((entropy[j], count))
        mean = float(np.mean([e for e, _ in own]))
        excess = max((e - mean) / (1.0 + 8.0 / np.sqrt(c)) for e, c in own)
        limits[language] = (mean, max(0.5, 1.5 * excess))
    y, z = np.array([j for j, _ in rows]), np.stack([s for _, s in rows])

    def loss(sharpness: float) -> float:
        a = sharpness * z
        a = a - a.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y]))

    models.sharpness = min((0.05 * 1.25**i for i in range(30)), key=loss)
    models.limits = limits


def sample(
    labelled: DataFrame, label: str, per_label: int, max_chars: int, seed: int = 11, docs: DataFrame | None = None
) -> dict:
    """Texts of each label, at most ``per_label``; of one longer than ``max_chars`` a slice of that length.

    The rows with the smallest seeded hashes, so the sample does not depend on partitions. One
    pass finds the hashes for all labels, a second one reads the texts of those chosen. Texts are
    in ``labelled``, or in ``docs``, with ``doc_id`` in both. Null labels don't count. A text has the
    labels of all its rows. Beyond ``MOST_LABELS`` labels an error is raised.
    """
    place = F.xxhash64(F.lit(seed), "text")
    source = labelled if docs is None else docs
    usable = source.filter(F.col("text").isNotNull()).withColumn("_place", place)
    places = usable if docs is None else usable.select("doc_id", "_place").join(labelled, "doc_id")
    places = places.select(F.col(label).alias("_label"), "_place").filter("_label is not null").distinct()
    parts = places.withColumn("_part", F.pmod(F.shiftright("_place", 8), F.lit(SAMPLE_PARTS)))
    order = [F.col("_place").asc()]
    best = top_k(parts, ["_label", "_part"], order, per_label, "_n").drop("_n")
    best = top_k(best, ["_label"], order, per_label, "_n").select("_label", "_place")
    if len(best.select("_label").distinct().limit(MOST_LABELS + 1).collect()) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS:,} labels")
    # At most per_label numbers for each label.
    chosen = labelled.sparkSession.createDataFrame(best.collect(), best.schema)
    surplus = F.greatest(F.length("text") - max_chars, F.lit(0))
    slice_ = F.substring("text", (F.pmod("_place", surplus + 1) + 1).cast("int"), F.lit(max_chars)).alias("text")
    rows = usable.join(F.broadcast(chosen), "_place").select("_label", "_place", slice_).distinct().collect()
    texts: dict = {}
    for r in sorted(rows, key=lambda r: (r["_label"], r["_place"], r["text"])):
        texts.setdefault(r["_label"], []).append(r["text"])
    return texts


def train(labelled: DataFrame, label: str = "lang", per_label: int = SAMPLE_DOCS, order: int = ORDER) -> Models:
    """Models from a bounded sample of rows with ``text`` and a label; null labels don't count."""
    return build(sample(labelled, label, per_label, SAMPLE_CHARS), order)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Without any
    training text all rows are. A text whose cross-entropy exceeds the calibrated limit of its
    best language keeps that language and is marked as rejected.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(text):
        import pandas as pd

        rows = [shared.value.predict(t) for t in text]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    judged = docs.select(boxed(own), judge("text").alias("_judged"))
    return judged.select(*unboxed(own), "_judged.*")
