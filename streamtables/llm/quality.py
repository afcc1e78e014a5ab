"""Quality scores by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A
text is compressed with each; the difference of the compressed sizes, per byte of text, is
turned into a probability by a logistic curve that is fitted on texts the dictionaries have
not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtables.llm.common import boxed, unboxed
from streamtables.llm.language_id import sample

#: Training texts of each label; half of them build the dictionaries, half calibrate.
SAMPLE_DOCS = 3000
#: Of a longer text the training sample has a slice (it is scored whole like all others).
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 256 * 1024
LEVEL = 3
THRESHOLD = 0.3


def features(good: int, bad: int, length: int) -> list[float]:
    """The difference of the compressed sizes, per byte of text and per compressed byte."""
    return [(bad - good) / max(1, length), (bad - good) / max(1, good + bad)]


@dataclass
class QualityModel:
    """Dictionaries and the logistic curve; ``prior`` scores texts if nothing was learned."""

    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    prior: float = 0.5
    level: int = LEVEL

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def sizes(self, text: bytes) -> list[float]:
        if "_tools" not in self.__dict__:
            plain = {"level": self.level, "write_content_size": False, "write_dict_id": False}
            contents = [
                zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)
            ]
            for content in contents:
                content.precompute_compress(self.level)
            self._tools = [zstandard.ZstdCompressor(dict_data=content, **plain) for content in contents]
        return features(*(len(tool.compress(text)) for tool in self._tools), len(text))

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        x = np.array(self.sizes((text or "").encode()))
        return float(self.curve(x[None, :])[0])

    def curve(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6) @ np.array(self.weights[1:]) + self.weights[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(texts: list[str], size: int) -> bytes:
    """Content for a dictionary: an even share of every text, so that many texts are in it."""
    share = max(64, size // max(1, len(texts)))
    parts, total = [], 0
    for text in texts:
        raw = text.encode()
        middle = max(0, (len(raw) - share) // 2)
        parts.append(raw[middle : middle + share])
        total += len(parts[-1])
        if total >= size:
            break
    return b"\n".join(parts)[-size:]


def fit(
    good: list[str],
    bad: list[str],
    dictionary_bytes: int = DICTIONARY_BYTES,
    level: int = LEVEL,
    share: float | None = None,
) -> QualityModel:
    """Dictionaries from the even texts of each list, the curve from the odd ones.

    ``share`` is the part of good texts among all that the lists are samples of (None: as in the
    lists); the curve's texts are weighted by it.
    """
    count = len(good) + len(bad)
    if share is None:
        share = len(good) / count if count else 0.5
    if len(good) < 2 or len(bad) < 2:
        return QualityModel(b"", b"", prior=share)
    model = QualityModel(
        _dictionary(good[::2], dictionary_bytes), _dictionary(bad[::2], dictionary_bytes), level=level
    )
    x = np.array([model.sizes(t.encode()) for t in [*good[1::2], *bad[1::2]]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    model.centre, model.spread = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-6).tolist()
    a = np.hstack([np.ones((len(x), 1)), np.clip((x - model.centre) / model.spread, -6, 6)])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(a.shape[1])
    for _ in range(50):  # Newton's method with a little shrinkage
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - 0.1 * w)
    model.weights, model.prior = w.tolist(), share
    return model


def train(
    labelled: DataFrame, label: str = "quality", per_label: int = SAMPLE_DOCS, docs: DataFrame | None = None
) -> QualityModel:
    """A model from a bounded sample of rows with ``text`` and a label of 0 or 1.

    With ``docs`` (``doc_id``, ``text``), ``labelled`` has ``doc_id`` and the label, and is joined
    without the texts.

    Each label is sampled up to the bound, the rarer one in full if it has no more texts; the
    curve weighs them by the labels' true shares, so that it gives probabilities for all texts.
    """
    labelled = labelled.filter(F.col(label).isin(0, 1))
    if docs is not None:
        labelled = labelled.select("doc_id", label).join(docs.select("doc_id"), "doc_id")
    counts = {int(r[0]): r[1] for r in labelled.groupBy(label).count().collect()}
    texts = {int(k): v for k, v in sample(labelled, label, per_label, SAMPLE_CHARS, docs=docs).items()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else None
    return fit(texts.get(1, []), texts.get(0, []), share=share)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted``; columns of these names are replaced.

    A null text counts as empty. Without labels of both kinds every text gets the share of
    label 1, or one half.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(text):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    scored = docs.select(boxed(own), judge("text").alias("_score"))
    return scored.select(*unboxed(own), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
