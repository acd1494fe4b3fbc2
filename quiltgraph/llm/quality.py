"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its hashed n-grams: words and word pairs; shapes of words (kinds of
characters, not the characters) and shape pairs; and runs of two to five words equal to the one before,
which is how n-grams of words never seen in training are told apart. Indicators are scaled by the
classes' log-count ratios; a linear model is fitted to them with a hinge loss by dual coordinate
descent, and its margins are turned into probabilities by a logistic fit on rows it was not fitted to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashed features.
BITS = 20
#: About as many labelled rows of each class are fitted on.
PER_LABEL = 3000
#: Score from which a text is taken for good.
KEEP_FROM = 0.7

_shape_steps = [(re.compile("[^\\W\\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (re.compile("[0-9]+"), lambda m: "0")]


def shape(word: str) -> str:
    """Kinds of the characters of a word: runs of letters by case, runs of digits, other characters once each."""
    for pattern, kind in _shape_steps:
        word = pattern.sub(kind, word)
    return re.sub(r"([^\w])\1+", r"\1\1", word)[:24]


def _codes(word: str) -> int:
    """Hashes of a word's letters and of its shape, 32 bits each."""
    return crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | crc32(shape(word).encode("utf-8", "surrogatepass"))


class Features:
    def __init__(self, bits: int = BITS):
        self.mask, self.memo = np.uint64((1 << bits) - 1), common.Memo(_codes)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted numbers of the n-grams in a text; none for a null, empty or blank one."""
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int64)
        codes = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        word, form = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        # runs[k]: the k words before this one equal it
        same, runs = word[1:] == word[:-1], []
        for k in range(1, 5):
            if len(same) >= k and np.logical_and.reduce([same[i : len(same) - k + 1 + i] for i in range(k)]).any():
                runs.append(k)
        first, pair = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        found = [word * first, (word[:-1] * pair + word[1:]) * first, form * pair, (form[:-1] * first + form[1:]) * pair, np.array(runs, np.uint64) * np.uint64(0x165667B19E3779F9)]
        return np.unique(np.concatenate(found) >> np.uint64(40) & self.mask).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32 by feature: log-count ratio times hinge weight
    bias: float
    scale: float  # of the margin in the logistic fit
    shift: float
    bits: int

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum(dtype=np.float64)) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(features) + self.shift, -500, 500))))


def ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratios of the indicators between class 1 and class 0."""
    counts = [np.full(size, alpha) for _ in range(2)]
    for row, label in zip(rows, labels):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i), x_i the scaled indicators and a 1."""
    w, bias, y = np.zeros(len(scale)), 0.0, 2.0 * labels - 1
    square = np.array([(scale[r] ** 2).sum() + 1 for r in rows])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = scale[rows[i]]
            gradient = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def train(texts: list[str | None], labels: list[int], weights: list[float] | None = None, bits: int = BITS, cost: float = 0.1) -> Model:
    """Model of ``labels`` (0 or 1). ``weights``: how many rows each stands for in the logistic fit.

    A fifth of the rows, every fifth one, is kept from the hinge fit for the logistic one. With rows of
    one class only, or none, every score is that class's share (a half without rows).
    """
    features, y = Features(bits), np.array(labels, float)
    size = 1 << bits
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))), bits)
    rows, w = [features(t) for t in texts], np.ones(len(y)) if weights is None else np.array(weights, float)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    fit = [r for r, h in zip(rows, held) if not h]
    scale = ratios(fit, y[~held], size)
    balance = np.array([(~held).sum() / 2 / (y[~held] == k).sum() for k in (0, 1)])
    hinge, bias = dual_descent(fit, y[~held], scale, cost * balance[y[~held].astype(int)])
    model = Model((hinge * scale).astype(np.float32), bias, 1.0, 0.0, bits)
    tested = [(model.margin(r), k, v) for r, k, v, h in zip(rows, y, w, held) if h or not held.any()]
    model.scale, model.shift = common.sigmoid_fit(*zip(*tested))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Model fitted on a bounded sample of the labelled ``docs`` outside the held-out fold.

    Reads doc_id and text of ``docs``, doc_id and ``label`` of ``labels``; null ids and labels other than
    0 and 1 are not learned from, repeated rows once. The sample is bounded in rows by ``per_label`` and in
    characters by ``common.FIT_CHARS``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~common.is_held_out("doc_id")).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    known = known.where("label in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    # as many ids as per_label says, more only if their hashes are the same; so they can be sent to every executor
    chosen = common.bounded_sample(known, "label", per_label).orderBy("place", "doc_id", "label").limit(4 * per_label)
    rows = common.fitting_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "label", per_label)
    got = {k: sum(r[1] == k for r in rows) for k in counts}
    return train([r[0] for r in rows], [r[1] for r in rows], [counts[r[1]] / got[r[1]] for r in rows])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", into: str = "score") -> DataFrame:
    """``keep`` and the score ``into`` (0 to 1, higher where class 1 is likelier) of every row.

    Null, empty and blank texts have no features and get the score of the bias. Texts are read whole;
    repeated rows get equal scores; an empty table gives an empty one; no other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        features = Features(m.bits)
        return common.per_document(batches, text, lambda texts: {into: pa.array([m.score(features(t)) for t in texts], pa.float64())}, keep)

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", `{into}` double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """``docs`` that a model fitted on those labelled scores ``threshold`` or more; columns stay as they are."""
    (into,) = common.unused(docs.columns, "quality")
    scored = score(docs, fit(docs, labels), keep=tuple(docs.columns), into=into)
    return scored.where(F.col(into) >= threshold).select(docs.columns)
