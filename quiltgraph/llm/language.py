"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its subwords: the words (runs of letters in lower case)
and their character n-grams of length 2 to 5, with word ends marked, hashed into a table. Embeddings and softmax weights
are trained together by stochastic gradient descent on runs of words. Scores are calibrated by a
temperature; below a threshold that keeps nearly all right predictions a prediction counts as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of the embedding table, as a power of two, and its width.
BITS, WIDTH = 16, 16
#: About as many documents of each language are learned from.
PER_LANGUAGE = 300
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return RUNS.findall(text.lower()) if text else []


RUNS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the words themselves and each n-gram length: rows of the table, and the number of the word each belongs to."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word, starts = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - starts[word]
    shift = np.uint64(64 - bits)
    # a word's hash: its characters, each mixed with its place, summed
    mixed = (codes + place.astype(np.uint64) * np.uint64(0x10FFFF)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    found = [(((np.add.reduceat(mixed * _MIX, starts) * _MIX) >> shift).astype(np.int64), np.arange(len(words)))]
    h = codes * _MIX
    for n in range(2, 6):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(31)) ^ codes[n - 1 :]) * _MIX
        inside = place[: len(h)] + n <= sizes[word[: len(h)]]
        found.append(((h[inside] >> shift).astype(np.int64), word[: len(h)][inside]))
    return found


@dataclass
class Model:
    names: list[str]
    logits: np.ndarray  # what a row of the table adds to each language's logit
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


class Reader:
    """Mean logits of whole texts, each word's sum from a memo of bounded size; words not seen before are read together."""

    def __init__(self, model: Model):
        self.model, width = model, len(model.names) + 1
        self.limit = min(common.MEMO_ENTRIES, 20_000_000 // width)
        self.rows, self.memo = np.zeros((1024, width)), {}

    def learn(self, unseen: list[str]) -> None:
        first = len(self.memo)
        self.memo.update(zip(unseen, range(first, first + len(unseen))))
        while len(self.rows) < len(self.memo):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        sums = np.zeros((len(unseen), self.rows.shape[1]))
        for rows, word in subwords(unseen, self.model.bits):
            sums[:, -1] += np.bincount(word, minlength=len(unseen))
            for k in range(len(self.model.names)):
                sums[:, k] += np.bincount(word, self.model.logits[rows, k], minlength=len(unseen))
        self.rows[first : first + len(unseen)] = sums

    def means(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [words_of(t) for t in texts]
        unseen = list(set().union(*split) - self.memo.keys())
        if len(self.memo) + len(unseen) > self.limit:
            self.memo.clear()
            unseen = list(set().union(*split))
        for at in range(0, len(unseen), 50_000):
            self.learn(sorted(unseen[at : at + 50_000]))
        found = []
        for words in split:
            total = self.rows[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))].sum(0)
            found.append(total[:-1] / max(total[-1], 1))
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each; :data:`UNKNOWN` and 0 for a null text or one without a letter."""
        found = []
        for text, mean in zip(texts, self.means(texts)):
            if not text or not any(map(str.isalpha, text)):
                found.append((UNKNOWN, 0.0))
                continue
            p = self.model.probabilities(mean)
            best = int(p.argmax())  # ties: the first name
            found.append((self.model.names[best], float(p[best])))
        return found


def train(texts: list[str], languages: list[str], bits: int = BITS, width: int = WIDTH, epochs: int = 3, run: int = 40, rate: float = 0.5, seed: int = 1) -> Model:
    """Model of ``languages``. A fifth of the texts, every fifth one, is kept for calibration, as short runs of words.

    Texts are learned from whole, in runs of ``run`` words. With a single language every text is that
    one; without rows there is nothing to predict but :data:`UNKNOWN`.
    """
    names = sorted(set(languages)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    known = {n: i for i, n in enumerate(names)}
    learned, kept = [], []
    for i, (text, name) in enumerate(zip(texts, languages)):
        if i % 5 == 4:
            words = words_of(text)
            kept += [(" ".join(words[at : at + 5]), known[name]) for at in range(0, len(words), 50)]
            continue
        words = words_of(text)
        for at in range(0, len(words), run):
            learned.append((words[at : at + run], known[name]))
    table, weights, bias = rng.normal(0, 0.1, (1 << bits, width)), np.zeros((width, len(names))), np.zeros(len(names))
    weights += rng.normal(0, 0.1, weights.shape)
    # each language counts alike, however many runs it has
    share = np.bincount([k for _, k in learned], minlength=len(names))
    pull = np.where(share > 0, len(learned) / len(names) / np.maximum(share, 1), 0).clip(0, 10)
    steps, done = epochs * len(learned), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learned)):
            words, k = learned[i]
            rows = np.concatenate([r for r, _ in subwords(words, bits)])
            step = rate * (1 - done / steps)
            done += 1
            mean = table[rows].mean(0)
            z = mean @ weights + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[k] -= 1
            error *= min(step * pull[k], 1.0)
            back = weights @ error
            weights -= np.outer(mean, error)
            bias -= 0.1 * error
            # every subword of the mean moves by its share; times the mean's size, else long texts hardly move
            np.subtract.at(table, rows, back / np.sqrt(len(rows)))
    model = Model(names, table @ weights, bias, 1.0, 0.0, bits)
    if kept:
        calibrate(model, kept)
    return model


def calibrate(model: Model, kept: list[tuple[str, int]], keep_right: float = 0.999) -> None:
    """Sets the temperature by likelihood on ``kept``, and the threshold that keeps ``keep_right`` of the right predictions."""
    reader = Reader(model)
    z, y = np.array(reader.means([t for t, _ in kept])) + model.bias, np.array([k for _, k in kept])

    def loss(temperature: float) -> float:
        q = z / temperature
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.25, 20, 61), key=loss)
    p = np.array([model.probabilities(x - model.bias) for x in z])
    right = p.max(1)[p.argmax(1) == y]
    model.reject_below = float(np.quantile(right, 1 - keep_right)) if len(right) else 0.0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model fitted on a bounded sample of the ``docs`` with a language, outside the held-out fold.

    Null ids, texts and languages are not learned from, repeated rows once. The sample is bounded in rows
    by ``per_language``, in languages by ``common.MOST_LABELS`` and in characters by ``common.FIT_CHARS``.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~common.is_held_out("doc_id") & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = common.fitting_rows(common.bounded_sample(known, "lang", per_language), "lang", per_language)
    return train([r[0] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` of every row.

    ``lang_pred`` is ``und``, with score 0 and rejected, where the text is null or has no letter (empty
    texts too). Otherwise it is a learned language, rejected where its score is below the calibrated
    threshold. Ties go to the first name. Texts are read whole; repeated rows get equal answers; an empty
    table gives an empty one; no other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        reader = Reader(m)

        def rows(texts: list) -> dict[str, pa.Array]:
            got = reader.predict(texts)
            return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "rejected": pa.array([g[0] == UNKNOWN or g[1] < m.reject_below for g in got], pa.bool_())}

        return common.per_document(batches, text, rows, keep)

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double, rejected boolean")
