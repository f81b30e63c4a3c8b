"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Unary potentials see features of the line and of the lines beside
it; a 2 x 2 table couples neighbouring labels. The field is trained on the driver by gradient ascent
on the likelihood of a bounded sample, whose lines carry their document's label. At scoring,
forward-backward gives every line's marginal; their mean weighted by line length, through a
calibrated logistic, is the document's score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimill.llm.arrow import crc_bucket, fresh, map_texts
from sentimill.llm.labelled import sample_labels, sample_texts

#: Sampled documents of each class, and gradient steps.
PER_CLASS, STEPS = 600, 250
END = re.compile(r"[.!?:;\"')\]]\s*$")
#: Byte classes whose share of a line is a feature.
_CLASSES = np.zeros((256, 6), np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (
        65 <= _b <= 90,
        97 <= _b <= 122 or _b >= 128,
        48 <= _b <= 57,
        _c in ".,;:'\"?-()",
        _c in "!#$%&*+/<=>@[\\]^_`{|}~",
        _c in " \t",
    )
CODES = _CLASSES.argmax(axis=1) + np.where(_CLASSES.any(axis=1), 0, 6)
N_OWN = 14


def line_features(lines: list[str]) -> np.ndarray:
    """One row of own features per line."""
    raw = [x.encode("utf-8", "replace") for x in lines]
    sizes = np.array([len(x) for x in raw])
    out = np.zeros((len(lines), N_OWN))
    filled = sizes > 0
    if filled.any():
        codes = CODES[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(lines)), sizes)
        counts = np.bincount(owner * 7 + codes, minlength=7 * len(lines)).reshape(-1, 7)
        out[:, :6] = counts[:, :6] / np.maximum(sizes, 1)[:, None]
    seen_before = ""
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            kinds = len(set(words))
            out[i, 6] = kinds / n
            out[i, 7] = min(n, 60) / 60
            out[i, 8] = min(len(line) / n, 25) / 25
            out[i, 9] = sum(map(str.__eq__, words, words[1:])) / n
            out[i, 10] = 1.0 if END.search(line) else 0.0
            out[i, 11] = 1.0 if line == seen_before else 0.0
            out[i, 12] = 1 - kinds / n if n > 20 else 0.0
        else:
            out[i, 13] = 1.0
        seen_before = line
    return out


def chain_features(lines: list[str]) -> np.ndarray:
    """Own features, both neighbours' (zeros at the ends), and a constant."""
    own = line_features(lines)
    gap = np.zeros((1, N_OWN))
    return np.concatenate([own, np.concatenate([gap, own[:-1]]), np.concatenate([own[1:], gap]), np.ones((len(lines), 1))], axis=1)


def marginals(unary: np.ndarray, couple: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``unary`` holds each line's log-potential of good less that of bad, chains one after another;
    ``couple`` is the 2 x 2 log-potential of neighbouring labels. Gives each line's probability of
    good, each neighbouring pair's joint (lines, 2, 2; the last line of a chain has none), and each chain's log-partition.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n = len(unary)
    node = np.stack([np.zeros(n), unary], axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        at = starts[: alive[t]] + t
        if t == 0:
            forward[at] = node[at]
        else:
            p = forward[at - 1]
            forward[at] = node[at] + np.logaddexp(p[:, :1] + couple[0], p[:, 1:] + couple[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        q = backward[at + 1] + node[at + 1]
        backward[at, 0] = np.logaddexp(q[:, 0] + couple[0, 0], q[:, 1] + couple[0, 1])
        backward[at, 1] = np.logaddexp(q[:, 0] + couple[1, 0], q[:, 1] + couple[1, 1])
    both = forward + backward
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    pair = np.zeros((n, 2, 2))
    ends = np.zeros(n, bool)
    ends[starts + sizes - 1] = True
    i = np.flatnonzero(~ends)
    pair[i] = np.exp(forward[i][:, :, None] + couple[None] + (node[i + 1] + backward[i + 1])[:, None, :] - log_z[i][:, None, None])
    z = np.empty(len(sizes))
    z[order] = log_z[starts]
    return good, pair, z


class Model:
    def __init__(self):
        self.w = np.zeros(3 * N_OWN + 1)
        self.couple = np.zeros((2, 2))
        self.mean, self.scale = np.zeros(3 * N_OWN + 1), np.ones(3 * N_OWN + 1)
        self.slope, self.shift = 1.0, 0.0

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def fit(self, texts: list[str], y: list[int], steps: int = STEPS) -> Model:
        docs = [t.split("\n") for t in texts]
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        x = np.concatenate([chain_features(d) for d in docs])
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.05)
        self.mean[-1], self.scale[-1] = 0.0, 1.0
        x = (x - self.mean) / self.scale
        label = np.repeat(np.array(y), sizes)
        weight = np.repeat(1 / sizes, sizes) * np.where(label == 1, 1 / max(1, sum(y)), 1 / max(1, len(y) - sum(y)))  # documents and classes weigh alike
        ends = np.zeros(len(label), bool)
        ends[starts + sizes - 1] = True
        inner = np.flatnonzero(~ends)
        seen = np.zeros((len(label), 2, 2))
        seen[inner, label[inner], label[inner + 1]] = 1
        m, v = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        for t in range(1, steps + 1):
            good, pair, _ = marginals(x @ self.w, self.couple, starts, sizes)
            g = np.concatenate([x.T @ ((label - good) * weight) - 1e-3 * self.w, (((seen - pair) * weight[:, None, None]).sum(axis=0) - 1e-2 * self.couple).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w = self.w + step[:-4]
            self.couple = self.couple + step[-4:].reshape(2, 2)
        self._calibrate(self.quality(texts), np.array(y, float))
        return self

    def _calibrate(self, mean: np.ndarray, y: np.ndarray) -> None:
        """A logistic of the documents' mean marginal, by Newton steps with classes weighed alike."""
        f = np.stack([_logit(mean), np.ones(len(y))], axis=1)
        c = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            h = (f * (c * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            w = w + np.clip(np.linalg.solve(h, f.T @ (c * (y - p)) - 1e-3 * (w - np.array([1.0, 0.0]))), -1, 1)
        self.slope, self.shift = max(float(w[0]), 0.05), float(w[1])

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean probability of good lines of each document; an empty document is one empty line."""
        docs = [(t or "").split("\n") for t in texts]
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        x = np.concatenate([chain_features(d) for d in docs])
        good, _, _ = marginals(self.unary(x), self.couple, starts, sizes)
        length = np.array([len(line) + 1e-6 for d in docs for line in d])
        return np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.quality(texts)) + self.shift, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """A model from up to ``per_class`` labelled documents of each class outside the held-out fold; with one class or none it scores by chance."""
    sample = sample_texts(docs, sample_labels(labels, "quality", folds, held_out, per_class))
    if len({y for _, y in sample}) < 2:
        return Model()
    return Model().fit([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: Model, into: str = "score", keep: bool = False) -> DataFrame:
    """(doc_id, ``into``) for every row, or all columns of ``docs`` and ``into`` (a name of its own) with ``keep``.

    A map over the rows: no shuffle, memory of one Arrow batch. Null and empty texts are one empty
    line; null ids and repeated rows are scored row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = fresh(docs, "_scored_text") if keep else "text"
    rows = docs.withColumn(scored, F.col("text")) if keep else docs.select("doc_id", "text")

    def start():
        model = shared.value
        return lambda texts: {into: pa.array(model.score(texts), pa.float64())}

    return map_texts(rows, scored, f"`{into}` double", start)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the fold crc32(doc_id) mod 3 = 1 are not learnt from."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
