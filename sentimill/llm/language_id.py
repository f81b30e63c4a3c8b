"""Language of texts by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter's maximum
over a window goes to a softmax layer. The network is trained in numpy on a bounded sample of
labelled documents. A whole text is cut into windows, whose probabilities are averaged by
the bytes they hold, so that a foreign passage has the say of its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimill.llm.arrow import crc_bucket, map_texts
from sentimill.llm.labelled import excerpt

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 6
UNDETERMINED = "und"
#: Documents a language learnt from, documents of all languages together (one a language at least), passes over the windows.
PER_LANGUAGE, SAMPLE, EPOCHS = 300, 18_000, 10
#: Windows learnt from in a document, spread over the whole text.
WINDOWS = 12


def windows(raw: bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW bytes, the last padded with zeros; a text of no bytes has one row of zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Net:
    """Parameters are kept in a plain dict of arrays, so the trained net travels as a small broadcast."""

    def __init__(self, n_classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"k{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["v"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), n_classes)).astype(np.float32)
        self.p["c"] = np.zeros(n_classes, np.float32)

    def _bytes(self, w: int) -> list[np.ndarray]:
        """For each place of a filter of width w: what each byte adds there (embedding and convolution in one lookup)."""
        return [self.p["e"] @ self.p[f"k{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        s = h @ self.p["v"] + self.p["c"]
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def log_probabilities(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        """Log-softmax of each window. Pairs of neighbouring bytes are looked up: the widths' sums then take two reads a byte."""
        two = [self._bytes(w) for w in WIDTHS]
        pairs = {w: (t[0][:, None] + t[1][None]).reshape(-1, FILTERS) for w, t in zip(WIDTHS, two, strict=True)}
        head = np.concatenate([pairs[w] for w in WIDTHS], axis=1)
        tail = np.concatenate([np.repeat(two[1][2], 256, axis=0), (two[2][2][:, None] + two[2][3][None]).reshape(-1, FILTERS)], axis=1)
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        out = []
        for i in range(0, len(x), step):
            part = x[i : i + step].astype(np.int32)
            ids = part[:, :-1] * 256 + part[:, 1:]
            z = head.take(ids, axis=0)
            last = (part[:, -1] * 256)[:, None]
            z[:, :-1, FILTERS:] += tail.take(np.concatenate([ids[:, 2:], last], axis=1), axis=0)
            best = np.concatenate([z[:, : WINDOW - w + 1, k * FILTERS : (k + 1) * FILTERS].max(axis=1) for k, w in enumerate(WIDTHS)], axis=1)
            out.append(self._softmax(np.maximum(best + bias, 0)))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = [], []
        for w in WIDTHS:
            z = sum(t.take(x[:, j : WINDOW - w + 1 + j], axis=0) for j, t in enumerate(self._bytes(w)))
            at = z.argmax(axis=1)
            best = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"]
            pooled.append(np.maximum(best, 0))
            kept.append((at, best > 0))
        h = np.concatenate(pooled, axis=1)
        s = np.exp(self._softmax(h))
        s[np.arange(len(y)), y] -= 1
        s /= len(y)
        g = {"v": h.T @ s, "c": s.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = s @ self.p["v"].T
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            at, on = kept[k]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"b{w}"] = d.sum(axis=0)
            g[f"k{w}"] = np.zeros_like(self.p[f"k{w}"])
            for j in range(w):
                seen = x[rows, at + j]  # the byte under each filter's best place
                own = slice(j * EMBED, (j + 1) * EMBED)
                g[f"k{w}"][own] = np.einsum("nfe,nf->ef", self.p["e"][seen], d)
                back = d[:, :, None] * self.p[f"k{w}"][own].T[None]
                for q in range(EMBED):
                    g["e"][:, q] += np.bincount(seen.ravel(), weights=back[:, :, q].ravel(), minlength=256)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> Net:
        """Adam over shuffled windows."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                t += 1
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> tuple[list[str], Net]:
    """The net and its languages, from up to ``per_language`` documents each of every language there is; fewer each where SAMPLE is divided among more.

    Rows are drawn by a hash of id and text, in one scan; equal rows count once, so a repeated row or id
    brings no more to the driver than others. A text is learnt from in WINDOWS windows spread over all of it,
    whatever its length. Without any labelled row the net knows only ``und``.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", folds) != held_out))
    found = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not found:
        return [UNDETERMINED], Net(1)
    each = max(1, min(per_language, SAMPLE // len(found)))
    # one scan: each language's rows whose hash falls in a share that holds 1.5 times the wanted rows, and of these few the first ones
    shares = usable.sparkSession.createDataFrame([(lang, min(1.0, 1.5 * each / n + 20 / n)) for lang, n in found.items()], "lang string, share double")
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h")
    rows = usable.select("lang", "text", hashed).join(F.broadcast(shares), "lang").where(F.col("h") < F.col("share") * (1 << 30))
    rows = rows.groupBy("lang", "h").agg(F.min(excerpt(F.col("text"))).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn: dict[str, list] = {lang: [] for lang in languages}
    for r in rows.withColumn("place", first).where(F.col("place") <= each).select("lang", "text", "h").collect():
        drawn[r["lang"]].append(r)
    x, y = [], []
    for k, lang in enumerate(languages):
        for r in sorted(drawn[lang], key=lambda r: (r["h"], r["text"])):
            w = windows(r["text"].encode("utf-8", "replace"))
            w = w[np.linspace(0, len(w) - 1, min(len(w), WINDOWS)).astype(int)]  # spread over the whole text
            x.append(w)
            y += [k] * len(w)
    xs, ys = np.concatenate(x), np.array(y)
    # windows of a rarer language are repeated, so each weighs alike
    counts = np.bincount(ys, minlength=len(languages))
    pick = np.concatenate([np.resize(np.flatnonzero(ys == k), min(counts.max(), 8 * counts[k])) for k in range(len(languages))])
    steps = -(-len(pick) // 128)
    return languages, Net(len(languages)).fit(xs[pick], ys[pick], epochs=min(60, max(EPOCHS, -(-300 // steps))))


def identify(docs: DataFrame, model: tuple[list[str], Net]) -> DataFrame:
    """(doc_id, text's ``lang_pred`` and ``score``) for every row: und with score 1 for null texts and texts without a letter.

    A map over the rows: no shuffle; null ids and repeated rows are handled row by row, other columns are ignored.
    """
    langs, net = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, net.p))

    def start():
        langs, p = shared.value
        net = Net(len(langs))
        net.p = p

        def f(texts):
            parts = [windows((t or "").encode("utf-8", "replace")) for t in texts]
            counts = np.array([len(w) for w in parts])
            lp = net.log_probabilities(np.concatenate(parts))
            filled = np.concatenate([np.append(np.full(len(w) - 1, WINDOW), np.count_nonzero(w[-1])) for w in parts]).astype(np.float32)[:, None] + 1e-3
            first = np.cumsum(counts) - counts
            p = np.add.reduceat(np.exp(lp) * filled, first) / np.add.reduceat(filled, first)
            best = p.argmax(axis=1)
            return {"guess": pa.array([langs[i] for i in best], pa.string()), "p": pa.array(p[np.arange(len(best)), best].astype(np.float64))}

        return f

    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col("text"))
    return map_texts(rows, "text", "guess string, p double", start).select(
        "doc_id",
        F.when(F.col("lettered"), F.col("guess")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("p")).otherwise(1.0).alias("score"),
    )


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learnt from the documents outside the fold crc32(doc_id) mod 4 = 2."""
    return identify(docs, train(docs)).select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
