"""URLs kept or dropped by rules, and by the ratio of two character language models where no rule fits.

The rules label URLs; a variable-order Markov model is counted over the URLs that they allow, another
over those that they block. A context counts as long as it holds a given share of its model's
characters, so the number of contexts has a bound that doesn't grow with the input. A URL's score is
the difference of its log-likelihoods over its length; a logistic curve, fitted on labelled URLs that
the models haven't seen, makes it a probability of being blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimill.llm.arrow import fresh, map_texts, slices
from sentimill.sources.shared import cut

#: Longest sequence counted, its last character included: bytes of UTF-8, so that a sequence and its length are one exact 64-bit key.
ORDER = 6
#: A sequence is kept where it has this share of its model's characters: at most ORDER / SHARE a model.
SHARE = 2.0**-16
#: One labelled URL of so many is held back from the models for the calibration.
FOLDS = 5
#: Score differences are calibrated by counts in bins of 1 / BINS_PER_UNIT. A difference is a mean of log ratios, each of which has at most ORDER + 1 factors of at least 1 / 2^64: the bins are bounded without a cut.
BINS_PER_UNIT = 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): from the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; from there to ``?``, ``#`` or the end. Both empty for null and where no ``://`` is."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule text (host, then path) that fits; of equally long ones that of the longer host. Null where none fits.

    A rule fits its host and that host's subdomains where the path starts with the rule's. Rules are a
    short list that becomes one expression.
    """
    if not rules:
        return F.lit(None).cast("string")
    split = sorted(((text.partition("/")[0], text) for _, text in rules), key=lambda r: (-len(r[1]), -len(r[0]), r[1]))
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(text[len(h) :]), F.lit(text)) for h, text in split]
    return F.coalesce(*fits)


def gram_keys(urls: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length 1..ORDER the keys of the sequences that end at every character and at the end mark of every URL, in order; and how many those are for each URL.

    A key is the length, then the bytes; what comes before a URL's start counts as zeros.
    """
    raws = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    lead = b"\0" * (ORDER - 1)
    padded = np.frombuffer(b"".join(x for r in raws for x in (lead, r, b"\0")), np.uint8)
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    first = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    keys, key = [], np.zeros(len(at), np.uint64)
    for n in range(1, ORDER + 1):
        key = key | (padded[at - n + 1].astype(np.uint64) << np.uint64(8 * (n - 1)))
        keys.append(key | np.uint64(n << 56))
    return keys, sizes


def _context(key: np.ndarray, n: int) -> np.ndarray:
    """Keys of what stands before the last character of sequences of length ``n``."""
    return ((key & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | np.uint64((n - 1) << 56)


def _suffix(key: np.ndarray, n: int) -> np.ndarray:
    """Keys of sequences of length ``n`` without their first character."""
    return (key & np.uint64((1 << (8 * (n - 1))) - 1)) | np.uint64((n - 1) << 56)


@dataclass
class Model:
    """Log ratios of allowed to blocked: by kept sequence, and by context for what was never seen after it."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def differences(self, urls: list[str | None]) -> np.ndarray:
        """Log-likelihood as an allowed less that as a blocked URL, over the number of characters, the end mark included."""
        grams, sizes = gram_keys(urls)
        if not len(sizes) or not len(self.keys):
            return np.zeros(len(sizes))
        total, known = np.zeros(len(grams[0])), np.ones(len(grams[0]), bool)
        for n, key in enumerate(grams, 1):
            k = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            known &= self.keys[k] == key  # a kept sequence's endings are kept too
            total[known] = self.ratio[k[known]]
            unseen = np.flatnonzero(~known)
            context = _context(key[unseen], n)
            c = np.searchsorted(self.contexts, context).clip(max=len(self.contexts) - 1)
            total[unseen] += np.where(self.contexts[c] == context, self.backoff[c], 0.0)
        return np.add.reduceat(total, np.cumsum(sizes) - sizes) / sizes

    def p_block(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.slope * d - self.offset, -50, 50)))


def fit_grams(keys: np.ndarray, allowed: np.ndarray, blocked: np.ndarray) -> Model:
    """The model of kept sequences and their counts (0 where a model doesn't keep one): Witten-Bell smoothing from shorter contexts, the shortest from 256 equal bytes."""
    order = np.argsort(keys)
    keys, counts = keys[order], (allowed[order].astype(float), blocked[order].astype(float))
    lengths = (keys >> np.uint64(56)).astype(int)
    p, contexts, backoff = np.zeros((2, len(keys))), [], []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(lengths == n)
        if not len(at):
            continue
        context, of = np.unique(_context(keys[at], n), return_inverse=True)
        shorter = np.searchsorted(keys, _suffix(keys[at], n))
        weights = []
        for y in range(2):
            mass = np.bincount(of, counts[y][at], len(context))
            kinds = np.bincount(of, counts[y][at] > 0, len(context))
            lower = p[y][shorter] if n > 1 else 1 / 256
            p[y][at] = np.where(mass[of] > 0, (counts[y][at] + kinds[of] * lower) / np.maximum(mass + kinds, 1)[of], lower)
            weights.append(np.where(mass > 0, kinds / np.maximum(mass + kinds, 1), 1.0))
        contexts.append(context)
        backoff.append(np.log(weights[0]) - np.log(weights[1]))
    none = [np.zeros(0)]
    return Model(keys, np.log(p[0]) - np.log(p[1]), np.concatenate(contexts or [np.zeros(0, np.uint64)]), np.concatenate(backoff or none))


def calibrate(d: np.ndarray, blocked: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(blocked) = 1 / (1 + exp(slope * d - offset)): Platt's fit with softened targets, by Newton steps over weighted bins."""
    ones, zeros = float(weight[blocked].sum()), float(weight[~blocked].sum())
    target = np.where(blocked, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([-d, np.ones(len(d))], 1)
    b = np.array([0.0, np.log((ones + 1) / (zeros + 1))])

    def loss(b):
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (target - p)))
        scale = 1.0
        while scale > 1e-6 and loss(b + scale * step) > loss(b):
            scale /= 2
        b = b + scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", share: float = SHARE) -> Model:
    """The calibrated model of distinct labelled URLs (``blocked``: true or false; nulls are left out; a URL with both labels counts in both).

    Sequences of all labelled URLs are counted on the cluster; the driver gets those that hold
    ``share`` of their model's characters (at most 2 * ORDER / share) and a histogram of bounded width.
    Where one label has no URLs, every score says the other one; without any labels, that nothing is blocked.
    """
    rows = labelled.where(F.col(blocked).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(blocked).alias("blocked")).distinct()
    rows = cut(rows.withColumn("held", F.crc32("url") % FOLDS == 0))
    size = F.octet_length("url") + 1
    sides = {r["blocked"]: r for r in rows.groupBy("blocked").agg(F.sum(F.when(~F.col("held"), size)).alias("mass"), F.count_if("held").alias("held")).collect()}
    one_sided = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), 0.0, 50.0 if True in sides else -50.0)
    if len(sides) < 2:
        return one_sided
    split = all(r["held"] and r["mass"] for r in sides.values())  # too few of a side to hold any back: it is counted and calibrated on all
    learnt = rows.where(~F.col("held")) if split else rows
    least = {y: max(1, -int(-(r["mass"] or 0) * share // 1)) for y, r in sides.items()}

    def count(batches):
        for batch in batches:
            for part, urls in slices(batch, "url"):
                y = part.column("blocked").to_numpy(zero_copy_only=False).astype(bool)
                keys, sizes = gram_keys(urls)
                of = np.repeat(y, sizes)
                found = [np.unique(np.concatenate([k[of == side] for k in keys]), return_counts=True) for side in (False, True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.repeat([False, True], [len(k) for k, _ in found])), pa.array(np.concatenate([c for _, c in found]))],
                    names=["key", "blocked", "n"],
                )

    side = [F.sum(F.when(F.col("blocked") == F.lit(y), F.col("n"))).alias(f"n{int(y)}") for y in (False, True)]
    counts = learnt.mapInArrow(count, "key bigint, blocked boolean, n bigint").groupBy("key").agg(*side)
    kept = [F.when(F.col(f"n{int(y)}") >= least[y], F.col(f"n{int(y)}")).otherwise(0).alias(f"n{int(y)}") for y in (False, True)]
    grams = counts.select("key", *kept).where(F.greatest("n0", "n1") > 0).toArrow()  # at most 2 * ORDER / share rows
    model = fit_grams(*(grams.column(c).to_numpy() if c != "key" else grams.column(c).to_numpy().view(np.uint64) for c in ("key", "n0", "n1")))
    bins = map_texts(rows.where("held") if split else rows, "url", "bin int", lambda: lambda urls: {"bin": _bins(model.differences(urls))})
    told = bins.groupBy("bin", "blocked").count().toArrow()
    model.slope, model.offset = calibrate(told.column("bin").to_numpy() / BINS_PER_UNIT, told.column("blocked").to_numpy().astype(bool), told.column("count").to_numpy().astype(float))
    return model


def _bins(d: np.ndarray) -> pa.Array:
    return pa.array(np.round(d * BINS_PER_UNIT).astype(np.int32))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", share: float = SHARE) -> DataFrame:
    """``pages`` with host, path, rule, p_block and verdict (allow, block) of every row's ``url``.

    ``rules`` are (verdict, host with path). A row takes its rule's verdict, else block where the
    models, learnt from the URLs that the rules decide, give it 0.5 or more. A null URL has empty
    parts and is scored as an empty one; repeated rows are learnt from once and all judged; own columns
    with a new one's name are replaced. Without any row that a rule fits, nothing is blocked.
    """
    new = ("host", "path", "rule", "p_block", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in new and c != url])
    host, path = url_parts(F.col(url))
    ruled = pages.withColumn("host", host).withColumn("path", path)
    ruled = ruled.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    bad = [text for verdict, text in rules if verdict == "block"]
    labelled = ruled.where(F.col("rule").isNotNull()).select(F.col(url).alias("url"), F.col("rule").isin(bad).alias("blocked"))
    model = train(labelled, share=share)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    raw = fresh(ruled, "_url")

    def start():
        m = shared.value
        return lambda urls: {"p_block": pa.array(m.p_block(m.differences(urls)))}

    scored = map_texts(ruled.withColumn(raw, F.col(url)), raw, "p_block double", start)
    return scored.withColumn("verdict", F.when(F.coalesce(F.col("rule").isin(bad), F.col("rule").isNull() & (F.col("p_block") >= 0.5)), "block").otherwise("allow"))
