"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words counts the subsequences of three characters that they share, each discounted
by the length it spans in either word, so that gaps and inserted characters cost a factor and not the
match; it is normalised by both words' own kernels. Landmark words are drawn from the labelled
sentences, and a word's Nystroem features are its kernels with them, whitened. A text's margin is
that of its worst word; the machine is trained by alternating between picking each toxic
document's witness words and fitting the margins. Plainly toxic words are also taught in altered forms
(letters and signs put in, letters doubled), and the forms take part in the choice of the threshold, so
that a word still counts as toxic after one such change.

The decision is linear in the kernels, and a kernel is an inner product over character triples. So the
trained landmarks fold, without loss, into one weight a triple, and scoring a word needs no pass over
the landmarks.
"""

from __future__ import annotations

import re
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimill.llm.arrow import crc_bucket, fresh, map_texts, slices
from sentimill.llm.labelled import sample_labels, sampled
from sentimill.llm.simhash import fingerprint

ORDER = 3
DECAY = 0.7
#: Codes of characters: 0 stands for what is no letter or digit (it spans, but matches nothing), 1-26 a-z, 27-36 digits, 37-61 other letters by remainder, 62 a word's end, 63 its start.
ALPHABET = 64
END, START = b"\x3e", b"\x3f"
#: A longer word is read as its overlapping pieces of WIDEST characters, STRIDE apart, in training as in scoring.
WIDEST, STRIDE = 22, 11
#: Landmarks, sampled documents of each class, and words that a task remembers.
LANDMARKS, PER_CLASS, MEMO_WORDS = 320, 1500, 150_000
#: Altered forms of a plainly toxic word: places where a letter is put in, doubled, and a sign is put in; their weight beside that of
#: the words themselves when the threshold is set.
INSERTED, DOUBLED, SIGNED = 40, 4, 2
FORMS_SHARE = 1.5
#: How much more a clean word that looks toxic weighs in the next turn.
HARDER = 50.0
#: Evidence (log-likelihood ratio) from which a word is plainly toxic; bits within which sampled documents count as copies.
PLAINLY, COPY_BITS = 9.0, 12
#: Digits and signs that stand in for letters, as fixed values.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "“”‘’«»…–—¿¡"
SPELT = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][.\-_*,]?\s{1,2}){3,}[^\W_](?=[\s.!?,;:]|$)")
SPELT_HINT = re.compile(r"(?:^|\s)\w[^\w\s]?\s+\w[^\w\s]?\s+\w[^\w\s]?\s")


class _Codes(dict):
    """Character to the character whose number is its code, for ``str.translate``."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        if "a" <= c <= "z":
            code = n - 96
        elif "0" <= c <= "9":
            code = n - 21
        else:
            code = 37 + n % 25 if n >= 128 and c.isalpha() else 0
        self[n] = chr(code)
        return self[n]


_PLAIN = _Codes()
_LETTERED = _Codes({ord(k): _PLAIN[ord(v)] for k, v in STAND_INS.items()})
_LETTER = re.compile(r"[^\W\d_]")


def codes(word: str) -> bytes:
    """Character codes of a lower-cased word between its start and end; stand-ins count as letters in words that have letters."""
    return START + word.translate(_PLAIN if word.isalpha() or not _LETTER.search(word) else _LETTERED).encode("latin-1") + END


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words without the signs at their edges, and what runs of single spaced-out characters spell; long words as pieces."""
    text = text.lower()
    out = {w.strip(EDGES) for w in set(text.split())}
    if SPELT_HINT.search(text):
        out.update("".join(c for c in m[0] if c.isalnum()) for m in SPELT.finditer(text))
    out.discard("")
    for w in [w for w in out if len(w) > WIDEST]:
        out.remove(w)
        out.update(w[i : i + WIDEST] for i in range(0, len(w) - WIDEST + STRIDE, STRIDE))
    return out


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples i < j < k of a word of n characters, and the discount of what each spans."""
    if n not in _TRIPLES:
        t = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        _TRIPLES[n] = (t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float64))
    return _TRIPLES[n]


def _features(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, rows of codes: the triple ids and their discounts (0 where a character matches nothing)."""
    t, d = _triples(c.shape[1])
    a, b, e = c[:, t[:, 0]], c[:, t[:, 1]], c[:, t[:, 2]]
    ids = (a * ALPHABET + b) * ALPHABET + e
    return ids, np.where((a > 0) & (b > 0) & (e > 0), d, 0.0)


def _norms(c: np.ndarray) -> np.ndarray:
    """Square roots of the words' own kernels, by the kernel's recursion over both words' characters at once."""
    m, n = c.shape
    same = (c[:, :, None] == c[:, None, :]) & (c[:, :, None] > 0)
    k = np.ones((m, n + 1, n + 1))
    for _ in range(ORDER - 1):  # k[i, j]: discounted matches of the next order within the first i and j characters
        ends = np.zeros((m, n + 1, n + 1))
        for i in range(1, n + 1):
            run = np.zeros(m)
            for j in range(1, n + 1):
                run = DECAY * run + DECAY**2 * same[:, i - 1, j - 1] * k[:, i - 1, j - 1]
                ends[:, i, j] = DECAY * ends[:, i - 1, j] + run
        k = ends
    return np.sqrt((DECAY**2 * same * k[:, :-1, :-1]).sum(axis=(1, 2)))


def sparse(word: str) -> tuple[np.ndarray, np.ndarray]:
    """One word's normalised feature vector as (triple ids, values)."""
    c = np.frombuffer(codes(word), np.uint8).astype(np.int64)[None]
    if c.shape[1] < ORDER:
        return np.empty(0, np.int64), np.empty(0)
    ids, d = _features(c)
    u, inverse = np.unique(ids[0], return_inverse=True)
    v = np.bincount(inverse, weights=d[0])
    norm = np.sqrt((v * v).sum())
    keep = v > 0
    return (u[keep], v[keep] / norm) if norm else (np.empty(0, np.int64), np.empty(0))


def kernel(a: str, b: str) -> float:
    """Normalised subsequence kernel of two words."""
    ia, va = sparse(a)
    ib, vb = sparse(b)
    _, x, y = np.intersect1d(ia, ib, return_indices=True)
    return float(va[x] @ vb[y])


class Model:
    """Folded machine: ``triples`` has one weight a character triple, margins are calibrated by a logistic."""

    def __init__(self):
        self.triples = np.zeros(ALPHABET**ORDER, np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, -1.0
        self.kernels: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; the bias at least, which is what a word without matches has."""
        out = np.full(len(words), self.bias)
        by_size: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, w in enumerate(words):
            c = codes(w)
            at = by_size.setdefault(len(c), ([], []))
            at[0].append(i)
            at[1].append(c)
        for size, (rows, parts) in by_size.items():
            if size < ORDER:
                continue
            t, d = _triples(size)
            step = max(1, 1_500_000 // len(t))
            for k in range(0, len(rows), step):
                c = np.frombuffer(b"".join(parts[k : k + step]), np.uint8).reshape(-1, size)
                wide = c.astype(np.int32)
                ids = (wide * (ALPHABET * ALPHABET))[:, t[:, 0]] + (wide * ALPHABET)[:, t[:, 1]] + wide[:, t[:, 2]]
                s = self.triples.take(ids) @ d  # triples with a character that matches nothing weigh 0
                up = np.flatnonzero(s > 0)  # others can't rise over the bias
                if len(up):
                    np.maximum.at(out, np.array(rows[k : k + step])[up], s[up] / np.maximum(_norms(c[up]), 1e-9) + self.bias)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def fit(self, texts: list[str], y: list[int], **how) -> Model:
        return self.fit_words([sorted(words_of(t)) for t in texts], y, [fingerprint(t.encode("utf-8", "replace")) for t in texts], **how)

    def fit_words(self, words: list[list[str]], y: list[int], prints: list[int], seed: int = 5, rounds: int = 3, most_clean: int = 14_000, most_suspects: int = 4_000) -> Model:
        """Landmarks, Nystroem features, and the alternation of witnesses and margins, from labelled texts' distinct words and SimHashes.

        Training words are at most ``most_clean`` drawn words of clean documents and the ``most_suspects``
        words of the strongest evidence that no clean document has: with the bound on documents, what
        keeps the matrix of the machine bounded. Words under three characters have no kernel and can't be
        toxic; those of one to three letters have no altered forms. Where no word is plainly toxic, the
        ten likeliest stand in; where none is likelier in toxic documents, every score is the same.
        """
        r = np.random.default_rng(seed)
        kept = _without_copies(prints)
        words, y = [words[i] for i in kept], np.array([y[i] for i in kept])
        docs = [[w for w in d if len(w) >= ORDER] for d in words]
        held: dict[str, list[int]] = {}
        for d, label in zip(docs, y, strict=True):
            for w in d:
                held.setdefault(w, [0, 0])[label] += 1
        n = np.maximum(np.bincount(y, minlength=2), 1)
        share = n[1] / n.sum()
        evidence, more = {}, {}
        for w, (c0, c1) in held.items():
            c = c0 + c1
            more[w] = c1 > c * share
            evidence[w] = (c1 * np.log(max(c1, 1e-9) / (c * share)) + c0 * np.log(max(c0, 1e-9) / (c * (1 - share)))) * (1 if more[w] else -1)
        toxic = sorted((w for w in held if evidence[w] > PLAINLY and held[w][0] < 0.1 * held[w][1]), key=lambda w: (-evidence[w], w))[: LANDMARKS // 2]
        if not toxic:
            toxic = sorted((w for w in held if evidence[w] > 0 and held[w][0] < held[w][1]), key=lambda w: (-evidence[w], w))[:10]
        rest = sorted(w for w in held if held[w][0])
        common = sorted(rest, key=lambda w: (-held[w][0], w))[: LANDMARKS // 4]
        drawn = [rest[i] for i in r.choice(len(rest), min(len(rest), LANDMARKS - len(toxic) - len(common)), replace=False)] if rest else []
        landmarks = [w for w in dict.fromkeys(toxic + common + drawn) if len(sparse(w)[0])]
        if not toxic or not landmarks:
            return self
        # training words: clean documents' words, toxic documents' words that no clean one has, and altered forms of the plainly toxic
        rest = [w for w in rest if w not in set(toxic)]
        clean = [rest[i] for i in np.sort(r.choice(len(rest), min(len(rest), most_clean), replace=False))]
        suspects = sorted((w for w in held if held[w][0] == 0), key=lambda w: (-evidence[w], w))[:most_suspects]
        altered = {w: [x for x in _altered(w, r) if x not in held] for w in toxic}
        names = list(dict.fromkeys(toxic + suspects + clean + [x for xs in altered.values() for x in xs]))
        place = {w: i for i, w in enumerate(names)}
        vectors = [(i.astype(np.int32), v.astype(np.float32)) for i, v in map(sparse, names)]
        # a word weighs as the share of its class's documents that have it, its altered forms together as much
        weight = np.array([held[w][1] / n[1] if held.get(w, (0, 0))[1] and not held[w][0] or w in set(toxic) else held[w][0] / n[0] if w in held else 0.0 for w in names])
        for w, xs in altered.items():
            weight[[place[x] for x in xs]] = held[w][1] / n[1] / max(1, len(xs))
        negative = np.zeros(len(names), bool)
        negative[[place[w] for w in clean]] = True
        witness = {place[w] for w in toxic}
        for turn in range(rounds):
            used, basis, whiten = _nystroem(landmarks)
            x = None  # one matrix at a time
            x = _whitened(vectors, used, basis, whiten)
            sure = {names[i] for i in witness}
            positive = np.zeros(len(names), bool)
            positive[list(witness)] = True
            positive[[place[z] for w, xs in altered.items() if w in sure for z in xs]] = True
            usable = positive | negative
            v, bias = _svm(x, np.where(positive, 1.0, -1.0), np.where(usable, weight, 0.0))
            margin = x @ np.append(v, bias)
            found = {place[w] for w in toxic}
            for d, label in zip(docs, y, strict=True):
                at = [place[w] for w in d if label and w in place and not negative[place[w]]]
                if at and max(margin[at]) > 0.5:  # the document's worst word
                    found.add(max(at, key=lambda i: margin[i]))
            # clean words that look worst become landmarks of the next turn, so they can be told from what they resemble
            hard = [names[i] for i in np.argsort(-np.where(negative, margin, -np.inf), kind="stable")[: LANDMARKS // 4] if margin[i] > -0.5]
            if turn + 1 < rounds:
                witness, landmarks = found, list(dict.fromkeys(landmarks + hard))
                weight[[place[w] for w in hard]] *= HARDER
        beta = whiten @ v
        self.triples[used] = (basis.T @ beta).astype(np.float32)
        self.kernels = dict(zip(landmarks, beta.tolist(), strict=True))
        self.bias = float(bias)
        margin = self._worst(words, {})
        forms = [x for w in sorted(sure) for x in altered.get(w, ())]
        counted = np.full(len(y), 1 / len(y))
        if forms:
            counted = np.append(counted, np.full(len(forms), FORMS_SHARE * share / len(forms)))
            margin, y = np.append(margin, self.margins(forms)), np.append(y, np.ones(len(forms), int))
        self._calibrate(margin, y, counted)
        return self

    def document_margins(self, texts: list[str | None], memo: dict[str, float] | None = None) -> np.ndarray:
        """The margin of each text's worst word over all its sentences; texts without words have the bias."""
        memo = {} if memo is None else memo
        return self._worst([words_of(t) if t else set() for t in texts], memo)

    def _worst(self, sets: list, memo: dict[str, float]) -> np.ndarray:
        new = list(set().union(*sets).difference(memo)) if sets else []
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(set().union(*sets))
        memo.update(zip(new, self.margins(new).tolist(), strict=True))
        out = np.array([max(map(memo.__getitem__, s), default=self.bias) for s in sets], float)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return out

    def _calibrate(self, margin: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
        """A logistic of weighted margins, by Newton steps."""
        f = np.stack([margin, np.ones(len(y))], axis=1)
        w = np.array([2.0, 0.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            h = (f * (c * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            w = w + np.clip(np.linalg.solve(h, f.T @ (c * (y - p)) - 1e-3 * (w - np.array([2.0, 0.0]))), -1, 1)
        self.slope, self.shift = max(float(w[0]), 0.5), float(w[1])


def _without_copies(prints: list[int]) -> list[int]:
    """Places of one of each group of near copies in the sample: a copied text would make its chance words look toxic."""
    prints = np.array(prints, np.uint64)
    keep: list[int] = []
    for i in range(len(prints)):
        if not keep or int(np.bitwise_count(prints[keep] ^ prints[i]).min()) > COPY_BITS:
            keep.append(i)
    return keep


def _altered(word: str, r: np.random.Generator) -> list[str]:
    """Forms of a word with a letter put in, a letter doubled or a sign put in at one place, and one with a sign at all places."""
    n = len(word)
    if n <= ORDER:
        return []
    places = lambda most, k: sorted({int(x) for x in r.integers(1, most, k)})
    out = [word[:at] + chr(97 + int(r.integers(26))) + word[at:] for at in places(n, INSERTED)]
    out += [word[:at] + word[at - 1] + word[at:] for at in places(n + 1, DOUBLED)]
    return [*out, *(word[:at] + "." + word[at:] for at in places(n, SIGNED)), ".".join(word)]


def _nystroem(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples that the landmarks use, the landmarks over them, and the matrix that whitens kernels with the landmarks."""
    vectors = [sparse(w) for w in landmarks]
    used = np.unique(np.concatenate([i for i, _ in vectors]))
    basis = np.zeros((len(landmarks), len(used)))
    for row, (i, v) in zip(basis, vectors, strict=True):
        row[np.searchsorted(used, i)] = v
    values, axes = np.linalg.eigh(basis @ basis.T)
    return used, basis, axes / np.sqrt(np.maximum(values, 1e-3))  # of nearly equal landmarks only the shared direction counts


def _whitened(vectors: list[tuple[np.ndarray, np.ndarray]], used: np.ndarray, basis: np.ndarray, whiten: np.ndarray, step: int = 2000) -> np.ndarray:
    """Nystroem features of words, some rows at a time, and a constant."""
    out = np.ones((len(vectors), len(basis) + 1))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        k = np.zeros((len(part), len(basis)))
        for i, (ids, v) in enumerate(part):
            place = np.searchsorted(used, ids)
            ok = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == ids)
            k[i] = basis[:, place[ok]] @ v[ok]
        out[at : at + step, :-1] = k @ whiten
    return out


def _svm(f: np.ndarray, t: np.ndarray, weight: np.ndarray, c: float = 300.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the primal; the last feature is constant, rows of no weight take no part."""
    w = np.zeros(f.shape[1])
    ridge = np.eye(f.shape[1]) * 0.05
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(steps):
        now = (1 - t * (f @ w) > 0) & (weight > 0)
        if active is not None and np.array_equal(now, active):
            break
        active = now
        left, right = ridge.copy(), np.zeros(f.shape[1])
        for at in np.array_split(np.flatnonzero(now), 1 + int(now.sum()) // 2000):
            a = f[at] * (c * weight[at])[:, None]
            left += a.T @ f[at]
            right += a.T @ t[at]
        w = np.linalg.solve(left, right)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    """A model from up to ``per_class`` labelled documents of each class outside the held-out fold; with one class or none every score is the same.

    Whole texts are learnt from, whatever their length: tasks reduce them to their distinct words, and only those reach the driver.
    """

    def task(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = pa.array(["\n".join(sorted(words_of(t))) for t in texts], pa.string())
                prints = pa.array(np.array([fingerprint(t.encode("utf-8", "replace")) for t in texts], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), words, prints], names=["doc_id", "y", "words", "print"])

    sample = sampled(docs, sample_labels(labels, "toxic", folds, held_out, per_class))
    rows = sample.mapInArrow(task, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, words string, print long").orderBy("doc_id").collect()
    if len({r["y"] for r in rows}) < 2:
        return Model()
    y, prints = [r["y"] for r in rows], [r["print"] % (1 << 64) for r in rows]
    words = [[sys.intern(w) for w in r["words"].split("\n")] if r["words"] else [] for r in rows]  # texts share their words' memory
    del rows
    return Model().fit_words(words, y, prints)


def score(docs: DataFrame, model: Model, into: str = "score", keep: bool = False) -> DataFrame:
    """(doc_id, ``into``) for every row, or all columns of ``docs`` and ``into`` (a name of its own) with ``keep``.

    A map over the rows: no shuffle, memory of one Arrow batch and a bounded memo. Null and empty
    texts have the score of no words; null ids and repeated rows are scored row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = fresh(docs, "_scored_text") if keep else "text"
    rows = docs.withColumn(scored, F.col("text")) if keep else docs.select("doc_id", "text")

    def start():
        model, memo = shared.value, {}
        return lambda texts: {into: pa.array(model.probability(model.document_margins(texts, memo)), pa.float64())}

    return map_texts(rows, scored, f"`{into}` double", start)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the fold crc32(doc_id) mod 5 = 0 are not learnt from."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
