"""Collocations: frequent phrases whose weakest cut is still far above chance.

Which phrases are frequent is found in two passes. The first one summarises hashed n-grams by
Misra-Gries counters, one summary for each hash partition: tasks send lossless partial counts, a
reducer merges them and, beyond its capacity, takes the same amount off all counters. As the capacity
exceeds the partition's mass over the threshold, less than the threshold is taken off in all, so every
frequent n-gram survives. The second pass counts only what survived, by its words and exactly.
A bitmap of fixed size says what survived; its false hits cost work, never a wrong count.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from string import ascii_lowercase, ascii_uppercase
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimill.llm.arrow import raw_slices
from sentimill.operators.components import join_unique
from sentimill.sources.shared import cut

#: Bytes that part phrases, bytes that part words within them.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Parts in which each language is ranked before its first rows are put together.
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(ascii_uppercase.encode())] = list(ascii_lowercase.encode())
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


@dataclass(frozen=True)
class Limits:
    """What bounds a task: text tokenised at a time, n-grams and phrases held before their partial counts go out, a reducer's summary, and what is broadcast."""

    run_bytes: int = 2_000_000
    held: int = 1 << 21
    held_phrases: int = 250_000
    #: N-grams for a hash partition, and counters above what the threshold asks for; mass * slack / threshold counters are a reducer's memory.
    mass: int = 1 << 26
    slack: int = 4
    #: Bits of a bitmap of survivors (8 MB); with more survivors than a few tenths of that, later passes filter less.
    bits: int = 1 << 26


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all hang on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(b: bytes) -> int:
    return int.from_bytes(blake2b(b, digest_size=8).digest(), "little")


@dataclass
class Words:
    """The words of a run of texts, in order; ``key`` hashes a word with its language."""

    text: bytes
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    key: np.ndarray

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]]

    def same_piece(self, n: int) -> np.ndarray:
        """For each start of ``n`` words: whether they stand in one piece."""
        return self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :]

    def grams(self, n: int, shorter: np.ndarray) -> np.ndarray:
        """Keys of all ``n`` words in a row from those of ``n - 1``."""
        return mix(shorter[: max(0, len(self.key) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + self.key[n - 1 :] + np.uint64(n))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(one place of each distinct word and language, the index of it for each word), exact: equal keys are compared by bytes."""
        _, first, of = np.unique(self.key, return_index=True, return_inverse=True)
        model = first[of]
        size = self.end - self.start
        alike = (self.head == self.head[model]) & (self.tail == self.tail[model]) & (size == size[model]) & (self.lang == self.lang[model])
        long = np.flatnonzero((size > 16) & (model != np.arange(len(model))))
        if alike.all() and all(self.word(i) == self.word(m) for i, m in zip(long.tolist(), model[long].tolist(), strict=True)):
            return first, of
        seen: dict = {}
        of = np.array([seen.setdefault((self.lang[i], self.word(i)), len(seen)) for i in range(len(size))])
        return np.unique(of, return_index=True)[1], of


def read_words(texts: list[bytes], langs: np.ndarray, lang_keys: np.ndarray) -> Words:
    """Words of texts; ``langs`` indexes ``lang_keys``, a 64-bit number for each language."""
    text = b"\n".join(texts)
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 0
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.flatnonzero(kind == 2)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lang = langs[np.searchsorted(first, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
    size = end - start
    padded = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    head = eights[start + 8].reshape(-1).view(np.uint64) & _FIRST[np.minimum(size, 8)]
    tail = eights[end].reshape(-1).view(np.uint64) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, 8).astype(np.uint64))
    lower = raw.tobytes()
    key = mix(head + mix(tail + mix(size.astype(np.uint64) + (lang_keys[lang] if len(lang) else np.zeros(0, np.uint64)))))
    long = np.flatnonzero(size > 16)
    key[long] += np.array([_digest(lower[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], np.uint64)
    return Words(lower, start, end, np.searchsorted(breaks, start), lang, head, tail, key)


def _each(batches, f, run_bytes: int):
    """What ``f(words, language names)`` gives for every run of rows (text, lang)."""
    for batch in batches:
        for part, texts in raw_slices(batch, "text", run_bytes):
            coded = part.column("lang").fill_null("und").dictionary_encode()
            names = coded.dictionary.to_pylist()
            keys = np.array([_digest(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64)
            yield f(read_words(texts, coded.indices.to_numpy(), keys), names)


def places(key: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Bits of a bitmap for keys, by what a hash partition's summary knows of them."""
    return _place(_partitioned(key, parts), bits)


def _place(partitioned: np.ndarray, bits: int) -> np.ndarray:
    return (mix(partitioned) & np.uint64(bits - 1)).astype(np.int64)


def _partitioned(key: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition in the upper half, 32 other bits of the key in the lower."""
    return (((key >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def bitmap(rows: DataFrame, place: str, bits: int) -> np.ndarray:
    """The bitmap of a column's places: bits / 8 bytes, whatever the number of rows; ``bits`` is a multiple of 2^15."""
    v = F.col(place) + 1
    buckets = rows.select(F.bitmap_bucket_number(v).alias("bucket"), F.bitmap_bit_position(v).alias("bit")).repartition("bucket")
    out = np.zeros(bits // 8, np.uint8)
    for r in buckets.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class Summary:
    """Misra-Gries counters of 32-bit keys. ``taken`` is what has been taken off every counter: a key counted more often is held, its counter at most ``taken`` short."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Take in another summary's counters, and what it has taken off."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        self.taken += taken
        if self.n_waiting >= max(1 << 18, self.capacity):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > off], counts[counts > off] - off
            self.taken += off
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may have been counted ``threshold`` times; all that have been, where ``taken`` is below it."""
        self.settle()
        return self.keys[self.counts + self.taken >= threshold]


def _partial_counts(held: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Distinct keys by hash partition with their counts: those seen once first, then the others with a number each."""
    keys, counts = np.unique(_partitioned(np.concatenate(held), parts), return_counts=True)
    part = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
        k, c = keys[a:b].astype(np.uint32), counts[a:b]
        rows.append((int(part[a]), np.concatenate([k[c == 1], k[c > 1]]).tobytes(), c[c > 1].astype(np.int64).tobytes()))
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["part", "keys", "counts"])


def frequent_grams(rows: DataFrame, grams_of, mass: int, threshold: int, limits: Limits) -> tuple[np.ndarray, int]:
    """(bitmap, hash partitions) of all n-grams that ``grams_of(words)`` gives at least ``threshold`` times, and of few others.

    ``mass`` is at least their number. Hash partitions grow with it, so a summary's memory doesn't. A
    summary that had to take off as much as the threshold (n-grams dealt very unevenly) guarantees
    nothing; the pass is then made again over twice as many partitions.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mass // limits.mass))
    for _ in range(6):
        capacity = max(4096, limits.slack * mass // parts // threshold + 1)

        def count(batches, parts=parts):
            held, n = [], 0
            for keys in _each(batches, lambda w, _: grams_of(w), limits.run_bytes):
                held.append(keys)
                n += len(keys)
                if n >= limits.held:
                    yield _partial_counts(held, parts)
                    held, n = [], 0
            if n:
                yield _partial_counts(held, parts)

        def reduce(batches, parts=parts, capacity=capacity):
            def done():
                k = summary.survivors(threshold).astype(np.uint64) | np.uint64(now << 32)
                place = _place(k, limits.bits)
                yield pa.RecordBatch.from_arrays([pa.array([*place, None], pa.int64()), pa.array([*[None] * len(place), summary.taken], pa.int64())], names=["place", "taken"])

            now, summary = None, Summary(capacity)
            for batch in batches:
                for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
                    if part != now:
                        if now is not None:
                            yield from done()
                        now, summary = part, Summary(capacity)
                    k, c = np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.int64)
                    summary.merge(k, np.concatenate([np.ones(len(k) - len(c), np.int64), c]))
            if now is not None:
                yield from done()

        partial = rows.mapInArrow(count, "part int, keys binary, counts binary")
        kept = cut(partial.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(reduce, "place bigint, taken bigint"))
        if (kept.agg(F.max("taken")).first()[0] or 0) < threshold:
            return bitmap(kept.where(F.col("place").isNotNull()), "place", limits.bits), parts
        parts *= 2
    raise RuntimeError("frequent_grams: summaries took off as much as the threshold")


def _word_counts(rows: DataFrame, limits: Limits) -> DataFrame:
    """(lang, phrase, place, f): every word's number of occurrences; phrase null: all words of the language."""

    def task(batches):
        def f(w, names):
            one, of = w.ids()
            n = np.bincount(of, minlength=len(one))
            lang = w.lang[one]
            total = np.bincount(w.lang, minlength=len(names))
            words = [w.word(i) for i in one.tolist()]
            place = places(w.key[one], 1 << 32, limits.bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*(names[i] for i in lang.tolist()), *names], pa.string()),
                    pa.array([*words, *[None] * len(names)], pa.binary()).cast(pa.string()),
                    pa.array(np.append(place, np.zeros(len(names), np.int64))),
                    pa.array(np.append(n, total)),
                ],
                names=["lang", "phrase", "place", "f"],
            )

        yield from _each(batches, f, limits.run_bytes)

    return rows.mapInArrow(task, "lang string, phrase string, place bigint, f bigint").groupBy("lang", "phrase", "place").agg(F.sum("f").alias("f"))


def _phrase_counts(rows: DataFrame, longest: int, pairs, more, threshold: int, limits: Limits) -> DataFrame:
    """(lang, phrase, words, f): exact numbers of occurrences, ``threshold`` or more, of the phrases that survived the first pass.

    Tasks send partial counts by hash partition; as a summary bounds what survives of a partition, what is merged of it at a time is bounded too.
    """

    def task(batches):
        def found(w, names):
            one, of = w.ids()
            out, spelt = [], {}
            key, ok = w.key, None
            for n in range(2, longest + 1):
                key = w.grams(n, key)
                ok = w.same_piece(n) if ok is None else ok[: len(key)] & w.same_piece(n)
                bits, parts = (pairs if n == 2 else more).value
                at = np.flatnonzero(ok)
                at = at[has(bits, places(key[at], parts, limits.bits))]
                ids, u = of[at], at
                for k in range(1, n):
                    u, ids = np.unique(ids * len(one) + of[at + k], return_inverse=True)
                _, first, count = np.unique(ids, return_index=True, return_counts=True)
                for i, c in zip(at[first].tolist(), count.tolist(), strict=True):
                    for x in (i + k for k in range(n)):
                        if of[x] not in spelt:
                            spelt[of[x]] = w.word(x)
                    out.append(((names[w.lang[i]], b" ".join(spelt[of[x]] for x in range(i, i + n)), n), c))
            return out

        held: dict = {}
        for out in _each(batches, found, limits.run_bytes):
            for key, c in out:
                held[key] = held.get(key, 0) + c
            if len(held) >= limits.held_phrases:
                yield dealt(held)
                held = {}
        yield dealt(held)

    def dealt(held):
        """Partial counts by hash partition, one row for each."""
        by: dict = {}
        for (lang, phrase, n), c in held.items():
            by.setdefault(crc32(phrase, crc32(lang.encode("utf-8", "surrogatepass"))) % parts, []).append((lang, phrase.decode(), n, c))
        cols = [list(zip(*rows, strict=True)) for rows in by.values()]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(by, pa.int32()), *(pa.array([c[k] for c in cols], pa.list_(t)) for k, t in enumerate(kinds))], names=["part", "lang", "phrase", "words", "f"])

    def merge(batches):
        def done():
            kept = [(*k, c) for k, c in total.items() if c >= threshold]
            cols = list(zip(*kept, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "f"])

        now, total = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in ("part", "lang", "phrase", "words", "f")]
                if row[0] != now:
                    yield done()
                    now, total = row[0], {}
                for *key, c in zip(*row[1:], strict=True):
                    key = tuple(key)
                    total[key] = total.get(key, 0) + c
        yield done()

    parts = pairs.value[1]  # as many as the first pass, so that a merged part is bounded as its summary was
    partial = rows.mapInArrow(task, "part int, lang array<string>, phrase array<string>, words array<int>, f array<bigint>")
    return partial.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, "lang string, phrase string, words int, f bigint")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, threshold: int = 100, absorbed_percent: int = 100, first: int = 2000, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words that occur ``threshold`` times or more.

    a, l, r are exact occurrences of the phrase and of the parts of its lowest-scoring cut, n those of
    all words; the score is floor(1000 * a * n / (l * r)). A phrase that stands inside a longer one
    with ``absorbed_percent`` of its occurrences gives way to it. Null texts are empty, a null language
    is ``und``; repeated rows count each; a language without frequent phrases has no rows, and an
    empty table gives none. Other columns aren't looked at. The documents are read four times; what is
    shuffled are words, hashed n-grams of frequent words, and counts of frequent phrases. No group is
    gathered whole: counts are summed before the shuffle, hot parts of phrases are joined apart, and
    languages are ranked in parts first.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    spark = rows.sparkSession
    # what is below the threshold in its language can't be part of a frequent phrase
    words = cut(_word_counts(rows, limits).where(F.col("phrase").isNull() | (F.col("f") >= threshold)))
    totals = words.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    words = words.where(F.col("phrase").isNotNull())
    mass = totals.agg(F.sum("n")).first()[0] or 0
    single = spark.sparkContext.broadcast(bitmap(words, "place", limits.bits))

    def pairs_of(w):
        good = has(single.value, places(w.key, 1 << 32, limits.bits))
        return w.grams(2, w.key)[w.same_piece(2) & good[:-1] & good[1:]]

    pairs = spark.sparkContext.broadcast(frequent_grams(rows, pairs_of, mass, threshold, limits))

    def longer_of(w):
        key = w.grams(2, w.key)
        pair = w.same_piece(2) & has(pairs.value[0], places(key, pairs.value[1], limits.bits))
        out, ok = [], pair
        for n in range(3, longest + 1):
            key = w.grams(n, key)
            ok = ok[: len(key)] & pair[n - 2 : n - 2 + len(key)]
            out.append(key[ok])
        return np.concatenate(out or [np.zeros(0, np.uint64)])

    more = spark.sparkContext.broadcast(frequent_grams(rows, longer_of, mass * max(1, longest - 2), threshold, limits))
    found = cut(_phrase_counts(rows, longest, pairs, more, threshold, limits))
    known = words.select("lang", "phrase", "f").unionByName(found.select("lang", "phrase", "f"))

    inner = F.explode(F.expr("array(substring_index(phrase, ' ', words - 1), substring(phrase, instr(phrase, ' ') + 1))"))
    held = found.where(F.col("words") > 2).select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_held"))
    kept = found.join(held, ["lang", "phrase"], "left").where(F.col("_held").isNull() | (F.col("_held") * 100 < F.col("f") * absorbed_percent))

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    head = F.expr("substring_index(phrase, ' ', k)")
    named = lambda part: F.concat("lang", F.lit("\n"), part)  # noqa: E731  words hold no line break
    cuts = cut(cuts.withColumn("_l", named(head)).withColumn("_r", named(F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)"))))
    parts = known.select(named(F.col("phrase")).alias("_part"), "f")
    with_l = cut(join_unique(cuts, parts.select(F.col("_part").alias("_l"), F.col("f").alias("l")), "_l"))
    with_r = join_unique(with_l, parts.select(F.col("_part").alias("_r"), F.col("f").alias("r")), "_r")
    scored = join_unique(cut(with_r.select("lang", "phrase", "a", "k", "l", "r")), totals, "lang").withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("a").alias("a"), F.first("n").alias("n"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Whole-number arithmetic in decimals: factors below 10^15 keep products below 10^38.
SCORE = "CAST((1000BD * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS BIGINT)"
