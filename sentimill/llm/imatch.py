"""I-Match fingerprints, with DataFrame functions only.

A term is a lower-cased word, as a 64-bit hash. Document frequencies are counted over all documents; the
lexicon is the terms whose inverse document frequency lies in a chosen band. As each of its terms stands in
at least the band's lowest share of the documents, it has at most the mean number of distinct terms of a
document divided by that share, whatever the table's size; the bound is checked before it travels to the
tasks. A text's distinct lexicon terms are sorted, thinned to each of several randomised subsets of the
lexicon, and each subset's terms are hashed together. Subsets that keep one or two terms survive edits and
still tell texts apart, so the share kept falls with the number of terms: a text is hashed at its own level
and at the next, and texts are compared on the levels they share.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subsets of the lexicon; the band of df / N, and the least df; the most terms that travel to the tasks.
SUBSETS = 10
BAND = (0.001, 0.5)
LEAST_DF = 2
MOST_TERMS = 1 << 21
#: Top bits of a term's hash that find its place in the sorted lexicon.
PLACE_BITS = 16
#: Documents ordered together when the next one is looked up, and the most such groups (which bounds what is broadcast).
GROUP_ROWS, MOST_GROUPS = 2000, 100_000


def terms(text: Column) -> Column:
    """Distinct term hashes of a text."""
    words = F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text") -> list[int]:
    """The band's terms, sorted, by one aggregate over the distinct terms of all documents."""
    counted = docs.select(F.explode(terms(F.coalesce(text, F.lit("")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = docs.count()
    band = counted.where(F.col("df").between(max(LEAST_DF, BAND[0] * n), max(LEAST_DF, BAND[1] * n))).select("t")
    found = [r["t"] for r in band.limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the band: documents have too many distinct terms for its lower edge")
    return sorted(found)


def _longs(values: list[int]) -> Column:
    """A constant array, folded once into the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def member(found: list[int]):
    """A test of whether a term is in the sorted lexicon: its place by the top bits, then the few terms there."""
    half = 1 << (PLACE_BITS - 1)
    ends = [bisect_left(found, (k - half) << (64 - PLACE_BITS)) for k in range(2 * half)] + [len(found)]
    terms_, at = _longs(found), _longs(ends)

    def test(t: Column) -> Column:
        place = F.shiftright(t, 64 - PLACE_BITS).cast("int") + half
        first, past = F.get(at, place).cast("int"), F.get(at, place + 1).cast("int")
        return (past > first) & F.array_contains(F.slice(terms_, first + 1, past - first), t)

    return test


def fingerprint(text: Column, known) -> Column:
    """(level, a, b): hashes of the SUBSETS subsets at the text's level and at the next; 0 where a subset keeps none of its terms.

    A text without a lexicon term is told by a hash of all its terms, so only equal such texts are alike.
    """

    def of(all_terms: Column) -> Column:
        return bind(F.array_sort(F.filter(all_terms, known)), lambda found: _levels(F.when(F.size(found) > 0, found).otherwise(F.array(F.xxhash64(F.array_sort(all_terms))))))

    return bind(terms(text), of)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once and not at each place that names it."""
    return F.transform(F.array(value), use)[0]


def _levels(found: Column) -> Column:
    """Both levels' hashes of sorted lexicon terms. A subset at a level keeps one term in 2^level, and the next level's keeps half of those."""
    m = F.size(found)
    level = F.when(m < 3, F.lit(0)).otherwise(F.floor(F.log2(m / F.lit(1.5))).cast("int"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # each term with 64 random bits; subset k looks at those from bit 5 k on, level by level
    coins = F.transform(found, lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("v")))

    def print_of(terms: Column) -> Column:
        return F.when(F.size(terms) == 0, none).otherwise(F.xxhash64(terms))

    def subset(k: int, z: Column) -> Column:
        def keep(terms: Column, mask: Column) -> Column:
            return F.filter(terms, lambda x: F.shiftrightunsigned(x["v"], 5 * k).bitwiseAND(mask) == 0)

        return bind(keep(z["coins"], z["mask"]), lambda mine: F.struct(print_of(mine).alias("a"), print_of(keep(mine, z["next"])).alias("b")))

    head = F.struct(level.alias("level"), coins.alias("coins"))
    masked = lambda h: F.struct(
        h["level"].alias("level"), h["coins"].alias("coins"), (F.call_function("shiftleft", one, h["level"]) - 1).alias("mask"), (F.call_function("shiftleft", one, h["level"] + 1) - 1).alias("next")
    )
    hashes = bind(bind(head, masked), lambda z: F.struct(z["level"].alias("level"), F.array(*[subset(k, z) for k in range(SUBSETS)]).alias("h")))
    return bind(hashes, lambda r: F.struct(r["level"].alias("level"), F.transform(r["h"], lambda x: x["a"]).alias("a"), F.transform(r["h"], lambda x: x["b"]).alias("b")))


def likeness(f: Column, g: Column) -> Column:
    """Share of subsets with equal hashes among those that keep a term in either, over the levels both have; 0 with no such subset, 1 for equal fingerprints."""

    def pairs(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    both = (
        F.when(f["level"] == g["level"], F.concat(pairs(f["a"], g["a"]), pairs(f["b"], g["b"])))
        .when(f["level"] + 1 == g["level"], pairs(f["b"], g["a"]))
        .when(f["level"] == g["level"] + 1, pairs(f["a"], g["b"]))
        .otherwise(F.filter(pairs(f["a"], g["a"]), lambda z: F.lit(False)))
    )
    filled = F.filter(both, lambda z: (z["p"] != 0) | (z["q"] != 0))
    return bind(filled, lambda z: F.when(f == g, F.lit(1.0)).when(F.size(z) == 0, F.lit(0.0)).otherwise(F.size(F.filter(z, lambda x: x["p"] == x["q"])) / F.size(z)))


def as_text(f: Column) -> Column:
    """A fingerprint as a string: two hex digits of level, then sixteen of each hash."""
    digits = F.transform(F.concat(f["a"], f["b"]), lambda h: F.lpad(F.hex(h), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(f["level"]), 2, "0"), F.array_join(digits, "")))


def _number(docs: DataFrame, doc_id: str) -> Column:
    """A double that never falls as the id grows, for any type of id: of text, the bytes after what all ids begin with."""
    kind, x = docs.schema[doc_id].dataType.simpleString(), F.col(doc_id)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return (F.unix_date(x) if kind == "date" else F.unix_micros(x.cast("timestamp"))).cast("double")
    if kind in ("string", "binary"):
        low, high = docs.agg(F.min(doc_id), F.max(doc_id)).first()
        raw = lambda v: v.encode() if isinstance(v, str) else bytes(v or b"")
        a, b = raw(low or ""), raw(high or "")
        same = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        bytes_ = F.rpad(F.substring(x.cast("binary"), same + 1, 6), 6, F.lit(b"\0"))
        return F.conv(F.hex(bytes_), 16, 10).cast("double")
    return x.cast("double")


def with_next(docs: DataFrame, doc_id: str, columns: list[str], text: str) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by ascending id (nulls first, ties by a hash of the text and the text; after the last row the first).

    Ids are cut into groups by quantiles and, between them, evenly, so each holds about GROUP_ROWS
    rows. An id with more than twice an even share (a 200th) of the rows, or none, is a group of its own, cut by its texts' hashes.
    The first row of a group is also sent to the group before it. Rows move once.
    """
    ids = docs.select(F.col(doc_id).alias("i"), _number(docs, doc_id).alias("x"))
    n, nulls, bounds = ids.agg(F.count(F.lit(1)), F.count_if(F.col("i").isNull()), F.percentile_approx("x", [i / 200 for i in range(201)], 20_000)).first()
    groups = max(1, min(MOST_GROUPS, n // GROUP_ROWS))
    often = ids.where(F.col("i").isNotNull()).groupBy("i").count().where(F.col("count") >= max(2 * GROUP_ROWS, n / 100)).orderBy("i").collect()  # at most 100 ids
    hot = F.array(*[F.lit(r["i"]) for r in often])
    edges = sorted({e for e in bounds or () if e is not None and e == e}) or [0.0]
    each = max(1, groups // max(1, len(edges) - 1))
    i, x, h = F.col(doc_id), _number(docs, doc_id), F.xxhash64(text)
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    q = F.greatest(F.size(F.filter(cuts, lambda e: e <= x)) - 1, F.lit(0))
    lo, hi = F.get(cuts, q), F.get(cuts, q + 1)
    inside = F.coalesce(F.least(F.floor((x - lo) / (hi - lo) * each), F.lit(each - 1)), F.lit(0)).cast("long")
    at = F.when(i.isNull(), F.lit(-1).cast("long")).otherwise(q.cast("long") * each + inside)
    below, own = F.lit(0), F.lit(0)
    parts = F.when(i.isNull(), F.lit(max(1, nulls // GROUP_ROWS)))
    if often:
        below = F.size(F.filter(hot, lambda e: e < i))
        own = F.coalesce(F.array_contains(hot, i), F.lit(False)).cast("int")
        for r in often:
            parts = parts.when(i == F.lit(r["i"]), F.lit(r["count"] // GROUP_ROWS))
    share = F.floor((h / F.lit(2.0**64) + 0.5) * parts.otherwise(F.lit(1))).cast("long")
    key = F.struct(at.alias("at"), F.coalesce(2 * below + own, F.lit(0)).alias("hot"), F.when(i.isNull() | (own == 1), share).otherwise(F.lit(0).cast("long")).alias("part"))
    grouped = docs.withColumns({"_group": key, "_row": F.struct(i.alias("i"), h.alias("h"))})
    in_order = Window.orderBy("_group")
    firsts = grouped.groupBy("_group").agg(F.min("_row").alias("_first"))  # at most about twice MOST_GROUPS rows
    back = firsts.select(
        F.col("_group").alias("_own"),
        "_first",
        F.coalesce(F.lag("_group").over(in_order), F.max("_group").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"),
    )
    sent = grouped.join(F.broadcast(back), (F.col("_group") == F.col("_own")) & F.col("_row").eqNullSafe(F.col("_first")), "left")
    here = F.struct(F.col("_group").alias("group"), F.lit(0).alias("guest"))
    there = F.struct(F.col("_before").alias("group"), F.lit(1).alias("guest"))
    sent = sent.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there)))).drop("_own", "_first", "_before", "_group")
    w = Window.partitionBy("_to.group").orderBy("_to.guest", "_row", text)
    return sent.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(F.col("_to.guest") == 0).drop("_to", "_row")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last quarter (rounded down) replaced by as much of the next document's
    start. Null texts count as empty. Texts without a lexicon term are like equal ones only. Ids may be of any
    type that has an order. Repeated rows each keep a row: rows of one id follow each other by a hash of the
    text, and rows with null ids come first. Only rows that are equal in id and text can't be parted. Other columns are ignored; an empty table gives no rows. The texts move
    once, to lie beside the next one; the term counts are the only other shuffle.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = member(lexicon(base))
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = with_next(base.withColumn("f", fingerprint(F.col("text"), known)), "doc_id", ["text", "f"], "text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    return (
        rows.withColumn("edited", edited)
        .withColumn("g", fingerprint(F.col("edited"), known))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            as_text(F.col("f")).alias("fingerprint"),
            as_text(F.col("g")).alias("edited_fingerprint"),
            likeness(F.col("f"), F.col("g")).alias("near_edited"),
            likeness(F.col("f"), F.col("next_f")).alias("near_next"),
        )
    )
