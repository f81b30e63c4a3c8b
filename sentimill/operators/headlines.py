"""Headlines read inside the row: typed tokens, stems, claimed spans, composed evidence, events.

Rules and phrases claim their spans by rewriting: each match becomes a mark, which no later pattern
can match into, so spans never overlap and earlier rules win. A phrase book is one trie pattern, whose
longest match at the leftmost place is taken. What follows works on each clause's marks and their
places; nothing is shuffled and no Python runs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimill.functions import lexicon as L
from sentimill.functions import phrasebook as P
from sentimill.functions.parsing import plain_signs
from sentimill.operators.components import components
from sentimill.sources.shared import cut

#: Signs around a mark and between its parts, and the sign of a contrast; prepared texts have none of them.
OPEN, CLOSE, PART, TURN = "‹", "›", "¦", "‡"
#: Places between a direction and its metric, before a comparison to its metric and to a direction that governs it, and after a negator.
NEAR, BEFORE, GOVERNED, NEGATED = 6, 10, 5, 4


#: White space that isn't one blank already.
SPACES = r"[\t-\r][\s\x0B]*| [\s\x0B]+"
#: Characters beyond ASCII other than the pound and euro signs.
BEYOND = r"[\x{80}-\x{A2}\x{A4}-\x{20AB}\x{20AD}-\x{10FFFF}]"


def prepared(text: Column) -> Column:
    """Lower case with plain signs, white space squeezed, currency codes as signs, other characters beyond ASCII as underscores (parts of words, in every engine)."""
    low = F.regexp_replace(F.lower(plain_signs(F.coalesce(text, F.lit("")))), SPACES, " ")
    low = let(low, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, BEYOND, "_")))
    for (sign, pattern), needed in zip(P.CODES, (("usd", "us$"), ("eur",), ("gbp",)), strict=True):
        low = replaced(low, pattern, f"\\{sign}$1" if sign == "$" else f"{sign}$1", needed)
    return low


def replaced(text: Column, pattern: str, by: str, needed: Iterable[str]) -> Column:
    """What ``regexp_replace`` gives; every match of the pattern holds one of ``needed``, so texts without these are spared its pass."""
    holds = lambda t: functools.reduce(lambda x, y: x | y, [F.contains(t, F.lit(n)) for n in needed])
    return let(text, lambda t: F.when(holds(t), F.regexp_replace(t, pattern, by)).otherwise(t))


def tokens(text: Column) -> Column:
    """Lower-case money, per cents, cashtags, numbers and words; amounts in one spelling ('$1.50 billion' and 'USD 1.5bn' are '$1.5b'), possessives dropped."""
    found = F.regexp_extract_all(prepared(text), F.lit(P.TOKEN), 0)
    return F.filter(F.transform(found, lambda t: F.when(t.rlike(r"^[$€£]\d"), plain_money(t)).otherwise(F.btrim(F.regexp_replace(t, "'s$", ""), F.lit("'-")))), lambda t: t != "")


def plain_money(token: Column) -> Column:
    """An amount's sign, its number without commas and trailing zeros, its scale as one letter."""
    number = F.replace(F.regexp_extract(token, rf"^[$€£]({P.NUMBER})", 1), F.lit(","), F.lit(""))
    number = F.when(F.contains(number, F.lit(".")), F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))).otherwise(number)
    scale = F.regexp_extract(token, r"([a-z]*)$", 1)
    return F.concat(F.substring(token, 1, 1), number, F.when(scale == "thousand", "k").otherwise(F.substring(scale, 1, 1)))


def dedup_form(text: Column) -> Column:
    """The tokens of a headline without its lead label and listing, joined: equal for copies spelt apart."""
    t = F.regexp_replace(F.trim(prepared(text)), P.LEAD, "")
    return F.array_join(tokens(F.regexp_replace(t, P.LISTING, " ")), " ")


def _table(table: dict) -> Column:
    """A map of strings from one literal; values are read as strings."""
    return F.str_to_map(F.lit(TURN.join(f"{k}{PART}{v}" for k, v in table.items())), F.lit(TURN), F.lit(PART))


def _by_letter(table: dict) -> Callable[[Column], Column]:
    """Look-up of a word in a long table: maps are searched from their start, so each first letter has one of its own."""
    letters = sorted({k[0] for k in table})
    maps = F.create_map(*[x for c in letters for x in (F.lit(c), _table({k: v for k, v in table.items() if k[0] == c}))])
    return lambda word: F.element_at(F.element_at(maps, F.substring(word, 1, 1)), word)


def story_stems(text: Column, without: Column | None = None) -> Column:
    """The sorted distinct stems of a headline's words of three letters or more that could tell its story: no stopwords, numbers or generic words, nor those in ``without`` (a company's own)."""
    words = F.filter(tokens(text), lambda t: t.rlike("^[a-z][a-z'-]{2,}$") & ~t.isin(*sorted(L.STOPWORDS)))
    stems = F.array_except(F.array_distinct(F.transform(words, lambda w: stem(w))), F.array(*[F.lit(g) for g in P.GENERIC]))
    return F.array_sort(F.array_except(stems, without) if without is not None else stems)


def overlap_links(items: DataFrame, item: str, stems: str, least: float = 0.5, shared: int = 3) -> DataFrame:
    """(a, b, common) of distinct stem sets, each by its smallest item, that share ``least`` of the smaller one and ``shared`` stems (all of a set that has fewer).

    Of the smaller set's stems, rarest first, so many come first that a pair without one of them can't
    share enough; only those are looked up in the larger set. Empty and null sets link to nothing.
    """
    sets = cut(items.where(F.size(F.coalesce(F.col(stems), F.array())) > 0).groupBy(F.array_sort(F.array_distinct(stems)).alias("s")).agg(F.min(item).alias("i")))
    need = lambda n: F.greatest(F.ceil(n * least), F.least(F.lit(shared), n)).cast("int")
    both = _met(sets, need).join(sets.select(F.col("i").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("i").alias("b"), F.col("s").alias("sb")), "b")
    return both.withColumn("common", F.size(F.array_intersect("sa", "sb"))).where(F.col("common") >= need(F.least(F.size("sa"), F.size("sb")))).select("a", "b", "common")


def _met(sets: DataFrame, need: Callable[[Column], Column]) -> DataFrame:
    """(a, b) of sets (i, s) that may share ``need`` of the smaller one's size: one of its rarest tokens, as many as leave too few, stands in the larger one."""
    each = sets.select("i", F.size("s").alias("n"), F.explode("s").alias("t"))
    rare = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(rare, "t").groupBy("i", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("ts"))  # a set's own tokens
    first = ranked.select(F.col("i").alias("a"), F.col("n").alias("na"), F.explode(F.slice("ts", F.lit(1), F.col("n") - need(F.col("n")) + 1)).alias("t"))
    larger = each.select(F.col("i").alias("b"), F.col("n").alias("nb"), "t")
    met = first.join(larger, "t").where((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Likeness of copies, share of a truncated copy's tokens that stand in the other in order, and tokens from which a truncation counts.
COPY_JACCARD, CONTAINED, LEAST_TRUNCATED = 0.8, 0.9, 6


def slots(seq: Column) -> Column:
    """Values that template headlines vary, numbers, amounts and calendar words, but for the last token, which truncation may have cut."""
    before = F.slice(seq, F.lit(1), F.greatest(F.size(seq) - 1, F.lit(0)))
    return F.filter(before, lambda t: t.rlike(r"^\$?\d[\d.,]*[%tbmk]?$") | t.isin(*P.CALENDAR))


def in_order(short: Column, long_: Column) -> Column:
    """How many of ``short``'s tokens stand in ``long_`` one after the other, each taken at its first place after the one before."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        found = F.array_position(F.slice(long_, acc["p"] + 1, F.size(long_)), t).cast("int")
        return F.when(found > 0, F.struct((acc["p"] + found).alias("p"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(short, start, step, lambda acc: acc["n"])


def title_groups(items: DataFrame, item: str, title: str) -> DataFrame:
    """(item, group): copies of titles, a group named by its smallest item.

    Titles are copies if their forms are equal, their tokens have a Jaccard of COPY_JACCARD or more, or,
    from LEAST_TRUNCATED tokens on, one holds CONTAINED of the other in order; never if each states a
    value that the other lacks. Groups are connected components; titles without tokens stand alone.
    """
    forms = cut(items.select(F.col(item).alias("item"), dedup_form(F.col(title)).alias("f")))
    nodes = cut(forms.where("f <> ''").groupBy("f").agg(F.min("item").alias("i")).select("i", "f", F.split("f", " ").alias("q"), F.array_distinct(F.split("f", " ")).alias("s")))
    pairs = _met(nodes.select("i", "s"), lambda n: F.ceil(n * COPY_JACCARD).cast("int"))
    side = lambda c: nodes.select(F.col("i").alias(c), F.col("q").alias(f"q{c}"), F.col("s").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"_n": F.size(F.array_intersect("sa", "sb")), "_x": slots(F.col("qa")), "_y": slots(F.col("qb"))})
    na, nb, la, lb = F.size("sa"), F.size("sb"), F.size("qa"), F.size("qb")
    apart = (F.size(F.array_except("_x", "_y")) > 0) & (F.size(F.array_except("_y", "_x")) > 0)
    ordered = lambda short, long_: in_order(F.col(short), F.col(long_)) >= CONTAINED * F.size(short)
    cut_short = (F.least(la, lb) >= LEAST_TRUNCATED) & (F.col("_n") >= CONTAINED * F.least(na, nb)) & ((la <= lb) & ordered("qa", "qb") | (lb <= la) & ordered("qb", "qa"))
    links = both.where(~apart & ((F.col("_n") >= COPY_JACCARD * (na + nb - F.col("_n"))) | cut_short)).select("a", "b")
    roots = components(links).select(F.col("node").alias("i"), F.col("root").alias("group"))
    named = nodes.join(roots, "i", "left").select("f", F.coalesce("group", "i").alias("group"))
    return forms.join(named, "f", "left").select(F.col("item").alias(item), F.coalesce("group", "item").alias("group"))


def each(items: DataFrame, *columns: str | Column, array: Column, name: str, place: str | None = None) -> DataFrame:
    """``columns`` and the elements of an array without nulls as ``name``, with their places from 0 where asked for.

    An inner generator would let the optimizer put a filter on the array's size before it, which works the array out once more.
    """
    made = F.posexplode_outer(array).alias(place, name) if place else F.explode_outer(array).alias(name)
    return items.select(*columns, made).where(F.col(place or name).isNotNull())


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def stem(word: Column) -> Column:
    """A word without plural, tense and final e; listed forms have their listed stems."""
    bare = lambda x, end: F.regexp_replace(F.regexp_replace(x, f"{end}$", ""), r"^(.+)([^lsz])\2$", "$1$2")  # noqa: E731  one of a doubled last letter

    def singular(w: Column) -> Column:
        out = F.when(w.rlike("ies$") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(?:sses|shes|ches|xes|zes)$"), F.regexp_replace(w, "es$", ""))
        return out.when(w.rlike("s$") & ~w.rlike("(?:ss|us|is)$"), F.regexp_replace(w, "s$", "")).otherwise(w)

    def present(w: Column) -> Column:
        out = F.when(w.rlike("ied$") & (F.length(w) > 4), F.regexp_replace(w, "ied$", "y")).when(w.rlike("eed$") & (F.length(w) > 4), F.regexp_replace(w, "d$", ""))
        return out.when(w.rlike("[aeiouy].*ing$") & (F.length(w) > 5), bare(w, "ing")).when(w.rlike("[aeiouy].*ed$") & (F.length(w) > 4), bare(w, "ed")).otherwise(w)

    def ruled(w: Column) -> Column:
        short = let(let(singular(w), present), lambda x: F.when(x.rlike("e$") & (F.length(x) > 3), F.regexp_replace(x, "e$", "")).otherwise(x))
        return F.when((F.length(w) <= 3) | ~F.replace(w, F.lit("-"), F.lit("")).rlike("^[a-z]+$"), w).otherwise(short)

    listed = lambda w: F.when(w.isin(*P.KEPT), w).otherwise(F.coalesce(F.element_at(_table(P.FINAL), w), let(F.coalesce(F.element_at(_table(P.IRREGULAR), w), w), ruled)))
    return let(F.lower(word), listed)


def trie_pattern(phrases: Iterable[str]) -> str:
    """One pattern of all phrases that shares their beginnings, so a text is read once however many there are; the longest phrase is tried first."""
    trie: dict = {}
    for p in phrases:
        at = trie
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        ends, rest = "" in node, [c for c in sorted(node) if c]
        branches = [(r"\s+" if c == " " else c if c.isalnum() else "\\" + c) + of(node[c]) for c in rest]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and not ends else "(?:" + "|".join(branches) + ")"
        return body + "?" if ends else body

    return rf"\b({of(trie)})\b"


def claimed(text: Column, rules: Iterable[tuple] = P.RULES, phrases: Iterable[str] | None = None) -> Column:
    """The text in lower case, every rule's and then every phrase's match replaced by a mark.

    Underscores around a rule's groups keep words inside a mark from being whole words, so nothing matches into it.
    """
    return marked(parted(text), rules, phrases)


def parted(text: Column) -> Column:
    """The prepared text, the words of compounds apart."""
    return replaced(prepared(text), r"([a-z])-([a-z])", "$1 $2", ("-",))


def marked(t: Column, rules: Iterable[tuple] = P.RULES, phrases: Iterable[str] | None = None) -> Column:
    """``claimed`` of a text that is parted already."""
    for key, _, pattern in rules:
        mark = f" {OPEN}{key}{PART}_$1_{PART}_$2_{PART}_$3_{CLOSE} "
        t = replaced(t, pattern, mark, P.NEEDED[pattern]) if pattern in P.NEEDED else F.regexp_replace(t, pattern, mark)
    t = F.regexp_replace(t, trie_pattern(P.roles() if phrases is None else phrases), f"{OPEN}{PART}$1{CLOSE}")
    return replaced(t, rf"\b(?:{'|'.join(P.CONTRAST)})\b", f" {TURN} ", P.CONTRAST)


#: Inside a clause: marks, amounts, words. A rule's mark by its parts; where clauses end.
PIECE = rf"{OPEN}[^{CLOSE}]*{CLOSE}|{P.AMOUNT}|[a-z][a-z0-9']*"
MARK = rf"^{OPEN}([a-z_]*){PART}_(.*?)_{PART}_(.*?)_{PART}_(.*?)_{CLOSE}$"
CLAUSE = r"[;:!?]+(?:\s+|$)|\.(?:\s+|$)|\s-\s"
#: How much a repeat of a term adds, evidence before a contrast counts, a question keeps, a negation turns; and the scale of a score.
REPEAT, CONCEDED, ASKED, TURNED, SCALE = 0.5, 0.6, 0.5, -0.7, 4.0


def worth_reading(parted: Column) -> Column:
    """Whether a parted text can have evidence: a word or direction of the phrase book, or what every rule needs. One pass that spares most texts the others."""
    hint = trie_pattern([k for k, (role, _) in P.roles().items() if role in ("word", "direction")] + ["price target", "upgrade", "upgrades", "upgraded", "downgrade", "downgrades", "downgraded", "vs", "versus", "compared", "against", "from"])
    return parted.rlike(hint)


def spans(items: DataFrame, text: str) -> DataFrame:
    """``items`` with ``_clauses``: whether a contrast follows a clause, and its marks with their place, role and value."""
    book = P.roles()
    role, value = _by_letter({k: r for k, (r, _) in book.items()}), _by_letter({k: v for k, (_, v) in book.items()})
    fixed = _table({key: v for key, v, _ in P.RULES if v is not None})

    def told(k: Column, i: Column, named: Column, kind: Column, worth: Column, part: list[Column]) -> Column:
        return F.struct(i.alias("i"), named.alias("term"), kind.alias("role"), worth.cast("double").alias("v"), *[x.alias(c) for x, c in zip(part, "abc", strict=True)])

    def span(p: Column, i: Column) -> Column:
        """A phrase's mark has its part sign first, a rule's its key."""
        phrase = lambda x: told(x, i, x, role(x), value(x), [F.lit("")] * 3)
        rule = lambda x: told(x, i, x, F.lit("rule"), F.element_at(fixed, x), [F.regexp_extract(p, MARK, k) for k in (2, 3, 4)])
        return F.when(p.startswith(OPEN + PART), let(F.substring(p, F.lit(3), F.length(p) - 3), phrase)).otherwise(let(F.regexp_extract(p, MARK, 1), rule))

    pieces = lambda clause: F.when(F.contains(clause, F.lit(OPEN)), F.regexp_extract_all(clause, F.lit(PIECE), 0)).otherwise(F.array().cast("array<string>"))
    marks = lambda clause: F.filter(F.transform(pieces(clause), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"].startswith(OPEN))
    of = lambda segs: F.flatten(F.transform(segs, lambda seg, s: F.transform(F.split(seg, CLAUSE), lambda c: F.struct((s < F.size(segs) - 1).alias("conceded"), marks(c).alias("marks")))))
    read = items.withColumn("_parted", parted(F.col(text)))
    worth = F.when(worth_reading(F.col("_parted")), F.col("_parted")).otherwise("")
    read = read.withColumn("_clauses", F.filter(let(F.split(marked(worth), TURN), of), lambda c: F.size(c["marks"]) > 0)).drop("_parted")
    return read.withColumn("_clauses", F.transform("_clauses", lambda c: F.struct(c["conceded"].alias("conceded"), F.transform(c["marks"], lambda x: span(x["p"], x["i"])).alias("spans"))))


def amount_value(raw: Column) -> Column:
    """An amount as a number; null for what holds none, and for years."""
    scale = F.regexp_extract(raw, r"([a-z]*)$", 1)
    letter = F.when(scale == "thousand", "k").otherwise(F.substring(scale, 1, 1))
    factor = F.when(letter == "t", 1e12).when(letter == "b", 1e9).when(letter == "m", 1e6).when(letter == "k", 1e3).otherwise(1.0)
    number = F.replace(F.regexp_extract(raw, rf"({P.NUMBER})", 1), F.lit(","), F.lit(""))
    return F.when((number != "") & ~raw.rlike(r"^(?:19|20)\d\d$"), number.cast("double") * factor)


def comparison(term: Column, a: Column, b: Column, c: Column, polarity: Column) -> Column:
    """The value of two amounts set against each other, 'b' telling whether the second is a consensus; null where they are equal or in different units."""
    def told(x: Column) -> Column:
        moved, rel = x["moved"], F.abs(x["moved"]) / F.greatest(F.abs(x["old"]), F.lit(1e-9))
        size = F.when(b != "", (0.5 + 0.4 * F.least(F.lit(1.0), rel / 0.05)) * 0.7).otherwise((0.55 + 0.45 * F.least(F.lit(1.0), rel / 0.2)) * 0.85)
        return F.when((a.endswith("%") == c.endswith("%")) & (moved != 0), F.signum(moved) * size)

    new, old = lambda x: F.when(term == "moved", x["c"]).otherwise(x["a"]), lambda x: F.when(term == "moved", x["a"]).otherwise(x["c"])
    change = lambda x: F.struct(((new(x) - old(x)) * polarity).alias("moved"), old(x).alias("old"))
    return let(let(F.struct(amount_value(a).alias("a"), amount_value(c).alias("c")), change), told)


def _hits(clause: Column) -> Column:
    """A clause's evidence: words of their own value, directions times the nearest metric, rules, comparisons; each under what modifies it."""
    all_ = clause["spans"]
    near = lambda h, role, test: F.filter(all_, lambda n: (n["role"] == role) & test(h["i"] - n["i"]))

    def hit(h: Column) -> Column:
        metric = F.array_min(F.transform(near(h, "metric", lambda d: F.abs(d) <= NEAR), lambda m: F.struct(F.abs(h["i"] - m["i"]).alias("d"), m["i"].alias("i"), m["v"].alias("v"))))["v"]
        before = F.try_element_at(near(h, "metric", lambda d: (d > 0) & (d <= BEFORE)), F.lit(-1))["v"]
        governed = F.size(near(h, "direction", lambda d: (d > 0) & (d <= GOVERNED))) > 0  # "rose from 5 to 7" is told by its direction
        base = F.when(h["role"] == "direction", h["v"] * F.coalesce(metric, F.lit(0.5))).when(h["v"].isNull() & governed, F.lit(None).cast("double")).when(h["v"].isNull(), comparison(h["term"], h["a"], h["b"], h["c"], F.coalesce(before, F.lit(1.0)))).otherwise(h["v"])
        strength = F.coalesce(F.array_max(F.transform(near(h, "strength", lambda d: F.abs(d) == 1), lambda n: n["v"])), F.lit(1.0))
        hedge = F.coalesce(F.array_min(F.transform(near(h, "hedge", lambda d: d > 0), lambda n: n["v"])), F.lit(1.0))
        turned = F.when(F.size(near(h, "not", lambda d: (d > 0) & (d <= NEGATED))) > 0, TURNED).otherwise(1.0)
        conceded = F.when(clause["conceded"], CONCEDED).otherwise(1.0)
        return F.struct(h["term"].alias("term"), (base * strength * hedge * turned * conceded).alias("value"), h["a"].alias("a"), h["b"].alias("b"), h["c"].alias("c"))

    evidence = F.filter(all_, lambda h: h["role"].isin("word", "direction", "rule"))
    return F.filter(F.transform(evidence, hit), lambda x: x["value"].isNotNull())


def evidence(items: DataFrame, text: str) -> DataFrame:
    """``items`` with column ``hits``: (term, value, a, b, c) of the text's evidence in order; a null or empty text has none."""
    read = spans(items, text)
    return read.withColumn("hits", F.flatten(F.transform("_clauses", _hits))).drop("_clauses")


def scored(items: DataFrame, text: str) -> DataFrame:
    """``items`` with score (-1 to 1), label, confidence, drivers (the five strongest terms), and hits."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    again = lambda all_, h, i: F.size(F.filter(F.slice(all_, F.lit(1), i), lambda e: e["term"] == h["term"]))
    worth = lambda all_: F.transform(all_, lambda h, i: F.struct(h["term"].alias("term"), (h["value"] * F.pow(F.lit(REPEAT), again(all_, h, i))).alias("v")))
    sum_of = lambda ws, t: F.round(-F.abs(total(F.transform(F.filter(ws, lambda w: w["term"] == t), lambda w: w["v"]))), 9)
    by_term = lambda ws: F.array_sort(F.transform(F.array_distinct(F.transform(ws, lambda w: w["term"])), lambda t: F.struct(sum_of(ws, t).alias("k"), t.alias("term"))))
    weighed = lambda ws: F.struct(total(F.transform(ws, lambda w: w["v"])).alias("raw"), by_term(ws).alias("by"))
    read = evidence(items, text).withColumn("_w", let(let(F.col("hits"), worth), weighed))
    asked = F.when(F.coalesce(F.rtrim(F.col(text)), F.lit("")).endswith("?"), ASKED).otherwise(1.0)
    score, mass = F.tanh(F.col("_w.raw") * asked / SCALE), -total(F.transform("_w.by", lambda b: b["k"]))
    return read.withColumns({
        "score": score,
        "label": let(score, lambda x: F.when(x > 0.05, "bullish").when(x < -0.05, "bearish").otherwise("neutral")),
        "confidence": let(mass, lambda m: F.when(m > 0, F.least(F.lit(1.0), m / 6.0) * F.abs(F.col("_w.raw")) / m).otherwise(0.0)),
        "drivers": F.transform(F.slice("_w.by", 1, 5), lambda b: b["term"]),
    }).drop("_w")


def units(text: Column) -> Column:
    """The parts of a text that state at most one event a key: (clause, part, its text, the clause up to its end, whether the clause asks)."""
    clauses = F.split(F.regexp_replace(F.trim(prepared(text)), r"([.;:!?]+)(?:\s+|$)|\s-\s", f"$1{TURN}"), TURN)
    parts = lambda c: F.split(c, r",\s+|\s+(?:and|while)\s+")
    of = lambda c, ci: let(parts(c), lambda ps: F.transform(ps, lambda p, pi: F.struct(ci.alias("clause"), pi.alias("part"), p.alias("text"), F.array_join(F.slice(ps, F.lit(1), pi), ", ").alias("before"), c.alias("whole"))))
    return F.flatten(F.transform(clauses, of))


def hypothetical(lead: Column, clause: Column) -> Column:
    """Whether what follows ``lead`` is a preview, a condition or a bet, or the clause asks whether it will be; what stands after a fact's preposition isn't."""
    asks = clause.rlike(r"^\s*(?:can|could|will|would|should|might|may)\b") & clause.rlike(r"\?+$")
    return ~lead.rlike(P.FACT) & (lead.rlike(P.HYPOTHETICAL) | asks)


def firm_of(before: Column, part: Column, firms: dict[str, str]) -> Column:
    """The canonical name of the last firm that a clause names up to the end of a part."""
    named = F.regexp_extract(F.concat_ws(", ", before, part), rf"(?s)^.*\b({'|'.join(sorted(firms, key=lambda a: (-len(a), a)))})\b", 1)
    return F.element_at(_table(firms), named)


def events(items: DataFrame, text: str, firms: dict[str, str] = P.FIRMS) -> DataFrame:
    """``items`` with column ``events``: (key, polarity, firm, value), one for each key and firm, by the text's parts and within one in the book's order; a null text has none.

    Only analysts' events have a firm, only moves and price targets a value. Hypothetical ones are left
    out. Where shares both rise and fall, one move stays: the one with a subject of its own; of two with
    one the first; of two without the one that says by how much, or else the later.
    """
    none = F.lit(None)

    def event(u: Column, key: str, polarity: str, pattern: str) -> Column:
        lead = F.concat(u["before"], F.lit(" "), F.regexp_extract(u["text"], rf"(?s)^(.*?)(?:{pattern})", 1))
        value = none.cast("double")
        if key.startswith("target"):
            value = amount_value(F.regexp_extract(u["text"], rf"price target.*?\bto\s+({P.AMOUNT})", 1))
        elif key.startswith("price"):
            value = F.try_to_number(F.regexp_extract(u["text"], r"(\d{1,4}(?:\.\d{1,3})?)%", 1), F.lit("9999.999")).cast("double")
        firm = firm_of(u["before"], u["text"], firms) if key in P.ANALYST else none.cast("string")
        found = F.struct(F.lit(key).alias("key"), F.lit(polarity).alias("polarity"), firm.alias("firm"), value.alias("value"), u["text"].rlike(P.MOVER).alias("named"))
        return F.when(u["text"].rlike(pattern) & ~hypothetical(lead, u["whole"]), found)

    def of(u: Column) -> Column:
        return F.filter(F.array(*[event(u, k, p, rx) for k, p, rx in P.EVENTS]), lambda e: e.isNotNull())

    same = lambda a, b: (a["key"] == b["key"]) & a["firm"].eqNullSafe(b["firm"])
    first = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda b: same(e, b)))
    at = lambda all_, key: F.coalesce(F.array_position(F.transform(all_, lambda e: e["key"]), key), F.lit(0)).cast("int")

    def lost(all_: Column, m: Column) -> Column:
        """The place of the move that gives way; 0 without two."""
        up, down, a, b = m["up"], m["down"], F.try_element_at(all_, F.nullif(m["up"], F.lit(0))), F.try_element_at(all_, F.nullif(m["down"], F.lit(0)))
        return (
            F.when((up == 0) | (down == 0), 0).when(a["named"] != b["named"], F.when(a["named"], down).otherwise(up)).when(a["named"], F.greatest(up, down))
            .when(a["value"].isNull() != b["value"].isNull(), F.when(a["value"].isNull(), up).otherwise(down)).otherwise(F.least(up, down))
        )

    kept = lambda all_: let(F.struct(at(all_, "price_up").alias("up"), at(all_, "price_down").alias("down")), lambda m: let(lost(all_, m), lambda k: F.filter(all_, lambda e, i: i + 1 != k)))
    found = let(let(F.flatten(F.transform(units(F.col(text)), of)), first), kept)
    return items.withColumn("events", F.transform(found, lambda e: F.struct(e["key"].alias("key"), e["polarity"].alias("polarity"), e["firm"].alias("firm"), e["value"].alias("value"))))


def themes(text: Column, most: int = 4) -> Column:
    """Up to four themes by the number of their words that a text has, ties in the themes' fixed order."""
    kinds = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0))
    hits = lambda ks: F.array(*[F.struct((-F.size(F.array_intersect(ks, F.array(*[F.lit(w) for w in words.split()])))).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, words) in enumerate(L.THEMES.items())])
    return let(kinds, lambda ks: F.transform(F.slice(F.array_sort(F.filter(hits(ks), lambda h: h["n"] < 0)), 1, most), lambda h: h["k"]))
