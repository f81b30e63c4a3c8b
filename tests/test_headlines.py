"""Headlines against a plain walk, labelled fixtures and stated values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sentimill.functions import phrasebook as P
from sentimill.operators import headlines as H


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def by_id(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_tokens_and_forms(spark):
    texts = {
        "US$1.50 billion vs USD 2,000bn; EUR 3 million, $45": ["$1.5b", "vs", "$2000b", "€3m", "$45"],
        "Apple's “Q3” up 5.5% – $AAPL. $1,070": ["apple", "q3", "up", "5.5%", "$aapl", "$1070"],
        "$150 thousand $150K $2 tln $1.00": ["$150k", "$150k", "$2t", "$1"],
        "naïve 'well-known' a -- x1 1,000": ["na", "ve", "well-known", "a", "x1", "1,000"],
        "": [], None: [],
    }
    assert by_id(rows(spark, texts).withColumn("k", H.tokens(F.col("t"))), "k") == list(texts.values())
    same = ["Update 2: Acme (NASDAQ: ACM) wins $150 billion deal", "Acme wins $150bn deal", "EXCLUSIVE - Acme wins  US$150b deal (nyse)"]
    assert len(set(by_id(rows(spark, same).withColumn("k", H.dedup_form(F.col("t"))), "k"))) == 1


def test_stems(spark):
    told = {
        "raises": "rais", "raised": "rais", "raising": "rais", "prices": "pric", "pricing": "pric", "fell": "fall", "running": "run", "stopped": "stop", "falling": "fall", "companies": "company",
        "tried": "try", "agreed": "agre", "classes": "class", "boxes": "box", "news": "news", "rated": "rating", "deliveries": "delivery", "us": "us", "bonus": "bonus", "buses": "bus", "q3": "q3", "off-sites": "off-sit", "red": "red", "strings": "string",
    }
    got = by_id(rows(spark, told).withColumn("k", H.stem(F.col("t"))), "k")
    assert dict(zip(told, got, strict=True)) == told


def plain_walk(text, book):
    """The longest phrase at each place, left to right, over whole words."""
    words, out, i = re.findall(r"[a-z0-9']+", text), [], 0
    longest = max(len(k.split()) for k in book)
    while i < len(words):
        for n in range(longest, 0, -1):
            if (p := " ".join(words[i : i + n])) in book and i + n <= len(words):
                out.append(p)
                i += n
                break
        else:
            i += 1
    return out


def test_phrases_are_a_plain_walks(spark):
    """10,000 texts of phrase words, whole and in parts, in any order."""
    r = random.Random(4)
    book = [k for k in P.roles() if "'" not in k]
    pieces = book + [w for k in book for w in k.split()] + ["acme", "the", "cutting", "uplift", "beat estimates"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(10_000)]
    marks = F.regexp_extract_all(H.claimed(F.col("t"), rules=(), phrases=book), F.lit(f"{H.OPEN}{H.PART}([^{H.CLOSE}]*){H.CLOSE}"), 1)
    turned = set(P.CONTRAST)
    got = by_id(rows(spark, texts).withColumn("k", marks), "k")
    for text, found in zip(texts, got, strict=True):
        assert [x for x in found if x not in turned] == [x for x in plain_walk(text, set(book)) if x not in turned], text


def test_rules_claim_in_order_and_never_overlap(spark):
    rules = (("long", 1.0, r"\balpha (beta) gamma\b()()"), ("short", 1.0, r"\bbeta\b()()()"), ("tail", 1.0, r"\bgamma (delta)\b()()"))
    texts = ["alpha beta gamma delta", "beta gamma delta", "alpha beta", "alpha beta gamma alpha beta gamma"]
    keys = F.regexp_extract_all(H.claimed(F.col("t"), rules, phrases=["beta", "delta"]), F.lit(f"{H.OPEN}([a-z]*){H.PART}"), 1)
    assert by_id(rows(spark, texts).withColumn("k", keys), "k") == [["long", ""], ["short", "tail"], ["", "short"][1:], ["long", "long"]]


FIXTURE = [
    ("Shares surge as profit beats estimates", "bullish"), ("Stock plunges after earnings miss", "bearish"), ("Analyst does not downgrade the stock", "bullish"),
    ("The company holds its annual meeting", "neutral"), ("Revenue gains, but lawsuit and probe spark selloff", "bearish"), (None, "neutral"), ("", "neutral"), ("???", "neutral"),
    ("Net loss narrowed to $2 million", "bullish"), ("Costs fell sharply", "bullish"), ("Costs rose", "bearish"), ("Sales $5.17 bln vs. $5.40 bln", "bearish"), ("Loss of $1 mn against $3 mn", "bullish"),
    ("Profit $3 million compared with $2,000 thousand", "bullish"), ("Sales 5% vs $3", "neutral"), ("Margins moved from 5% to 4%", "bearish"), ("Revenue of $10m vs consensus of $9m", "bullish"),
    ("Harbor Street cuts Acme price target to $10 from $20", "bearish"), ("Acme raises dividend", "bullish"), ("No longer weak", "bullish"), ("Debt grows", "bearish"), ("In 2019 vs 2020", "neutral"),
    ("Profit warning despite record high sales", "bearish"),
]


def test_labelled_headlines(spark):
    got = H.scored(rows(spark, [t for t, _ in FIXTURE]), "t").orderBy("i").collect()
    assert [(r["t"], r["label"]) for r in got if r["t"] != FIXTURE[-1][0]] == FIXTURE[:-1]
    assert all(-1 <= r["score"] <= 1 and 0 <= r["confidence"] <= 1 and len(r["drivers"]) <= 5 for r in got)


def values(spark, *texts):
    return [[(h["term"], round(h["value"], 6)) for h in hits] for hits in by_id(H.evidence(rows(spark, texts), "t"), "hits")]


def test_composed_values(spark):
    plain, other, far, hedged, asked, conceded = values(spark, "sales rose", "losses rose", "rose a b c d e f g sales", "may rise sharply", "sales very strong", "surge but miss")
    assert plain == [("rose", 1.1)] and other == [("rose", -1.1)] and far == [("rose", 0.55)]
    assert hedged == [("rise", round(1.1 * 0.7 * 1.4, 6))] and asked == [("strong", round(1.2 * 1.3, 6))] and conceded == [("surge", round(2.2 * 0.6, 6)), ("miss", -2.0)]
    compared, consensus, governed, unit = values(spark, "profit $110 vs $100", "sales of $10m vs consensus of $9m", "sales rose to $5 from $4 vs $3", "sales $1,000 thousand vs $1 million")
    assert compared == [("compared", round((0.55 + 0.45 * 0.5) * 0.85, 6))] and consensus == [("compared", round(0.9 * 0.7, 6))]
    assert [t for t, _ in governed] == ["rose"] and unit == []


def test_arrays_are_worked_out_once(spark):
    """A generator's array stands once in the plan; before, a filter on its size worked it out again."""
    for df in (H.each(H.evidence(rows(spark, ["sales rose", None]), "t"), "i", array=F.col("hits"), name="h", place="k"), H.each(rows(spark, ["a b", "", None]), array=H.tokens(F.col("t")), name="h")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"\bgbp") == 1
        assert df.count() == (1 if "k" in df.columns else 2)


def test_spared_passes_change_nothing(spark):
    """Passes left out for texts without what a match needs, against every pass over every text."""
    r = random.Random(12)
    pieces = ["usd", "us$", "eur 3", "gbp", "5", "$4 ", "price target", "raises", "lifts", "to", "from", "upgraded", "downgrades", "vs.", "versus", "compared with", "against", "consensus", "but", "yet", "a-b", "é", "“", "…", "\t", " ", "\x0b \n", "£7", "buy", ", "]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", "  "]) for _ in range(r.randrange(14))) for _ in range(3000)]
    low = F.regexp_replace(F.regexp_replace(F.lower(F.replace(F.translate("t", "‘’“”–—\u00a0", "''\"\"-- "), F.lit("…"), F.lit("..."))), r"[\s\x0B]+", " "), H.BEYOND, "_")
    for sign, pattern in P.CODES:
        low = F.regexp_replace(low, pattern, f"\\{sign}$1")
    plain = F.regexp_replace(low, r"([a-z])-([a-z])", "$1 $2")
    for key, _, pattern in P.RULES:
        plain = F.regexp_replace(plain, pattern, f" {H.OPEN}{key}{H.PART}_$1_{H.PART}_$2_{H.PART}_$3_{H.CLOSE} ")
    plain = F.regexp_replace(F.regexp_replace(plain, H.trie_pattern(P.roles()), f"{H.OPEN}{H.PART}$1{H.CLOSE}"), rf"\b(?:{'|'.join(P.CONTRAST)})\b", f" {H.TURN} ")
    got = rows(spark, texts).select(low.alias("low"), H.prepared(F.col("t")).alias("low2"), plain.alias("x"), H.claimed(F.col("t")).alias("y")).collect()
    assert all(g["low"] == g["low2"] and g["x"] == g["y"] for g in got) and sum("compared¦" in g["y"] for g in got) > 10


EVENTS = [
    ("Harbor Street upgrades Birch Motors to buy from hold, lifts price target to $45 from $30", [("upgrade", "Harbor Street", None), ("target_up", "Harbor Street", 45.0)]),
    ("Elm upgraded at Northfield, downgraded by Pine Ridge Capital and Quayside downgrades it", [("upgrade", "Northfield", None), ("downgrade", "Pine Ridge", None), ("downgrade", "Quayside", None)]),
    ("Windmere upgrades Elm and Windmere upgrades Fir", [("upgrade", "Windmere", None)]),
    ("Will Elm raise guidance?", []), ("Elm could cut dividend. Elm cuts dividend", [("dividend_cut", None, None)]), ("Analysts weigh takeover; acquisition closed", [("merger", None, None)]),
    ("Should you buy Elm after its merger?", [("merger", None, None)]), ("Shares jump 5%, stock falls 3%", [("price_up", None, 5.0)]), ("Jumps 5% early; stock slumps", [("price_down", None, None)]),
    ("Rises 5 points; falls 3%", [("price_down", None, 3.0)]), ("Rises 5%; falls 3%", [("price_down", None, 3.0)]), (None, []), ("", []),
]


def test_events_by_firm_guard_and_conflict(spark):
    got = by_id(H.events(rows(spark, [t for t, _ in EVENTS]), "t"), "events")
    assert [(t, [(e["key"], e["firm"], e["value"]) for e in es]) for (t, _), es in zip(EVENTS, got, strict=True)] == EVENTS


@pytest.mark.parametrize("key", sorted({k for k, _, _ in P.EVENTS}))
def test_every_event_pattern_is_reached(spark, key):
    said = {
        "earnings_beat": "beats estimates", "earnings_miss": "missed expectations", "guidance_up": "raises outlook", "guidance_down": "slashes forecast", "upgrade": "upgraded", "downgrade": "downgrades",
        "merger": "agrees to takeover", "buyback": "repurchase", "dividend_up": "raises its dividend", "dividend_cut": "suspends dividend", "lawsuit": "class action", "probe": "subpoena", "layoffs": "job cuts",
        "approval": "cleared by", "recall": "recalls", "bankruptcy": "chapter 11", "price_up": "stock rallies", "price_down": "shares slump", "target_up": "lifts price target", "target_down": "trims its price target",
    }
    assert re.search(dict((k, rx) for k, _, rx in P.EVENTS)[key], f"acme {said[key]} today")


def test_themes(spark):
    got = by_id(rows(spark, ["Chipmaker earnings and revenue up, analyst upgrade, court, inflation, CEO", "nothing", None]).withColumn("k", H.themes(F.col("t"))), "k")
    assert got == [["earnings", "analysts", "legal", "macro"], [], []]


def test_long_texts_and_marks_in_texts(spark):
    odd = ["‹up¦_a_¦_b_¦_c_› ‡ " + "rises ", "x" * 100_000, "sales rose. " * 300]
    got = H.scored(rows(spark, odd), "t").orderBy("i").collect()
    assert [t for t, _ in [(h["term"], 0) for h in got[0]["hits"]]] == ["up", "rises"][-len(got[0]["hits"]) :] and got[1]["hits"] == [] and len(got[2]["hits"]) == 300


def test_overlap_links_by_brute_force(spark):
    r = random.Random(9)
    stems = [f"s{i}" for i in range(14)]
    weights = [8, 6, 4, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    sets = [(i, r.choices(stems, weights, k=r.randrange(7))) for i in range(150)] + [(900, None), (901, [])]
    got = {(x["a"], x["b"], x["common"]) for x in H.overlap_links(spark.createDataFrame(sets, "i int, s array<string>"), "i", "s").collect()}
    first: dict = {}
    for i, s in sets:
        if s:
            first.setdefault(frozenset(s), i)
    want = set()
    for s, a in first.items():
        for t, b in first.items():
            small = min(len(s), len(t))
            if a < b and len(s & t) >= max(-(-small // 2), min(3, small)):
                want.add((a, b, len(s & t)))
    assert got == want and len(want) > 100


def test_story_stems(spark):
    got = by_id(rows(spark, ["Acme raises prices, shares rise 5%: why investors buy $ACM", "the of", None]).withColumn("k", H.story_stems(F.col("t"), F.array(F.lit("acm")))), "k")
    assert got == [["rais", "ris"], [], []]


def near_identical(sa, sb):
    """The rule for two token lists, as stated."""
    a, b = set(sa), set(sb)
    values = lambda seq: {t for t in seq[:-1] if re.match(r"^\$?\d[\d.,]*[%tbmk]?$", t) or t in P.CALENDAR}
    if values(sa) - values(sb) and values(sb) - values(sa):
        return False
    if len(a & b) >= 0.8 * len(a | b):
        return True

    def follows(short, long_):
        pos = n = 0
        for t in short:
            if t in long_[pos:]:
                pos += long_[pos:].index(t) + 1
                n += 1
        return n >= 0.9 * len(short)

    if min(len(sa), len(sb)) < 6 or len(a & b) < 0.9 * min(len(a), len(b)):
        return False
    return len(sa) <= len(sb) and follows(sa, sb) or len(sb) <= len(sa) and follows(sb, sa)


def test_title_groups_by_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(9)] + ["5%", "$3m", "monday", "12"]
    base = [r.choices(vocabulary, k=r.randint(3, 10)) for _ in range(25)]
    titles = []
    for words in base:
        titles += [words, words[: r.randint(1, len(words))], words + r.choices(vocabulary, k=2), [r.choice(vocabulary), *words[1:]], words[::-1]]
    texts = [" ".join(t) for t in titles] + ["", "!!", None]
    tokens = [t.split() if t and t != "!!" else [] for t in texts]
    group = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for i in range(len(texts)):
            for j in range(i):
                if tokens[i] and tokens[j] and group[i] != group[j] and (tokens[i] == tokens[j] or near_identical(tokens[i], tokens[j])):
                    group[i] = group[j] = min(group[i], group[j])
                    moved = True
    got = {x["i"]: x["group"] for x in H.title_groups(rows(spark, texts), "i", "t").collect()}
    assert got == dict(enumerate(group)) and 5 < len(set(group)) < len(texts) - 20
