"""Names, mentions and firms by brute force and stated values; first wins at any size."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sentimill.operators import entities as E
from sentimill.operators import texts


def told(spark, values, column):
    return [r["k"] for r in spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column.alias("k")).orderBy("i").collect()]


def test_brands_and_cases(spark):
    names = ["Acme Inc.", "The Widget Company, Inc. Class A", "NORTHERN LIGHTS HOLDINGS PLC", "Alpha & Co", "Beta S.A. / New", "Group", "IBM Corp", "Gamma", None]
    assert told(spark, names, E.brand(F.col("t"))) == ["Acme", "Widget", "NORTHERN LIGHTS", "Alpha", "Beta", "Group", "IBM", "Gamma", None]
    assert told(spark, ["NORTHERN LIGHTS", "IBM", "BHP GROUP", "Acme", "TLC WORKS"], E.fixed_case(F.col("t"))) == ["Northern Lights", "IBM", "BHP Group", "Acme", "TLC Works"]


def test_same_firm(spark):
    pairs = [("Harbor Street Securities", "harbor street", True), ("Harbor", "Harbor Street", True), ("Pine", "Spine Capital", False), ("Group", "Group", False), ("Pine Ridge", "Pine Bluff", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", E.same_firm(F.col("a"), F.col("b")))
    assert all(r["got"] == r["want"] for r in df.collect())


def plain_mentions(text, names):
    words = [w for w in text.lower().split()]
    hits = [(i, n, a) for n in range(1, 7) for i in range(len(words) - n + 1) if (a := " ".join(words[i : i + n])) in names]
    return {(i, a) for i, n, a in hits if not any(j <= i < j + m and (m > n or (m == n and j < i)) for j, m, _ in hits)}


def test_mentions_are_a_plain_search(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 4))), f"T{k}") for k in range(25)]
    companies = spark.createDataFrame([*rows, (98, None, None)], "k int, name string, ticker string")
    names = E.aliases(companies, "k", ["name"], "ticker").cache()
    known = {x["alias"] for x in names.collect()}
    texts_ = [(i, " ".join(r.choices(vocabulary + ["t1", "$t2", "t3"], k=r.randrange(15)))) for i in range(300)] + [(999, None), (998, "")]
    got = E.mentions(spark.createDataFrame(texts_, "item int, t string"), "item", "t", names, "k")
    found: dict = {}
    for x in got.collect():
        found.setdefault(x["item"], set()).add((x["place"], x["alias"]))
    for i, t in texts_:
        assert found.get(i, set()) == plain_mentions(t or "", known), t


def test_relevance_by_evidence(spark):
    companies = spark.createDataFrame([(1, "Acme Labs Inc", "ACL"), (2, "Acme Motors Inc", "ACM"), (3, "Zenith Corp", "ZEN")], "k int, name string, ticker string")
    names = E.aliases(companies, "k", ["name"], "ticker")
    titles = ["$ACL rises", "Acme Labs wins", "zenith falls", "ACM and Zenith", "top 5 stocks: Zenith", "nothing", None]
    df = spark.createDataFrame(list(enumerate(titles)), "item int, t string")
    got = {(r["item"], r["k"]): (r["relevance"], r["evidence"]) for r in E.relevance(E.mentions(df, "item", "t", names, "k"), df, "item", "t", "k").collect()}
    assert got == {(0, 1): (1.0, "cashtag"), (1, 1): (0.9, "brand"), (2, 3): (0.9, "brand"), (3, 2): (0.9, "ticker"), (3, 3): (0.9, "brand"), (4, 3): (0.4, "brand")}


def test_routine_revisions_by_brute_force(spark):
    r = random.Random(3)
    day = dt.date(2024, 3, 1)
    firms = ["Harbor Street Securities", "Pine Ridge", "Quayside & Co"]
    feed = [(r.choice(firms), day + dt.timedelta(days=r.randrange(40)), r.choice(["main", "main", "main", "up"]), r.choice([100.0, 101.0, 110.0, None, 0.0]), 100.0) for _ in range(60)] + [(None, day, "up", 1.0, 1.0), ("Group", day, "up", 1.0, 1.0)]
    stories = [(i, r.choice(["Harbor Street trims target", "Calls by Pine Ridge and Quayside", "Spine Ridge", "quiet"]), day + dt.timedelta(days=r.randrange(40))) for i in range(60)] + [(90, None, day), (91, "pine ridge", None)]
    got = {
        x["s"]: (x["actions"], x["routine"])
        for x in E.routine_revisions(spark.createDataFrame(stories, "s int, t string, at date"), "s", "t", "at", spark.createDataFrame(feed, "firm string, day date, action string, target double, prior double"), "firm", "day", "action", "target", "prior").collect()
    }
    cores = {"Harbor Street Securities": "harbor street", "Pine Ridge": "pine ridge", "Quayside & Co": "quayside"}
    for s, t, at in stories:
        hit = [x for x in feed if x[0] in cores and at and f" {cores[x[0]]} " in f" {(t or '').lower()} " and abs((x[1] - at).days) <= 4]
        moves = [abs(x[3] / x[4] - 1) for x in hit if x[3]]
        assert got[s] == (len(hit), bool(moves) and not any(x[2] == "up" for x in hit) and max(moves) < 0.03), (s, t, at)


def walk(rows):
    kept, urls, titles = [], {}, {}
    for row in sorted(rows, key=lambda r: r[1]):
        b, i, u, t = row
        if (u is None or (b, u) not in urls) and (t is None or (b, t) not in titles):
            kept.append(i)
            urls[(b, u)] = titles[(b, t)] = 1
    return sorted(kept)


def first_wins_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "batch string, i long, url string, title string")
    return sorted(r["i"] for r in texts.first_wins(df, "batch", "url", "title", "i", **how).collect())


def test_first_wins_by_rounds_is_the_walk(spark):
    r = random.Random(11)
    pick = lambda n: r.choice([None, *(f"k{j}" for j in range(n))])
    rows = [(r.choice(["a", "b", None]), i, pick(60), pick(60)) for i in range(900)]
    assert first_wins_of(spark, rows) == walk(rows) == first_wins_of(spark, rows, block=20)
    chain = [("c", 2 * i, f"u{i}", f"t{i}") for i in range(6)] + [("c", 2 * i + 1, f"u{i}", f"t{i + 1}") for i in range(6)]  # each row shares a key with the one before
    assert first_wins_of(spark, chain, block=0) == walk(chain)
    assert first_wins_of(spark, []) == []


def test_first_wins_of_one_hot_key(spark):
    rows = [("d", i, "hot" if i % 3 == 0 else f"u{i}", f"t{i % 1500}") for i in range(4000)]
    assert first_wins_of(spark, rows, block=50) == walk(rows)
