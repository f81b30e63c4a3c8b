"""Operators on small fixtures worked out by hand."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentimill.functions import scalars as S
from sentimill.operators import alerts, alignment, series, stories, texts
from sentimill.operators.components import components


def one(spark, **columns):
    return spark.sql("SELECT 1 AS _").select(*[v.alias(k) for k, v in columns.items()]).first().asDict()


def test_scalars(spark):
    x = one(
        spark,
        nan=S.clamp(F.lit(float("nan"))),
        inf=S.finite(F.lit(float("inf"))),
        zero=S.positive(F.lit(0.0)),
        undated=S.recency(F.lit(None).cast("double")),
        old=S.recency(F.lit(10_000.0)),
        top=S.band_label(F.lit(75.0)),
        low=S.band_label(F.lit(1.0)),
        th=S.ordinal(F.lit(112)),
        st=S.ordinal(F.lit(21)),
        edge=S.tone_label(F.lit(0.05)),
        host=S.domain(F.lit("https://WWW.Example.com:80/a?b")),
        heat=S.blend([(F.lit(100.0), 0.4), (F.lit(None).cast("double"), 0.25)]),
        none=S.blend([(F.lit(None).cast("double"), 0.4)]),
    )
    assert x["inf"] is x["zero"] is x["none"] is None
    assert (x["undated"], x["old"], x["top"], x["low"], x["th"], x["st"], x["edge"], x["host"]) == (0.5, 0.15, "very bullish", "very bearish", "112th", "21st", "neutral", "example.com")
    assert x["heat"] == pytest.approx(50 + 50 * 0.4 / 0.6)


def test_corr_pvalue(spark):
    rows = spark.createDataFrame([(0.5, 20), (0.0, 50), (1.0, 9), (0.3, 2)], "r double, n long").select(series.corr_pvalue("r", "n").alias("p")).collect()
    got = [r["p"] for r in rows]
    assert got[0] == pytest.approx(0.024769, abs=1e-5)  # t = 2.4495, 18 degrees
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 1.0


def test_alerts_edge_cooldown_rearm(spark):
    h = 3600
    rows = [("a", 0, 0, 80.0), ("a", h, 1, 60.0), ("a", 90 * 60, 2, 90.0), ("a", 3 * h, 3, 60.0), ("a", 4 * h, 4, 75.0), ("a", 5 * h, 5, 76.0), ("b", 0, 6, 10.0), ("b", h, 7, None)]
    got = alerts.crossings(spark.createDataFrame(rows, "k string, s long, i long, v double"), "k", "s", "i", "v", 70.0).collect()
    # the first holds; the second edge falls in the cooldown; the one at 4 h fires; the next has no edge
    assert sorted((r["k"], r["i"]) for r in got) == [("a", 0), ("a", 4)]


def test_asof_and_interval(spark):
    day = lambda n: dt.date(2024, 1, n)
    left = spark.createDataFrame([("x", day(5)), ("x", day(1)), ("y", day(9))], "k string, d date")
    right = spark.createDataFrame([("x", day(2), 1.0), ("x", day(5), 2.0), ("y", day(10), 3.0)], "k string, d date, v double")
    got = {(r["k"], r["d"]): r["v"] for r in alignment.asof_backward(left, right, "k", "d", "v").collect()}
    assert got == {("x", day(5)): 2.0, ("x", day(1)): None, ("y", day(9)): None}
    near = alignment.within_days(left, right.withColumnRenamed("d", "e").drop("v"), ["k"], "d", "e", 1, 1, "left_semi").collect()
    assert sorted((r["k"], r["d"]) for r in near) == [("x", day(1)), ("x", day(5)), ("y", day(9))]
    far = alignment.within_days(left, right.withColumnRenamed("d", "e").drop("v"), ["k"], "d", "e", 0, 0, "left_anti").collect()
    assert sorted((r["k"], r["d"]) for r in far) == [("x", day(1)), ("y", day(9))]


def test_first_wins_forgets_dropped_rows(spark):
    rows = [("b", 0, "u1", "t1"), ("b", 1, "u2", "t1"), ("b", 2, "u2", "t2"), ("b", 3, "u1", "t3")]
    got = texts.first_wins(spark.createDataFrame(rows, "batch string, i long, url string, title string"), "batch", "url", "title", "i").collect()
    assert sorted(r["i"] for r in got) == [0, 2]


def test_story_clusters(spark):
    rows = [("x", 0, i, t) for i, t in enumerate(["Acme recalls electric scooters worldwide", "Electric scooters recalled worldwide by Acme", "Central bank holds interest rates", "Interest rates held steady by central bank"])]
    got = {r["i"]: r["story"] for r in stories.story_clusters(spark.createDataFrame(rows, "k string, w long, i long, t string"), "k", "w", "i", "t").collect()}
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def greedy_average_link(x, threshold):
    """As defined: the nearest pair of clusters merges, one pair at a time."""
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > 1:
        sim = lambda a, b: round(float(x[a].sum(axis=0) @ x[b].sum(axis=0)) / (len(a) * len(b)), stories.DIGITS)
        s, i, j = max(((sim(a, b), -i, -j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=(-1, 0, 0))
        if s < threshold:
            break
        clusters[-i] = sorted(clusters[-i] + clusters[-j])
        del clusters[-j]
        clusters.sort()
    return [min(c) for k in range(len(x)) for c in clusters if k in c]


def test_rounds_of_nearest_pairs_are_the_greedy_walk():
    r = np.random.default_rng(2)
    for n, threshold in ((1, 0.1), (12, 0.3), (40, 0.25), (40, 0.6)):
        x = np.abs(r.normal(size=(n, 8))) ** 3
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert stories.cluster_vectors(x, threshold).tolist() == greedy_average_link(x, threshold)


def test_clusters_by_joins_are_those_in_one_task(spark):
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("gra", "sto", "fel", "run", "wat", "lig") for b in ("nit", "sk", "mor", "eda", "int", "ox")]
    rows = [("k" if i % 3 else "j", 0, i, " ".join(r.sample(words, 3) + [f"only{i}"])) for i in range(240)] + [("k", 0, 900, ""), ("k", 0, 901, None), (None, 0, 902, "granit stosk"), (None, 0, 903, "granit stosk")]
    df = spark.createDataFrame(rows, "k string, w long, i long, t string")
    of = lambda **how: {x["i"]: x["story"] for x in stories.story_clusters(df, "k", "w", "i", "t", **how).collect()}
    whole = of()
    assert len(whole) == len(rows) and whole == of(dense_most=100) and 10 < len(set(whole.values())) < 200


def test_near_duplicate_links_by_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(base[: 10 - i % 4] + [f"w{j}" for j in range(i // 4)])) for i in range(12)] + [(99, ""), (100, None)]
    got = {(r["a"], r["b"]) for r in texts.near_duplicate_links(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    sets = {i: frozenset((t or "").split()) for i, t in rows}
    first = {}
    for i, s in sorted(sets.items()):
        if s:
            first.setdefault(s, i)
    want = {(a, b) for s, a in first.items() for u, b in first.items() if a < b and len(s & u) >= 0.8 * len(s | u)}
    assert got == want and want


def test_spike_needs_a_baseline(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0) for i in range(20)] + [("a", dt.date(2024, 1, 21), 1000.0), ("b", dt.date(2024, 1, 1), 1.0)]
    got = {r["k"]: r["z"] for r in series.spike_z(spark.createDataFrame(rows, "k string, d date, value double"), "k").collect()}
    assert got["b"] is None and got["a"] == pytest.approx((math.log1p(1000) + math.log1p(10)) / 2 / 0.1 - math.log1p(10) / 0.1, rel=1e-9)


def test_parsing(spark):
    from sentimill.functions import parsing as P

    lit = F.lit
    x = one(
        spark,
        signs=P.plain_signs(lit("“It’s” – fine…")), words=P.word_count(lit("  two  words ")), none=P.word_count(lit(" ")), shout=P.is_shouting(lit("BUY NOW all")), calm=P.is_shouting(lit("ABC")),
        ask=P.is_question(lit("Is it time?")), roundup=P.is_roundup(lit("10 stocks to watch")), tags=P.is_roundup(lit("$A $B $C $D rise")),
        cash=P.relevance(lit("$ACME up"), "ACME", "Acme"), bare=P.relevance(lit("ACME up"), "ACME", "Acme"), named=P.relevance(lit("acme corp up"), "ACME", "Acme"), not_=P.relevance(lit("ACMEX"), "ACME", "Acme"),
        capped=P.relevance(lit("5 stocks to buy: $ACME"), "ACME", "Acme"), award=P.transaction_kind(lit("Stock Award (Grant)")), sale=P.transaction_kind(lit("Sale at price 10")), other=P.transaction_kind(lit("?")),
        bear=P.grade_polarity(lit("Underweight")), bull=P.grade_polarity(lit("Strong Buy")), who=P.person_name(lit("DOE JANE M")), plain=P.person_name(lit("jane doe")),
        share=P.canonical_symbol(lit("brk-b")), coin=P.canonical_symbol(lit("BTC/USD")), index=P.canonical_symbol(lit("^gspc")),
    )
    assert x == {
        "signs": "\"It's\" - fine...", "words": 2, "none": 0, "shout": False, "calm": False, "ask": True, "roundup": True, "tags": True, "cash": 1.0, "bare": 0.9, "named": 0.8, "not_": 0.0, "capped": 0.4,
        "award": "award", "sale": "sell", "other": "other", "bear": "bear", "bull": "bull", "who": "Jane M. Doe", "plain": "Jane Doe", "share": "BRK.B", "coin": "BTC-USD", "index": "^GSPC",
    }


@pytest.mark.parametrize("block", [10, 40, 250_000])
@pytest.mark.parametrize("as_text", [False, True])
def test_components_in_blocks_and_rounds(spark, block, as_text):
    """Few and many blocks give the same roots as joining edge after edge; chains, stars, loops, repeats and null ends."""
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(30)] + [(500, i) for i in range(501, 560)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1120, (60, 2))] + [(3, 3), (7, 8), (8, 7)]
    name = (lambda x: f"é{x}") if as_text else (lambda x: x)
    edges = [(name(a), name(b)) for a, b in edges]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    kind = "string" if as_text else "long"
    got = components(spark.createDataFrame([*edges, (None, edges[0][0]), (edges[0][0], None)], f"a {kind}, b {kind}"), block=block).collect()
    assert len(got) == len(root) and {r["node"]: r["root"] for r in got} == root


def test_components_where_keys_are_dealt_wider(spark, monkeypatch):
    """The last block's roots don't hang on how many partitions the session gives a key."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    plain = type(edges).repartition
    monkeypatch.setattr(type(edges), "repartition", lambda self, n, *keys: plain(self, max(n, 16), *keys))
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_pause_of_exactly_two_hours_parts_sessions_as_in_sql(spark, tmp_path):
    import duckdb

    from sentimill import plans
    from tests.duck import duck_rows, spark_rows

    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL (s) SECOND AS ts, 7::BIGINT AS user_id, 'view' AS event_type, 50.0::DOUBLE AS value, '' AS props
      FROM (VALUES (1::BIGINT, 0), (2, 7199), (3, 14399), (4, 21600)) t(i, s)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = plans.QUERIES["session_windows"](spark, str(tmp_path))
    assert spark_rows(got) == duck_rows(c, plans.ORACLES["session_windows"])
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 2]


def test_themes_of_equal_weights_are_a_tie_in_any_order(spark):
    from sentimill.operators import aggregates

    rows = [("k", 1.0, w, [t]) for t, ws in (("z", (0.1, 0.2, 0.3)), ("a", (0.3, 0.2, 0.1))) for w in ws]
    items = spark.createDataFrame(rows, "k string, score double, weight double, themes array<string>").coalesce(1)
    assert [r["theme"] for r in aggregates.theme_stats(items, "k", most=1).collect()] == ["a"]


def test_sets_meet_by_sketches_without_losing_links(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        own = r.sample(vocabulary, r.choice([3, 9, 40, 300, 900]))
        for j in range(4):
            kept = [w for w in own if r.random() > 0.04 * j]
            rows.append((4 * i + j, " ".join(kept + r.sample(vocabulary, len(own) * j // 25))))
    df = spark.createDataFrame(rows + [(1000 + i, "same words here") for i in range(1500)], "i long, t string")
    got = {(x["a"], x["b"]) for x in texts.near_duplicate_links(df, "i", "t").collect()}
    sets: dict = {}
    for i, t in rows:
        sets.setdefault(frozenset(t.split()), i)
    want = {(a, b) for s, a in sets.items() for u, b in sets.items() if s and u and a < b and len(s & u) >= 0.8 * len(s | u)}
    assert got == want and len(want) > 40
    assert texts.near_duplicate_links(df.union(df), "i", "t").count() == len(want)
    groups = {x["i"]: x["rep"] for x in texts.near_duplicate_groups(df, "i", "t").collect()}
    assert all(groups[1000 + i] == 1000 for i in range(1500))
    a, b = (np.array(sorted(r.sample(range(1 << 60), 500)), np.int64) for _ in range(2))
    x, y = (texts.sketches(t, np.zeros(len(t), np.int64), 1, 256)[0] for t in (np.concatenate([a, b[:30]]), a))
    assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= 30
