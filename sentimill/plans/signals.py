"""Queries of item weights, strengths and story facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentimill.functions import parsing as P
from sentimill.plans.common import CLOSES, ITEMS, closes, items, orders_by_asset, r6
from sentimill.sources import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    r"""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 6 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 0.7 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS shouting,
  regexp_matches(lower(text), '^(should|is|are|will|can|why|what|how|which)\b') OR regexp_matches(trim(text), '\?$') AS question, md5(replace(translate(text, '‘’“”–—' || chr(160), '''''""-- '), '…', '...')) AS digest FROM documents"""
)
def text_shapes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", P.is_shouting(t).alias("shouting"), P.is_question(t).alias("question"), F.md5(P.plain_signs(t).cast("binary")).alias("digest"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\$APA([^A-Za-z]|$)') THEN 1.0 WHEN regexp_matches(text, '\((NYSE|NASDAQ): ?APA\)') THEN 0.95 WHEN regexp_matches(text, '(^|[^A-Za-z$])APA([^A-Za-z]|$)') THEN 0.9
  WHEN regexp_matches(lower(text), '(^|[^a-z])apache([^a-z]|$)') THEN 0.8 ELSE 0.0 END::DOUBLE AS relevance FROM documents"""
)
def relevance_ladder(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.relevance(F.col("text"), "APA", "Apache").alias("relevance"))


@query(
    f"""WITH {ITEMS} SELECT event_id, round(weight * CASE user_id % 20 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END::DOUBLE * (1.0 + least(1.0, ln(1.0 + value) / 10.0)) * (0.5 + 0.5 * confidence), 6) AS item_weight FROM items"""
)
def item_weight(spark, sf):
    trust = F.when(F.col("user_id") % 20 == 0, 1.0).when(F.col("user_id") % 20 == 1, 0.9).otherwise(0.8)
    engagement = 1.0 + F.least(F.lit(1.0), F.log1p("value") / 10.0)
    return items(spark, sf).select("event_id", r6(F.col("weight") * trust * engagement * (0.5 + 0.5 * F.col("confidence"))).alias("item_weight"))


@query(
    """WITH l AS (SELECT max(o_orderdate)::DATE AS last FROM orders), t AS (SELECT o_custkey % 50 AS insider_group, o_orderstatus, pow(0.5, date_diff('day', o_orderdate::DATE, last) / 60.0) * least(1.0, o_totalprice / 25000.0) AS m FROM orders, l)
SELECT insider_group, round(0.7 * tanh(coalesce(sum(m) FILTER (o_orderstatus = 'F'), 0.0) / 2.5) - 0.4 * tanh(coalesce(sum(m) FILTER (o_orderstatus = 'O'), 0.0) / 2.0), 6) AS strength FROM t GROUP BY 1"""
)
def insider_strength(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    last = o.agg(F.max("d").alias("last")).withColumn("one", F.lit(1))  # one row
    m = F.pow(F.lit(0.5), F.datediff("last", "d") / 60.0) * F.least(F.lit(1.0), F.col("o_totalprice") / 25000.0)
    t = o.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").withColumn("m", m)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("m"))), F.lit(0.0))
    return t.groupBy((F.col("o_custkey") % 50).alias("insider_group")).agg(r6(0.7 * F.tanh(side("F") / 2.5) - 0.4 * F.tanh(side("O") / 2.0)).alias("strength"))


@query(
    f"""WITH {ITEMS}, s AS (SELECT user_id, event_type, tanh(avg(score) / 0.35) AS x, least(1.0, count(*) / 10.0)::DOUBLE AS r FROM items GROUP BY 1, 2)
SELECT user_id, round(sum(greatest(r, 0.05) * x) / sum(greatest(r, 0.05)), 6) AS x, round(avg(r), 6) AS confidence FROM s GROUP BY 1"""
)
def sub_signal_blend(spark, sf):
    s = items(spark, sf).groupBy("user_id", "event_type").agg(F.tanh(F.avg("score") / 0.35).alias("x"), F.least(F.lit(1.0), F.count(F.lit(1)) / 10.0).alias("r"))
    e = F.greatest("r", F.lit(0.05))
    return s.groupBy("user_id").agg(r6(F.sum(e * F.col("x")) / F.sum(e)).alias("x"), r6(F.avg("r")).alias("confidence"))


@query(f"WITH {CLOSES}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM closes) SELECT asset, round(max(close) FILTER (k = 1), 4) AS price, round(max(close) FILTER (k = 2), 4) AS prev, round((max(close) FILTER (k = 1) / max(close) FILTER (k = 2) - 1.0) * 100.0, 4) AS change_pct FROM k WHERE k <= 2 GROUP BY 1")
def quote_fallback(spark, sf):
    k = closes(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d")))).where("k <= 2")
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("close")))
    return k.groupBy("asset").agg(F.round(at(1), 4).alias("price"), F.round(at(2), 4).alias("prev"), F.round((at(1) / at(2) - 1.0) * 100.0, 4).alias("change_pct"))


@query(
    f"""WITH {ITEMS}, g AS (SELECT (ts::DATE)::VARCHAR AS story, event_type, count(*) AS carriers, sum(weight) AS mass FROM items GROUP BY 1, 2), t AS (SELECT story, sum(mass) AS total FROM g GROUP BY 1)
SELECT story, event_type, carriers, round(mass / total, 6) AS share FROM g JOIN t USING (story) WHERE carriers >= 2 AND round(mass / total, 9) >= 0.22"""
)
def story_events(spark, sf):
    """Event types with two carriers and 22 % of a story's weight; shares are compared to nine digits, so a share of just 22 % doesn't hang on the order of a sum."""
    g = items(spark, sf).groupBy(F.to_date("ts").cast("string").alias("story"), "event_type").agg(F.count(F.lit(1)).alias("carriers"), F.sum("weight").alias("mass"))
    t = g.groupBy("story").agg(F.sum("mass").alias("total"))
    return g.join(t, "story").where((F.col("carriers") >= 2) & (F.round(F.col("mass") / F.col("total"), 9) >= 0.22)).select("story", "event_type", "carriers", r6(F.col("mass") / F.col("total")).alias("share"))


@query(
    """WITH f AS (SELECT l_orderkey, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS importance, count(*) FILTER (l_returnflag = 'R') AS bear, count(*) FILTER (l_returnflag = 'A') AS bull FROM lineitem GROUP BY 1)
SELECT l_orderkey, importance, CASE WHEN bear > 0 THEN 'bear' WHEN bull > 0 THEN 'bull' ELSE 'neutral' END AS polarity FROM f"""
)
def filing_polarity(spark, sf):
    flag = F.col("l_returnflag")
    rank = F.when(flag == "R", 3).when(flag == "A", 2).otherwise(1)
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(rank).alias("importance"), F.count_if(flag == "R").alias("bear"), F.count_if(flag == "A").alias("bull"))
    return g.select("l_orderkey", "importance", F.when(F.col("bear") > 0, "bear").when(F.col("bull") > 0, "bull").otherwise("neutral").alias("polarity"))


@query(
    """WITH o AS (SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, o_orderkey, o_orderdate::DATE AS d, o_orderdate >= TIMESTAMP '2001-07-01' AS ahead FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY asset, ahead ORDER BY CASE WHEN ahead THEN d END, CASE WHEN NOT ahead THEN d END DESC, o_orderkey) AS k FROM o)
SELECT asset, o_orderkey, ahead FROM k WHERE ahead OR k <= 16"""
)
def catalysts(spark, sf):
    o = orders_by_asset(spark, sf).withColumn("ahead", F.col("d") >= F.lit("2001-07-01").cast("date")).select("asset", "o_orderkey", "d", "ahead")
    recent = o.where("NOT ahead").withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d"), "o_orderkey"))).where("k <= 16").drop("k")
    return o.where("ahead").unionByName(recent).select("asset", "o_orderkey", "ahead")


@query(
    f"""WITH {ITEMS}, t AS (SELECT event_type, ts::DATE AS d, count(*) FILTER (label = 'bullish') AS b, count(*) FILTER (label <> 'neutral') AS n FROM items GROUP BY 1, 2)
SELECT event_type, d, CASE WHEN n >= 15 AND b > 0.5 * n THEN 1 WHEN n >= 15 AND b < 0.25 * n THEN -1 ELSE 0 END AS crowded FROM t"""
)
def crowded_side(spark, sf):
    t = items(spark, sf).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count_if(F.col("label") == "bullish").alias("b"), F.count_if(F.col("label") != "neutral").alias("n"))
    return t.select("event_type", "d", F.when((F.col("n") >= 15) & (F.col("b") > 0.5 * F.col("n")), 1).when((F.col("n") >= 15) & (F.col("b") < 0.25 * F.col("n")), -1).otherwise(0).alias("crowded"))
