"""Payloads as providers shape them, made of the given tables and read back; each beside the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentimill.plans.common import r6
from sentimill.sources import payloads as L
from sentimill.sources import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """SELECT o_custkey AS k, o_orderkey::VARCHAR AS accession, CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN '4' ELSE '10-Q' END AS form, o_orderdate::DATE AS filed,
  CASE WHEN o_orderstatus = 'F' THEN '2.02|9.01' ELSE '' END AS items FROM orders WHERE o_orderkey % 17 <> 0"""
)
def columnar_filings(spark, sf):
    """A customer's orders as one columnar filing payload; every seventeenth date is broken."""
    form = F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "4").otherwise("10-Q")
    o = table(spark, sf, "orders").select(
        "o_custkey", F.struct(F.col("o_orderkey").cast("string").alias("accessionNumber"), form.alias("form"), F.when(F.col("o_orderkey") % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a").alias("filingDate"), F.when(F.col("o_orderstatus") == "F", "2.02, 9.01").otherwise("").alias("items")).alias("r")
    )
    recent = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "items")])
    texts = o.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("r").alias("r")).select("k", F.to_json(F.struct(F.col("k").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    found, _ = L.filings(texts, "payload", ["k"])
    return found.select("k", "accession", "form", "filed", F.array_join("items", "|").alias("items"))


@query(
    """SELECT o_orderkey AS k, o_orderdate::DATE AS day, 'OWNER ' || o_custkey AS insider, CASE o_custkey % 3 WHEN 0 THEN 'CFO' WHEN 1 THEN 'Director' END AS position,
  CASE o_orderstatus WHEN 'F' THEN 'sell' WHEN 'O' THEN 'buy' ELSE 'gift' END AS kind, (o_custkey % 50)::DOUBLE AS shares, CASE WHEN o_orderkey % 5 > 0 THEN 12.5::DOUBLE END AS price,
  CASE WHEN o_custkey % 50 > 0 AND o_orderkey % 5 > 0 THEN round((o_custkey % 50) * 12.5::DOUBLE, 2) END AS value, o_custkey % 2 = 0 AND o_orderstatus IN ('F', 'O') AS planned, o_orderkey % 4 = 0 AS indirect FROM orders"""
)
def ownership_documents(spark, sf):
    """Every order as an ownership document of one transaction."""
    xml = """concat('<ownershipDocument><aff10b5One>', CAST(o_custkey % 2 = 0 AS STRING), '</aff10b5One><reportingOwner><reportingOwnerId><rptOwnerName>OWNER ', o_custkey, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>',
      CASE o_custkey % 3 WHEN 0 THEN '<officerTitle>CFO</officerTitle>' WHEN 1 THEN '<isDirector>1</isDirector>' ELSE '<isDirector>0</isDirector>' END, '</reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>',
      date_format(o_orderdate, 'yyyy-MM-dd'), '</value></transactionDate><transactionCoding><transactionCode>', CASE o_orderstatus WHEN 'F' THEN 'S' WHEN 'O' THEN 'P' ELSE 'g' END, '</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>',
      o_custkey % 50, '</value></transactionShares><transactionPricePerShare>', IF(o_orderkey % 5 > 0, '<value>12.5</value>', '<footnoteId/>'), '</transactionPricePerShare></transactionAmounts><ownershipNature><directOrIndirectOwnership><value>',
      IF(o_orderkey % 4 = 0, 'I', 'D'), '</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>')"""
    return L.ownership(table(spark, sf, "orders").selectExpr("o_orderkey AS k", f"{xml} AS payload"), "payload", ["k"])


@query(
    """WITH e AS (SELECT *, (user_id % 5)::INT AS s FROM events) SELECT 'S' || substr('ABCDE', s + 1, 1) AS symbol, event_id AS id, CASE WHEN event_type IN ('click', 'purchase') AND (user_id % 2 = 0 OR event_id % 3 = 0) THEN CASE event_type WHEN 'click' THEN 'bullish' ELSE 'bearish' END END AS stance,
  user_id % 2 = 0 OR event_id % 3 = 0 AS own, CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id % 7 END + event_id % 3 AS engagement, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS symbols FROM e"""
)
def board_posts(spark, sf):
    """A symbol's events of a day as two overlapping pages of messages."""
    text = """to_json(named_struct('id', event_id, 'body', concat(IF(event_id % 3 = 0, concat('$s', lower(substr('ABCDE', CAST(1 + user_id % 5 AS INT), 1)), ' '), ''), 'note ', event_id), 'created_at', '2024-01-01T00:00:00Z',
      'entities', named_struct('sentiment', named_struct('basic', CASE event_type WHEN 'click' THEN 'Bullish' WHEN 'purchase' THEN 'Bearish' END)), 'likes', IF(event_id % 4 = 0, NULL, named_struct('total', user_id % 7)), 'reshares', named_struct('reshared_count', event_id % 3),
      'symbols', IF(user_id % 2 = 0, array(named_struct('symbol', concat('S', substr('ABCDE', CAST(1 + user_id % 5 AS INT), 1)))), array(named_struct('symbol', 'ZZ'), named_struct('symbol', concat('s', substr('ABCDE', CAST(1 + user_id % 5 AS INT), 1)))))))"""
    e = table(spark, sf, "events").selectExpr("concat('S', substr('ABCDE', CAST(1 + user_id % 5 AS INT), 1)) AS symbol", "CAST(ts AS DATE) AS d", "event_id", f"{text} AS m")
    e = e.withColumn("page", F.explode(F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    pages = e.groupBy("symbol", "d", "page").agg(F.concat(F.lit('{"messages": ['), F.array_join(F.collect_list("m"), ","), F.lit("]}")).alias("payload"))
    return L.posts(pages, "payload", F.col("symbol"), "page").select("symbol", "id", "stance", "own", "engagement", F.col("symbols").cast("long").alias("symbols"))


@query(
    """WITH c AS (SELECT upper(substr(c_mktsegment, 1, 2)) || (c_custkey % 200) AS ticker, c_custkey, c_name FROM customer), f AS (SELECT ticker, min(c_custkey) AS k FROM c WHERE c_custkey % 10 <> 3 GROUP BY 1)
SELECT f.ticker, lpad(k::VARCHAR, 10, '0') AS cik, c_name AS title FROM f JOIN c ON c_custkey = k"""
)
def registry_tickers(spark, sf):
    """All customers as one registry map a segment and number; every tenth listing has no number."""
    c = table(spark, sf, "customer").selectExpr("c_custkey", "lower(concat(substr(c_mktsegment, 1, 2), c_custkey % 200)) AS t", "c_name")
    row = F.to_json(F.struct(F.when(F.col("c_custkey") % 10 != 3, F.col("c_custkey").cast("string")).otherwise("x").alias("cik_str"), F.col("t").alias("ticker"), F.col("c_name").alias("title")))
    texts = c.withColumn("e", F.struct("c_custkey", F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('": '), row).alias("x"))).groupBy("t").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return L.registry(texts.select(F.concat(F.lit("{"), F.array_join(F.transform("es", lambda e: e["x"]), ","), F.lit("}")).alias("payload")), "payload")


@query(
    """WITH p AS (SELECT p_partkey, p_size, p_name, 'T' || (p_partkey % 1500) AS ticker FROM part), f AS (SELECT ticker, min(p_partkey) AS k FROM p GROUP BY 1)
SELECT f.ticker, CASE WHEN p_size > 3 THEN p_size - 3 END AS rank, p_name AS name, (k % 90)::INT AS mentions, CASE WHEN k % 40 >= 5 THEN round(100.0 * ((k % 90) - (k % 40)) / (k % 40), 1) END AS change_pct FROM f JOIN p ON p_partkey = k"""
)
def paged_leaderboard(spark, sf):
    """Parts as a board in pages of a hundred; broken pages between them are tolerated."""
    p = table(spark, sf, "part").selectExpr("p_partkey", "floor(p_partkey / 100) AS page", "to_json(named_struct('rank', p_size - 3, 'ticker', concat('t', p_partkey % 1500), 'name', p_name, 'mentions', p_partkey % 90, 'upvotes', 1, 'mentions_24h_ago', p_partkey % 40)) AS r")
    pages = p.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))).alias("rs")).select("page", F.concat(F.lit('{"results": ['), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit("]}")).alias("payload"))
    broken = pages.select((F.col("page") - 1).alias("page"), F.lit('{"results": [{"rank": 1,').alias("payload"))
    return L.leaderboard(pages.unionByName(broken), "payload", "page").select("ticker", "rank", "name", "mentions", r6("change_pct").alias("change_pct"))
