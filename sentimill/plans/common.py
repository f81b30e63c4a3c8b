"""Views that the queries share: items from events, closes and tone from orders; each also as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimill.functions.scalars import recency, tone_label
from sentimill.sources import table

NOW = "2024-01-31 00:00:00"


def r6(c: str | Column) -> Column:
    """Rounded for comparison across engines; minus zero becomes zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored items: a user is a voice, twenty outlets, the event type is the topic."""
    e = table(spark, sf_dir, "events")
    age = (F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600.0
    return (
        e.withColumn("score", F.tanh((F.col("value") - 50.0) / 50.0))
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("weight", recency(age))
        .withColumn("confidence", 1.0 - F.exp(-F.abs(F.col("value") - 50.0) / 50.0))
        .withColumn("label", tone_label(F.col("score")))
        .withColumn("outlet", F.concat(F.lit("o"), (F.col("user_id") % 20).cast("string")))
    )


ITEMS = f"""items AS (
  SELECT event_id, user_id, event_type, value, props, ts, floor(epoch(ts))::BIGINT AS s, tanh((value - 50.0) / 50.0) AS score,
         greatest(0.15, pow(0.5, ((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600.0) / 72.0)) AS weight,
         1.0 - exp(-abs(value - 50.0) / 50.0) AS confidence,
         CASE WHEN tanh((value - 50.0) / 50.0) > 0.05 THEN 'bullish' WHEN tanh((value - 50.0) / 50.0) < -0.05 THEN 'bearish' ELSE 'neutral' END AS label,
         'o' || (user_id % 20)::VARCHAR AS outlet
  FROM events)"""


def orders_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("asset", F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string"))).withColumn("d", F.to_date("o_orderdate"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, d, close): mean price of the finished orders of a day."""
    return orders_by_asset(spark, sf_dir).where(F.col("o_orderstatus") == "F").groupBy("asset", "d").agg(F.avg("o_totalprice").alias("close"))


def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, d, tone, volume): tone and count of the other orders of a day."""
    x = F.tanh((F.col("o_totalprice") - 250000.0) / 150000.0)
    return orders_by_asset(spark, sf_dir).where(F.col("o_orderstatus") != "F").groupBy("asset", "d").agg(F.avg(x).alias("tone"), F.count(F.lit(1)).cast("double").alias("volume"))


CLOSES = """closes AS (
  SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, o_orderdate::DATE AS d, avg(o_totalprice) AS close FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)"""
TONES = """tones AS (
  SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, o_orderdate::DATE AS d, avg(tanh((o_totalprice - 250000.0) / 150000.0)) AS tone, count(*)::DOUBLE AS volume
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)"""
