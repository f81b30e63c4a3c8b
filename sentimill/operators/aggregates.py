"""Weighted tone aggregates over scored items.

Items are rows with keys and columns ``score`` (-1..1), ``weight``, ``confidence``, ``label``,
``outlet``, ``ts`` as far as an operator needs them. Each operator is one hash aggregate, with partial
sums before its shuffle, unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentimill.functions.scalars import clamp

#: Neutral pseudo-items behind a shown tone; most themes shown.
STAT_PRIOR, MOST_THEMES = 2.0, 12


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value x weight over the sum of weights above zero; null without any."""
    w = F.when(weight > 0, weight)
    return F.sum(value * w) / F.sum(w)


def kish_n(weight: Column) -> Column:
    """Effective sample size (sum w)^2 / sum w^2 over weights above zero; 0 without any."""
    w = F.when(weight > 0, weight)
    return F.coalesce(F.sum(w) * F.sum(w) / F.sum(w * w), F.lit(0.0))


def summarize(items: DataFrame, *keys: str) -> DataFrame:
    """One row per key: mean, n, n_eff, weight, label counts, spread, mean_confidence, outlets, shrunk, confidence.

    The spread comes from sums of w, wx and wx^2, so one pass does.
    """
    w = F.when(F.col("weight") > 0, F.col("weight"))
    x = F.col("score")
    grouped = items.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        kish_n(F.col("weight")).alias("n_eff"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"),
        F.sum(w * x).alias("_wx"),
        F.sum(w * x * x).alias("_wxx"),
        F.count_if(F.col("label") == "bullish").alias("bullish"),
        F.count_if(F.col("label") == "bearish").alias("bearish"),
        F.count_if(F.col("label") == "neutral").alias("neutral"),
        F.avg("confidence").alias("mean_confidence"),
        F.countDistinct("outlet").alias("outlets"),
    )
    mean = F.col("_wx") / F.when(F.col("weight") > 0, F.col("weight"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_wxx") / F.when(F.col("weight") > 0, F.col("weight")) - mean * mean))
    volume = F.col("n_eff") / (F.col("n_eff") + 6.0)
    consistency = 1.0 - F.least(F.lit(1.0), F.col("spread") / 0.6)
    return (
        grouped.withColumn("mean", mean)
        .withColumn("spread", F.coalesce(spread, F.lit(0.0)))
        .withColumn("shrunk", F.coalesce(F.col("mean") * F.col("n") / (F.col("n") + STAT_PRIOR), F.lit(0.0)))
        .withColumn("confidence", clamp(volume * (0.6 + 0.25 * consistency + 0.15 * F.coalesce("mean_confidence", F.lit(0.0)))))
        .drop("_wx", "_wxx")
    )


def timeline(items: DataFrame, key: str, now: Column, days: int = 7) -> DataFrame:
    """Tone per bucket and key over the last days; buckets of an hour where a key's items span 48 h at most, else of six.

    The span is one small aggregate a key, joined back; items are aggregated once.
    """
    seconds = F.unix_seconds(F.col("ts"))
    end = F.unix_seconds(now)
    dated = items.where(F.col("score").isNotNull() & F.col("ts").isNotNull() & (end - seconds <= days * 86400)).withColumn("_s", seconds)
    step = dated.groupBy(key).agg(F.when(end - F.min("_s") <= 48 * 3600, 3600).otherwise(6 * 3600).alias("_step"))
    return (
        dated.join(step, key)
        .groupBy(key, F.timestamp_seconds(F.col("_s") - F.pmod(F.col("_s"), F.col("_step"))).alias("bucket"))
        .agg(
            weighted_mean(F.col("score"), F.col("weight")).alias("tone"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("label") == "bullish").alias("bullish"),
            F.count_if(F.col("label") == "bearish").alias("bearish"),
        )
    )


def theme_stats(items: DataFrame, key: str, themes: str = "themes", most: int = MOST_THEMES) -> DataFrame:
    """Count, weighted tone and share of every theme of a key, the ``most`` covered first (ties: weight, name).

    A theme needs two items where the key has twenty. ``themes`` is an array column. Weights are compared
    by their sums in decimals, which don't hang on the order of the items: equal items give equal sums.
    """
    scored = items.where(F.col("score").isNotNull())
    totals = scored.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    tagged = (
        scored.select(key, "score", "weight", F.explode(F.array_distinct(themes)).alias("theme"))
        .groupBy(key, "theme")
        .agg(F.count(F.lit(1)).alias("n"), weighted_mean(F.col("score"), F.col("weight")).alias("tone"), F.sum(F.col("weight").cast("decimal(28,18)")).alias("weight"))
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc("weight"), "theme"))
    return (
        tagged.join(totals, key)
        .where(F.col("n") >= F.when(F.col("_total") >= 20, 2).otherwise(1))
        .withColumn("rank", rank)
        .where(F.col("rank") <= most)
        .select(key, "theme", "n", "tone", (F.col("n") / F.col("_total")).alias("share"), "rank")
    )


def latest_stance(posts: DataFrame, keys: list[str], author: str, label: str, ts: str, message: str) -> DataFrame:
    """Bullish and bearish tallies by message and by author, whose latest stance counts; posts without an author are voters of their own."""
    voter = F.coalesce(F.concat(F.lit("a:"), F.col(author).cast("string")), F.concat(F.lit("m:"), F.col(message).cast("string")))
    per_voter = (
        posts.where(F.col(label).isin("bullish", "bearish"))
        .groupBy(*keys, voter.alias("_voter"))
        .agg(
            F.max_by(F.col(label), F.struct(ts, message)).alias("stance"),
            F.count_if(F.col(label) == "bullish").alias("bull"),
            F.count_if(F.col(label) == "bearish").alias("bear"),
        )
    )
    return per_voter.groupBy(*keys).agg(
        F.sum("bull").alias("bull_messages"),
        F.sum("bear").alias("bear_messages"),
        F.count_if(F.col("stance") == "bullish").alias("bull_authors"),
        F.count_if(F.col("stance") == "bearish").alias("bear_authors"),
    )


def diversify(items: DataFrame, keys: list[str], voice: str, free: int = 4) -> DataFrame:
    """Weights times sqrt(free / n) where a voice has n > free items of a key.

    The counts are aggregated and joined back, so a voice with very many items is never one window partition.
    """
    counts = items.groupBy(*keys, voice).agg(F.count(F.lit(1)).alias("_n"))
    return (
        items.join(counts, [*keys, voice])
        .withColumn("weight", F.col("weight") * F.when(F.col("_n") > free, F.sqrt(F.lit(float(free)) / F.col("_n"))).otherwise(1.0))
        .drop("_n")
    )
