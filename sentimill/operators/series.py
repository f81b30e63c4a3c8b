"""Time-series operators over daily series of many instruments: one row per (key, day).

Windows are partitioned by the instrument, whose daily history is thousands of rows however many
instruments there are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAGS = range(-3, 4)
LEAST_PAIRS, RELIABLE_PAIRS = 10, 20
RECENT_DAYS, BASELINE_DAYS, LEAST_BASELINE, LEAST_SD = 2, 28, 14, 0.1


def by_day(key: str, day: str = "d"):
    return Window.partitionBy(key).orderBy(day)


def daily_returns(closes: DataFrame, key: str) -> DataFrame:
    """Per cent change of ``close`` against the previous day that has one."""
    prev = F.lag("close").over(by_day(key))
    return closes.where(F.col("close") > 0).withColumn("ret_pct", (F.col("close") / prev - 1.0) * 100.0)


def aligned_series(tone: DataFrame, closes: DataFrame, key: str) -> DataFrame:
    """(key, d, tone, ret_pct) a trading day: its return, and the volume-weighted tone of the days since the last close.

    Each tone day is carried to the next trading day by one ordered pass over the union of both
    tables, so no range join is needed. Tone days up to the first close fall away.
    """
    rets = daily_returns(closes, key).where(F.col("ret_pct").isNotNull()).select(key, "d", "ret_pct")
    days = closes.where(F.col("close") > 0).select(key, "d", F.col("d").alias("session"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("tone"), F.lit(None).cast("double").alias("volume"))
    covered = tone.where(F.col("tone").isNotNull() & (F.col("volume").isNull() | (F.col("volume") > 0)))
    news = covered.select(key, "d", F.lit(None).cast(closes.schema["d"].dataType).alias("session"), F.lit(0).alias("side"), "tone", "volume")
    # from the last day back, so that the frame only grows and the pass is linear
    ahead = Window.partitionBy(key).orderBy(F.desc("d"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = days.unionByName(news).withColumn("session", F.last("session", ignorenulls=True).over(ahead)).where(F.col("side") == 0)
    w = F.coalesce("volume", F.lit(1.0))
    folded = placed.where(F.col("session").isNotNull()).groupBy(key, F.col("session").alias("d")).agg((F.sum(F.col("tone") * w) / F.sum(w)).alias("tone"))
    return rets.join(folded, [key, "d"], "left").select(key, "d", "tone", "ret_pct")


def correlation(x: Column, y: Column) -> Column:
    """Pearson r of pairs, null where either side is constant or there are under three."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    sd = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when((n >= 3) & (sd > 0), F.covar_pop(x, y) / F.when(sd > 0, sd))


def lag_stats(aligned: DataFrame, key: str) -> DataFrame:
    """(key, lag, n, r) for lags -3..3 sessions with at least ten pairs: lag > 0 means tone leads."""
    w = by_day(key)
    shifted = aligned
    for k in LAGS:
        shifted = shifted.withColumn(f"_r{k + 3}", F.lead("ret_pct", k).over(w) if k >= 0 else F.lag("ret_pct", -k).over(w))
    pairs = shifted.where(F.col("tone").isNotNull()).select(
        key, "tone", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_r{k + 3}").alias("ret")) for k in LAGS])).alias("p")
    ).select(key, "tone", "p.lag", "p.ret").where(F.col("ret").isNotNull())
    return (
        pairs.groupBy(key, "lag")
        .agg(F.count(F.lit(1)).alias("n"), correlation(F.col("tone"), F.col("ret")).alias("r"))
        .where((F.col("n") >= LEAST_PAIRS) & F.col("r").isNotNull())
    )


@F.pandas_udf(T.DoubleType())
def corr_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation r over n pairs: Student's t with n - 2 degrees, by the incomplete beta's continued fraction."""
    import math

    def beta_fraction(a: float, b: float, x: float) -> float:
        # backward evaluation: partial denominators are 1, numerators alternate
        f = 0.0
        for m in range(200, 0, -1):
            odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            f = odd / (1.0 + even / (1.0 + f))
        return 1.0 / (1.0 + f)

    def regularized(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x < (a + 1) / (a + b + 2):
            return front * beta_fraction(a, b, x) / a
        return 1 - front * beta_fraction(b, a, 1 - x) / b

    def one(r: float, n: float) -> float:
        if n < 3:
            return 1.0
        if abs(r) >= 1:
            return 0.0
        t2 = r * r * (n - 2) / (1 - r * r)
        return min(1.0, max(0.0, regularized((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))))

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)])


def best_lag(stats: DataFrame, key: str) -> DataFrame:
    """The lag of each key with the least p among those with twenty pairs (else among all); ties by |r|, then by nearness."""
    order = [F.desc(F.col("n") >= RELIABLE_PAIRS), F.col("p"), F.desc(F.abs("r")), F.abs("lag"), F.col("lag")]
    return stats.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def covered_tone(series: DataFrame) -> Column:
    return F.col("tone").isNotNull() & (F.col("volume").isNull() | (F.col("volume") > 0))


def window_tone(key: str, days: int, least: int) -> Column:
    """Tone over the calendar days (d - days, d]: weighted by volume where all are known, else plain; null under ``least`` covered days."""
    w = Window.partitionBy(key).orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    ok = F.col("tone").isNotNull() & (F.col("volume").isNull() | (F.col("volume") > 0))
    n = F.count(F.when(ok, 1)).over(w)
    known = F.count(F.when(ok & F.col("volume").isNotNull(), 1)).over(w)
    weighted = F.sum(F.when(ok, F.col("tone") * F.col("volume"))).over(w) / F.sum(F.when(ok, F.col("volume"))).over(w)
    plain = F.sum(F.when(ok, F.col("tone"))).over(w) / n
    return F.when(n >= least, F.when(known == n, weighted).otherwise(plain))


def tone_stats(series: DataFrame, key: str) -> DataFrame:
    """tone_7d, tone_30d, tone_90d, change_7d_vs_30d and the mid-rank percentile of the latest 7-day tone among rolling ones, a key."""
    rolled = series.select(
        key, "d", covered_tone(series).alias("_ok"),
        window_tone(key, 7, 3).alias("t7"), window_tone(key, 30, 8).alias("t30"), window_tone(key, 90, 23).alias("t90"), window_tone(key, 7, 4).alias("roll"),
    )
    last = rolled.groupBy(key).agg(F.max(F.struct("d", "t7", "t30", "t90")).alias("z")).select(key, "z.*")
    roll = rolled.where(F.col("_ok") & F.col("roll").isNotNull()).select(key, F.col("d").alias("_d"), "roll")
    ranked = (
        last.join(roll, key, "left")
        .withColumn("roll", F.when(F.col("_d") > F.date_sub("d", 90), F.col("roll")))
        .groupBy(key, "d", "t7", "t30", "t90")
        .agg(F.count("roll").alias("_n"), F.count_if(F.col("roll") < F.col("t7")).alias("_below"), F.count_if(F.col("roll") == F.col("t7")).alias("_same"))
    )
    return ranked.select(
        key,
        F.col("t7").alias("tone_7d"),
        F.col("t30").alias("tone_30d"),
        F.col("t90").alias("tone_90d"),
        (F.col("t7") - F.col("t30")).alias("change_7d_vs_30d"),
        F.when(F.col("t7").isNotNull() & (F.col("_n") >= 10), (F.col("_below") + 0.5 * F.col("_same")) / F.col("_n")).alias("percentile_7d"),
    )


def incomplete_tail(series: DataFrame, key: str, norm: str = "norm") -> DataFrame:
    """Days of ``series`` at a key's end whose ``norm`` is below 0.6 of the upper median of the 14 days before (of which five are known).

    Only an unbroken run to the last day counts.
    """
    w = by_day(key).rowsBetween(-14, -1)
    known = F.array_sort(F.collect_list(F.when(F.col(norm) > 0, F.col(norm))).over(w))
    base = F.when(F.size(known) >= 5, F.get(known, F.floor(F.size(known) / 2).cast("int")))
    low = F.coalesce(F.col(norm) < 0.6 * base, F.lit(False))
    behind = Window.partitionBy(key).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn("_low", low).withColumn("_all", F.min("_low").over(behind)).where(F.col("_all")).drop("_low", "_all")


def spike_z(series: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, z): mean of log1p over the last two rows less that of up to 28 before, in their deviations (0.1 at least); null under 14 of those."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("d")))
    v = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    rows = series.where(F.col(value).isNotNull()).select(key, back.alias("_k"), v.alias("_v")).where(F.col("_k") <= RECENT_DAYS + BASELINE_DAYS)
    recent, base = F.when(F.col("_k") <= RECENT_DAYS, F.col("_v")), F.when(F.col("_k") > RECENT_DAYS, F.col("_v"))
    z = (F.avg(recent) - F.avg(base)) / F.greatest(F.stddev_samp(base), F.lit(LEAST_SD))
    return rows.groupBy(key).agg(F.count(base).alias("n_base"), z.alias("_z")).select(key, "n_base", F.when(F.col("n_base") >= LEAST_BASELINE, F.col("_z")).alias("z"))


def wilder_rsi(closes: DataFrame, key: str, period: int = 14) -> DataFrame:
    """(key, rsi): the relative strength index with recursive smoothing, as a fold over each key's closes in order."""
    ordered = closes.where(F.col("close") > 0).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "close"))), lambda z: z["close"]).alias("c"))
    steps = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i) - F.get("c", i - 1))

    def mean_of(sign: int) -> Column:
        move = lambda x: F.greatest(x * sign, F.lit(0.0))
        first = F.aggregate(F.slice("s", 1, period), F.lit(0.0), lambda a, x: a + move(x)) / period
        rest = F.slice("s", period + 1, F.greatest(F.size("s") - period, F.lit(0)))
        return F.aggregate(rest, first, lambda a, x: (a * (period - 1) + move(x)) / period)

    out = ordered.where(F.size("c") > period).withColumn("s", steps).select(key, mean_of(1).alias("up"), mean_of(-1).alias("down"))
    rsi = F.when((F.col("up") == 0) & (F.col("down") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("up") / F.when(F.col("down") != 0, F.col("down"))))
    return out.select(key, rsi.alias("rsi"))


def downsample(points: DataFrame, key: str, at: str, value: str, tie: str, bins: int = 30) -> DataFrame:
    """The last value in each of at most ``bins`` bins of equal time between a key's first and last point."""
    seconds = F.unix_seconds(F.col(at))
    span = points.groupBy(key).agg(F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"))
    bin_ = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((seconds - F.col("_lo")) * F.lit(bins) / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo"))).cast("int")))
    return (
        points.where(F.col(at).isNotNull())
        .join(span, key)
        .groupBy(key, bin_.alias("bin"))
        .agg(F.max_by(F.col(value), F.struct(seconds, F.col(tie))).alias(value), F.count(F.lit(1)).alias("n"))
    )


def headline_shift(items: DataFrame, key: str, now: Column, least: int = 5) -> DataFrame:
    """Mean tone of the last 48 h against that of the five days before: means, standard error from spreads and effective counts, z.

    Null where either side has under ``least`` items.
    """
    age = (F.unix_seconds(now) - F.unix_seconds(F.col("ts"))) / 3600.0
    side = F.when(age.between(0, 48), "new").when((age > 48) & (age <= 7 * 24), "old")
    out = items.where(F.col("score").isNotNull()).withColumn("_side", side)
    w, x = F.col("weight"), F.col("score")
    aggregates = []
    for s in ("new", "old"):
        ws, xs = F.when(F.col("_side") == s, w), F.when(F.col("_side") == s, x)
        mean = F.sum(ws * xs) / F.sum(ws)
        aggregates += [
            F.count(xs).alias(f"n_{s}"),
            mean.alias(f"mean_{s}"),
            F.greatest(F.lit(0.0), F.sum(ws * xs * xs) / F.sum(ws) - mean * mean).alias(f"_var_{s}"),
            (F.sum(ws) * F.sum(ws) / F.sum(ws * ws)).alias(f"_eff_{s}"),
        ]
    se = F.sqrt(F.col("_var_new") / F.greatest("_eff_new", F.lit(1.0)) + F.col("_var_old") / F.greatest("_eff_old", F.lit(1.0)))
    enough = (F.col("n_new") >= least) & (F.col("n_old") >= least)
    diff = F.col("mean_new") - F.col("mean_old")
    return out.groupBy(key).agg(*aggregates).select(
        key, "n_new", "n_old", F.when(enough, diff).alias("change"), F.when(enough, diff / F.greatest(se, F.lit(0.02))).alias("z")
    )
