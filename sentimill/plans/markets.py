"""Series, alignment, event-fact and alert queries over orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentimill.operators import alerts, alignment
from sentimill.operators import series as X
from sentimill.plans.common import CLOSES, ITEMS, TONES, closes, items, orders_by_asset, r6, tones
from sentimill.sources import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {CLOSES} SELECT asset, d, round((close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1.0) * 100.0, 6) AS ret_pct FROM closes")
def daily_returns(spark, sf):
    return X.daily_returns(closes(spark, sf), "asset").select("asset", "d", r6("ret_pct").alias("ret_pct"))


ALIGNED = f"""{CLOSES}, {TONES}, r AS (SELECT asset, d, lag(d) OVER w AS p, (close / lag(close) OVER w - 1.0) * 100.0 AS ret_pct FROM closes WINDOW w AS (PARTITION BY asset ORDER BY d)),
al AS (SELECT r.asset, r.d, sum(t.tone * t.volume) / sum(t.volume) AS tone, any_value(r.ret_pct) AS ret_pct FROM r LEFT JOIN tones t ON t.asset = r.asset AND t.d > r.p AND t.d <= r.d WHERE r.p IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {ALIGNED} SELECT asset, d, round(tone, 6) AS tone, round(ret_pct, 6) AS ret_pct FROM al")
def interval_align_to_session(spark, sf):
    a = X.aligned_series(tones(spark, sf), closes(spark, sf), "asset")
    return a.select("asset", "d", r6("tone").alias("tone"), r6("ret_pct").alias("ret_pct"))


LAGGED = f"""{ALIGNED}, num AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM al),
pr AS (SELECT a.asset, k.lag, a.tone, b.ret_pct FROM num a CROSS JOIN (SELECT unnest(range(-3, 4))::INT AS lag) k JOIN num b ON b.asset = a.asset AND b.i = a.i + k.lag WHERE a.tone IS NOT NULL),
lg AS (SELECT asset, lag, count(*) AS n, corr(tone, ret_pct) AS r FROM pr GROUP BY 1, 2 HAVING count(*) >= 10)"""


@query(f"WITH {LAGGED} SELECT asset, lag, n, round(r, 6) AS r FROM lg")
def lag_correlation(spark, sf):
    s = X.lag_stats(X.aligned_series(tones(spark, sf), closes(spark, sf), "asset"), "asset")
    return s.select("asset", "lag", "n", r6("r").alias("r"))


@query()
def lag_best(spark, sf):
    s = X.lag_stats(X.aligned_series(tones(spark, sf), closes(spark, sf), "asset"), "asset").withColumn("p", X.corr_pvalue("r", "n"))
    return X.best_lag(s, "asset").select("asset", "lag", "n", r6("r").alias("r"), r6("p").alias("p"), ((F.col("p") * 7 < 0.05) & (F.abs("r") >= 0.2)).alias("reliable"))


@query(
    f"""WITH {CLOSES}, o AS (SELECT DISTINCT 'a' || (o_custkey % 7)::VARCHAR AS asset, o_orderdate::DATE AS d FROM orders)
SELECT o.asset, o.d, round(c.close, 4) AS close, c.d AS close_day FROM o ASOF LEFT JOIN closes c ON o.asset = c.asset AND o.d >= c.d"""
)
def asof_close(spark, sf):
    o = orders_by_asset(spark, sf).select("asset", "d").distinct()
    j = alignment.asof_backward(o, closes(spark, sf), "asset", "d", "close")
    return j.select("asset", "d", F.round("close", 4).alias("close"), F.col("d_of_close").alias("close_day"))


@query(
    f"""WITH {CLOSES}, l AS (SELECT asset, max(d) AS last FROM closes GROUP BY 1)
SELECT asset, last AS d, round(arg_min(close, (abs(date_diff('day', d, last) - 30), -date_diff('day', DATE '1970-01-01', d))), 4) AS close FROM closes JOIN l USING (asset) WHERE abs(date_diff('day', d, last) - 30) <= 10 GROUP BY 1, 2"""
)
def nearest_value_ago(spark, sf):
    return alignment.nearest_ago(closes(spark, sf), "asset", "d", "close", 30, 10).select("asset", "d", F.round("close", 4).alias("close"))


ROLL = "OVER (PARTITION BY asset ORDER BY d RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW)"


def _roll(n: int, least: int) -> str:
    w = ROLL.format(n=n - 1)
    return f"CASE WHEN count(*) {w} >= {least} THEN sum(tone * volume) {w} / sum(volume) {w} END"


@query(f"WITH {TONES} SELECT asset, d, round({_roll(7, 3)}, 6) AS tone_7d FROM tones")
def rolling_tone_7d(spark, sf):
    return tones(spark, sf).select("asset", "d", r6(X.window_tone("asset", 7, 3)).alias("tone_7d"))


@query(
    f"""WITH {TONES}, r AS (SELECT asset, d, {_roll(7, 3)} AS t7, {_roll(30, 8)} AS t30, {_roll(90, 23)} AS t90, {_roll(7, 4)} AS roll FROM tones),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY asset ORDER BY d DESC) = 1)
SELECT l.asset, round(l.t7, 6) AS tone_7d, round(l.t30, 6) AS tone_30d, round(l.t90, 6) AS tone_90d, round(l.t7 - l.t30, 6) AS change_7d_vs_30d,
  round(CASE WHEN l.t7 IS NOT NULL AND count(r.roll) >= 10 THEN (count(*) FILTER (r.roll < l.t7) + 0.5 * count(*) FILTER (r.roll = l.t7))::DOUBLE / count(r.roll) END, 6) AS percentile_7d
FROM l LEFT JOIN r ON r.asset = l.asset AND r.roll IS NOT NULL AND r.d > l.d - 90 GROUP BY l.asset, l.t7, l.t30, l.t90"""
)
def tone_percentile_midrank(spark, sf):
    t = X.tone_stats(tones(spark, sf), "asset")
    return t.select("asset", *[r6(c).alias(c) for c in ("tone_7d", "tone_30d", "tone_90d", "change_7d_vs_30d", "percentile_7d")])


DAILY = f"{ITEMS}, daily AS (SELECT event_type, ts::DATE AS d, count(*)::DOUBLE AS value, avg(score) AS tone FROM items GROUP BY 1, 2)"


def daily(spark, sf):
    i = items(spark, sf)
    return i.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("value"), F.avg("score").alias("tone"))


@query(
    f"""WITH {DAILY}, k AS (SELECT event_type, ln(1.0 + value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS k FROM daily)
SELECT event_type, count(*) FILTER (k > 2) AS n_base, round((avg(v) FILTER (k <= 2) - avg(v) FILTER (k > 2)) / greatest(stddev_samp(v) FILTER (k > 2), 0.1), 6) AS z FROM k WHERE k <= 30 GROUP BY 1"""
)
def spike_z(spark, sf):
    return X.spike_z(daily(spark, sf), "event_type").select("event_type", "n_base", r6("z").alias("z"))


@query(
    f"""WITH {DAILY}, x AS (SELECT event_type, d, value * CASE WHEN d >= DATE '2024-01-28' THEN 0.3 ELSE 1.0 END AS norm FROM daily),
h AS (SELECT *, list_sort(list(norm) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) AS seen FROM x),
f AS (SELECT event_type, d, coalesce(len(seen) >= 5 AND norm < 0.6 * seen[(len(seen) // 2) + 1], false) AS low FROM h)
SELECT event_type, d FROM (SELECT *, bool_and(low) OVER (PARTITION BY event_type ORDER BY d DESC) AS tail FROM f) WHERE tail"""
)
def incomplete_tail(spark, sf):
    x = daily(spark, sf).withColumn("norm", F.col("value") * F.when(F.col("d") >= F.lit("2024-01-28").cast("date"), 0.3).otherwise(1.0))
    return X.incomplete_tail(x, "event_type").select("event_type", "d")


@query(
    f"""WITH RECURSIVE {CLOSES}, m AS (SELECT asset, row_number() OVER w AS i, close - lag(close) OVER w AS x FROM closes WINDOW w AS (PARTITION BY asset ORDER BY d)),
f AS (SELECT asset, 15 AS i, avg(greatest(x, 0.0)) AS u, avg(greatest(-x, 0.0)) AS v FROM m WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14
  UNION ALL SELECT f.asset, m.i, (f.u * 13 + greatest(m.x, 0.0)) / 14, (f.v * 13 + greatest(-m.x, 0.0)) / 14 FROM f JOIN m ON m.asset = f.asset AND m.i = f.i + 1)
SELECT asset, round(arg_max(CASE WHEN u = 0 AND v = 0 THEN 50.0 WHEN v = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + u / v) END, i), 6) AS rsi FROM f GROUP BY 1"""
)
def wilder_rsi(spark, sf):
    return X.wilder_rsi(closes(spark, sf), "asset").select("asset", r6("rsi").alias("rsi"))


@query(
    f"""WITH {CLOSES}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY d)) AS lr FROM closes)
SELECT asset, round(max(close) FILTER (k = 1), 4) AS last, round(avg(close) FILTER (k <= 20), 4) AS sma20, round(avg(close) FILTER (k <= 50), 4) AS sma50, round(avg(close) FILTER (k <= 200), 4) AS sma200,
  round(stddev_samp(lr) FILTER (k <= 30) * sqrt(252.0) * 100.0, 6) AS vol30, round((max(close) FILTER (k = 1) / max(close) FILTER (k <= 252) - 1.0) * 100.0, 6) AS from_high_pct FROM k GROUP BY 1"""
)
def technicals(spark, sf):
    newest = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d")))
    k = closes(spark, sf).withColumns({"k": newest, "lr": F.log(F.col("close") / F.lag("close").over(X.by_day("asset")))})
    upto = lambda n, c="close": F.when(F.col("k") <= n, F.col(c))
    return k.groupBy("asset").agg(
        F.round(F.max(upto(1)), 4).alias("last"),
        *[F.round(F.avg(upto(n)), 4).alias(f"sma{n}") for n in (20, 50, 200)],
        r6(F.stddev_samp(upto(30, "lr")) * (252.0**0.5) * 100.0).alias("vol30"),
        r6((F.max(upto(1)) / F.max(upto(252)) - 1.0) * 100.0).alias("from_high_pct"),
    )


TREND = """CASE WHEN last > sma20 AND sma20 > sma50 AND sma50 > sma200 THEN 'strong uptrend' WHEN last < sma20 AND sma20 < sma50 AND sma50 < sma200 THEN 'strong downtrend'
  WHEN last > sma50 * 1.02 THEN 'uptrend' WHEN last < sma50 * 0.98 THEN 'downtrend' ELSE 'sideways' END"""


@query(f"WITH t AS ({ORACLES['technicals']}) SELECT asset, {TREND} AS trend FROM t")
def trend_label(spark, sf):
    return technicals(spark, sf).select("asset", F.expr(TREND).alias("trend"))


@query(
    """SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, o_orderdate::DATE AS d, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2"""
)
def ohlc_merge(spark, sf):
    p = F.col("o_totalprice")
    return orders_by_asset(spark, sf).groupBy("asset", "d").agg(
        F.min_by(p, "o_orderkey").alias("o"), F.max(p).alias("h"), F.min(p).alias("l"), F.max_by(p, "o_orderkey").alias("c"), F.round(F.sum(p), 2).alias("v")
    )


@query(
    """WITH o AS (SELECT o_custkey, o_orderdate::DATE AS d, o_totalprice AS p, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT n_name, d, count(DISTINCT o_custkey) AS buyers, round(sum(p), 2) AS value FROM o GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) >= 3"""
)
def insider_cluster(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy("n_name", F.to_date("o_orderdate").alias("d")).agg(F.countDistinct("o_custkey").alias("buyers"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    return g.where("buyers >= 3")


@query(
    """WITH s AS (SELECT l_orderkey, l_suppkey, l_shipdate::DATE AS d, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_suppkey, l_shipdate::DATE AS d, l_quantity AS q FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_suppkey, d, count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM a WHERE a.l_suppkey = s.l_suppkey AND a.d <= s.d AND a.d >= s.d - 5) GROUP BY 1, 2, 3"""
)
def sell_to_cover_semi_join(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_returnflag")
    awards = x.where("l_returnflag = 'A'").select("l_suppkey", F.col("d").alias("award")).distinct()
    hit = alignment.within_days(x.where("l_returnflag = 'R'").drop("l_returnflag"), awards, ["l_suppkey"], "d", "award", 5, 0, "left_semi")
    return hit.groupBy("l_orderkey", "l_suppkey", "d").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts::DATE AS d FROM events WHERE event_type = 'error'), p AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, d FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND p.d >= e.d - 1 AND p.d <= e.d + 2)"""
)
def calls_anti_join(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.to_date("ts").alias("d"), "event_type")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("d").alias("done")).distinct()
    return alignment.within_days(e.where("event_type = 'error'").drop("event_type"), p, ["user_id"], "d", "done", 1, 2, "left_anti")


@query(
    """WITH e AS (SELECT DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half, event_type || '-' || (ts::DATE)::VARCHAR AS story, user_id FROM events),
a AS (SELECT story, user_id FROM e WHERE half = 1), b AS (SELECT story AS old, user_id FROM e WHERE half = 0),
na AS (SELECT story, count(*) AS members FROM a GROUP BY 1), nb AS (SELECT old, count(*) AS k FROM b GROUP BY 1),
j AS (SELECT story, old, count(*) AS n FROM a JOIN b USING (user_id) GROUP BY 1, 2)
SELECT story, members FROM na WHERE story NOT IN (SELECT story FROM j JOIN na USING (story) JOIN nb USING (old) WHERE n >= 0.5 * least(members, k))"""
)
def new_story_anti_join(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("-", "event_type", F.to_date("ts").cast("string")).alias("story"), "user_id", (F.col("ts").cast("timestamp") < F.lit("2024-01-16").cast("timestamp")).alias("old"))
    return alignment.new_by_members(e.where("NOT old"), e.where("old"), "story", "user_id", 0.5)


@query(
    """WITH l AS (SELECT max(o_orderdate) AS last FROM orders)
SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, count(*) FILTER (o_orderstatus = 'F' AND o_orderdate > last - INTERVAL 90 DAYS) AS up_90d, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate > last - INTERVAL 90 DAYS) AS down_90d,
  count(*) FILTER (o_totalprice > 250000 AND o_orderdate > last - INTERVAL 30 DAYS) AS raises_30d FROM orders, l GROUP BY 1"""
)
def revision_counts(spark, sf):
    o = orders_by_asset(spark, sf)
    last = o.agg(F.max("d").alias("last"))  # one row
    within = lambda n: F.datediff("last", "d") < n
    j = o.withColumn("one", F.lit(1)).join(F.broadcast(last.withColumn("one", F.lit(1))), "one")
    return j.groupBy("asset").agg(
        F.count_if((F.col("o_orderstatus") == "F") & within(90)).alias("up_90d"), F.count_if((F.col("o_orderstatus") == "O") & within(90)).alias("down_90d"), F.count_if((F.col("o_totalprice") > 250000) & within(30)).alias("raises_30d")
    )


@query(
    f"""WITH RECURSIVE {ITEMS}, v AS (SELECT user_id, s, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY s, event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM items),
f AS (SELECT user_id, i, event_id, s, value >= 70 AS fired, CASE WHEN value >= 70 THEN s END AS last FROM v WHERE i = 1
  UNION ALL SELECT v.user_id, v.i, v.event_id, v.s, v.value >= 70 AND (f.last IS NULL OR (v.s - f.last >= 7200 AND v.prev < 70)),
    CASE WHEN v.value >= 70 AND (f.last IS NULL OR (v.s - f.last >= 7200 AND v.prev < 70)) THEN v.s ELSE f.last END FROM f JOIN v ON v.user_id = f.user_id AND v.i = f.i + 1)
SELECT user_id, event_id, s FROM f WHERE fired"""
)
def alert_crossing(spark, sf):
    i = items(spark, sf).withColumn("s", F.unix_seconds("ts"))
    return alerts.crossings(i, "user_id", "s", "event_id", "value", 70.0).select("user_id", "event_id", "s")


@query(
    """SELECT o_orderpriority AS member, (o_orderdate::DATE)::VARCHAR AS day, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)"""
)
def rollup_orders(spark, sf):
    o = orders_by_asset(spark, sf).select(F.col("o_orderpriority").alias("member"), F.col("d").cast("string").alias("day"))
    return o.rollup("member", "day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, sf):
    x = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 2).alias("revenue"))


@query(
    f"""WITH {ITEMS}, g AS (SELECT user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 7200 THEN 0 ELSE 1 END AS new FROM items),
k AS (SELECT user_id, s, sum(new) OVER (PARTITION BY user_id ORDER BY s, new DESC ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(s)::BIGINT AS start_s, count(*) AS n FROM k GROUP BY user_id, session"""
)
def session_windows(spark, sf):
    i = items(spark, sf).withColumn("at", F.timestamp_seconds(F.unix_seconds("ts")))
    # windows that touch are merged; a pause of two hours is to part them, and times are whole seconds
    g = i.groupBy("user_id", F.session_window("at", "7199 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_seconds("w.start").alias("start_s"), "n")


@query(
    """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"""
)
def set_operators(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").intersect(side("O")).subtract(side("P"))
