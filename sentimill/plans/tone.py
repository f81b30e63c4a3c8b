"""Tone aggregates and composites over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentimill.functions import scalars as S
from sentimill.operators import aggregates as A
from sentimill.operators import series as X
from sentimill.plans.common import ITEMS, NOW, items, r6
from sentimill.sources import table

QUERIES, ORACLES = {}, {}
SUMMARY = f"""{ITEMS}, g AS (
  SELECT event_type, count(*) AS n, sum(weight) AS w, sum(weight * score) AS wx, sum(weight * score * score) AS wxx, sum(weight * weight) AS ww,
         count(*) FILTER (label = 'bullish') AS bullish, count(*) FILTER (label = 'bearish') AS bearish, count(*) FILTER (label = 'neutral') AS neutral,
         avg(confidence) AS mc, count(DISTINCT outlet) AS outlets
  FROM items GROUP BY event_type), s AS (
  SELECT *, wx / w AS mean, sqrt(greatest(0.0, wxx / w - (wx / w) * (wx / w))) AS spread, w * w / ww AS n_eff FROM g)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {SUMMARY} SELECT event_type, n, round(mean, 6) AS tone, round(n_eff, 6) AS n_eff, round(spread, 6) AS spread, bullish, bearish, neutral, outlets, round(mean * n / (n + 2.0), 6) AS shrunk FROM s")
def weighted_tone_by_type(spark, sf):
    s = A.summarize(items(spark, sf), "event_type")
    return s.select("event_type", "n", r6("mean").alias("tone"), r6("n_eff").alias("n_eff"), r6("spread").alias("spread"), "bullish", "bearish", "neutral", "outlets", r6("shrunk").alias("shrunk"))


@query(f"WITH {ITEMS} SELECT user_id, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff FROM items GROUP BY user_id")
def kish_effective_n(spark, sf):
    return items(spark, sf).groupBy("user_id").agg(r6(A.kish_n(F.col("weight"))).alias("n_eff"))


@query(f"WITH {SUMMARY} SELECT event_type, round(least(1.0, greatest(0.0, n_eff / (n_eff + 6.0) * (0.6 + 0.25 * (1.0 - least(1.0, spread / 0.6)) + 0.15 * mc))), 6) AS confidence FROM s")
def tone_confidence(spark, sf):
    return A.summarize(items(spark, sf), "event_type").select("event_type", r6("confidence").alias("confidence"))


LABEL = "CASE WHEN mean > 0.05 THEN 'bullish' WHEN mean < -0.05 THEN 'bearish' ELSE 'neutral' END"


@query(
    f"""WITH {SUMMARY.replace('GROUP BY event_type', 'GROUP BY user_id').replace('SELECT event_type, count', 'SELECT user_id, count')}, l AS (SELECT *, {LABEL} AS own FROM s)
SELECT user_id, CASE WHEN own = 'neutral' OR abs(mean) >= 0.10 OR (mean > 0 AND (bullish - bearish)::DOUBLE / n >= 0.10) OR (mean <= 0 AND (bullish - bearish)::DOUBLE / n <= -0.10) THEN own ELSE 'neutral' END AS label, round(mean, 6) AS tone FROM l"""
)
def aggregate_label(spark, sf):
    s = A.summarize(items(spark, sf), "user_id")
    return s.select("user_id", S.lean_label(F.col("mean"), F.col("bullish"), F.col("bearish"), F.col("n")).alias("label"), r6("mean").alias("tone"))


@query(
    f"""WITH {ITEMS}, dated AS (SELECT * FROM items WHERE epoch(TIMESTAMP '{NOW}') - s <= 7 * 86400),
steps AS (SELECT user_id, CASE WHEN epoch(TIMESTAMP '{NOW}') - min(s) <= 48 * 3600 THEN 3600 ELSE 21600 END AS step FROM dated GROUP BY user_id)
SELECT user_id, (s - s % step)::BIGINT AS bucket_s, round(sum(weight * score) / sum(weight), 6) AS tone, count(*) AS n, count(*) FILTER (label = 'bullish') AS bullish, count(*) FILTER (label = 'bearish') AS bearish
FROM dated JOIN steps USING (user_id) GROUP BY user_id, s - s % step"""
)
def tone_timeline(spark, sf):
    t = A.timeline(items(spark, sf), "user_id", F.lit(NOW).cast("timestamp"))
    return t.select("user_id", F.unix_seconds("bucket").alias("bucket_s"), r6("tone").alias("tone"), "n", "bullish", "bearish")


@query(f"WITH {ITEMS} SELECT event_type, (s - s % 21600)::BIGINT AS bucket_s, round(sum(weight * score) / sum(weight), 6) AS tone, count(*) AS n FROM items GROUP BY event_type, s - s % 21600")
def tone_timeline_fixed_6h(spark, sf):
    w = F.window("ts", "6 hours")
    t = items(spark, sf).groupBy("event_type", w.alias("w")).agg(A.weighted_mean(F.col("score"), F.col("weight")).alias("tone"), F.count(F.lit(1)).alias("n"))
    return t.select("event_type", F.unix_seconds("w.start").alias("bucket_s"), r6("tone").alias("tone"), "n")


@query(f"WITH {ITEMS} SELECT event_id, round(weight, 6) AS weight FROM items")
def recency_weight(spark, sf):
    return items(spark, sf).select("event_id", r6("weight").alias("weight"))


@query(
    f"""WITH {ITEMS}, c AS (SELECT user_id, event_type, count(*) AS k FROM items GROUP BY 1, 2)
SELECT event_type, round(sum(weight * CASE WHEN k > 4 THEN sqrt(4.0 / k) ELSE 1.0 END * score) / sum(weight * CASE WHEN k > 4 THEN sqrt(4.0 / k) ELSE 1.0 END), 6) AS tone,
       round(sum(weight * CASE WHEN k > 4 THEN sqrt(4.0 / k) ELSE 1.0 END), 4) AS weight FROM items JOIN c USING (user_id, event_type) GROUP BY event_type"""
)
def voice_diversity(spark, sf):
    d = A.diversify(items(spark, sf), ["event_type"], "user_id")
    return d.groupBy("event_type").agg(r6(A.weighted_mean(F.col("score"), F.col("weight"))).alias("tone"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    f"""WITH {ITEMS}, v AS (SELECT event_type, user_id, arg_max(label, (s, event_id)) AS stance, count(*) FILTER (label = 'bullish') AS bull, count(*) FILTER (label = 'bearish') AS bear
  FROM items WHERE label IN ('bullish', 'bearish') GROUP BY 1, 2)
SELECT event_type, sum(bull)::BIGINT AS bull_messages, sum(bear)::BIGINT AS bear_messages, count(*) FILTER (stance = 'bullish') AS bull_authors, count(*) FILTER (stance = 'bearish') AS bear_authors FROM v GROUP BY 1"""
)
def author_stance_latest(spark, sf):
    i = items(spark, sf).withColumn("s", F.unix_seconds("ts"))
    return A.latest_stance(i, ["event_type"], "user_id", "label", "s", "event_id")


@query(
    f"""WITH {ITEMS}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY s DESC, event_id DESC) AS copy FROM items),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS place FROM t WHERE copy = 1)
SELECT user_id, event_id, event_type FROM k WHERE place <= 3"""
)
def cap_per_author(spark, sf):
    newest = [F.desc(F.unix_seconds("ts")), F.desc("event_id")]
    first = F.row_number().over(Window.partitionBy("user_id", "event_type", "props").orderBy(*newest))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*newest))
    return items(spark, sf).withColumn("_c", first).where(F.col("_c") == 1).withColumn("_p", place).where(F.col("_p") <= 3).select("user_id", "event_id", "event_type")


@query(
    f"""WITH {ITEMS}, t AS (SELECT user_id, count(*) FILTER (label = 'bullish') AS b, count(*) FILTER (label <> 'neutral') AS n FROM items GROUP BY 1),
r AS (SELECT user_id, n, b::DOUBLE / n AS share FROM t WHERE n > 0)
SELECT user_id, round(tanh((CASE WHEN share > 0.85 THEN 0.85 - 1.5 * (share - 0.85) WHEN share < 0.35 THEN 0.35 + 0.5 * (0.35 - share) ELSE share END - 0.62) * n / (n + 10.0) / 0.35), 6) AS strength FROM r"""
)
def label_fold_back(spark, sf):
    t = items(spark, sf).groupBy("user_id").agg(F.count_if(F.col("label") == "bullish").alias("b"), F.count_if(F.col("label") != "neutral").alias("n")).where("n > 0")
    return t.select("user_id", r6(S.fold_back(F.col("b") / F.col("n"), F.col("n"))).alias("strength"))


@query(
    f"""WITH {ITEMS}, x AS (SELECT user_id, score, weight, CASE WHEN value > 100 THEN ['big', event_type] ELSE [event_type] END AS themes FROM items),
t AS (SELECT user_id, count(*) AS total FROM x GROUP BY 1),
g AS (SELECT user_id, theme, count(*) AS n, sum(weight * score) / sum(weight) AS tone, sum(weight) AS w FROM (SELECT user_id, score, weight, unnest(themes) AS theme FROM x) GROUP BY 1, 2)
SELECT user_id, theme, n, round(tone, 6) AS tone, round(n::DOUBLE / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, w DESC, theme) AS k FROM g JOIN t USING (user_id) WHERE n >= CASE WHEN total >= 20 THEN 2 ELSE 1 END) WHERE k <= 3"""
)
def theme_stats(spark, sf):
    i = items(spark, sf).withColumn("themes", F.when(F.col("value") > 100, F.array(F.lit("big"), F.col("event_type"))).otherwise(F.array("event_type")))
    return A.theme_stats(i, "user_id", most=3).select("user_id", "theme", "n", r6("tone").alias("tone"), r6("share").alias("share"))


@query(
    f"""WITH {ITEMS}, x AS (SELECT event_type, score, weight, CASE WHEN age BETWEEN 0 AND 48 THEN 'new' WHEN age > 48 AND age <= 168 THEN 'old' END AS side
  FROM (SELECT *, (epoch(TIMESTAMP '{NOW}') - s) / 3600.0 AS age FROM items)),
g AS (SELECT event_type, side, count(*) AS n, sum(weight * score) / sum(weight) AS m, greatest(0.0, sum(weight * score * score) / sum(weight) - pow(sum(weight * score) / sum(weight), 2)) AS v, pow(sum(weight), 2) / sum(weight * weight) AS e FROM x WHERE side IS NOT NULL GROUP BY 1, 2)
SELECT a.event_type, a.n AS n_new, b.n AS n_old, round(a.m - b.m, 6) AS change, round((a.m - b.m) / greatest(sqrt(a.v / greatest(a.e, 1.0) + b.v / greatest(b.e, 1.0)), 0.02), 4) AS z
FROM g a JOIN g b ON a.event_type = b.event_type AND a.side = 'new' AND b.side = 'old' WHERE a.n >= 5 AND b.n >= 5"""
)
def headline_shift(spark, sf):
    h = X.headline_shift(items(spark, sf), "event_type", F.lit(NOW).cast("timestamp"))
    return h.where(F.col("change").isNotNull()).select("event_type", "n_new", "n_old", r6("change").alias("change"), F.round("z", 4).alias("z"))


@query(
    f"""WITH {ITEMS}, b AS (SELECT user_id, min(s) AS lo, max(s) AS hi FROM items GROUP BY 1)
SELECT user_id, bin, round(arg_max(score, (s, event_id)), 6) AS score, count(*) AS n FROM (SELECT *, CASE WHEN hi = lo THEN 0 ELSE least(29, floor((s - lo) * 30.0 / (hi - lo)))::INT END AS bin FROM items JOIN b USING (user_id)) GROUP BY 1, 2"""
)
def spark_downsample(spark, sf):
    return X.downsample(items(spark, sf), "user_id", "ts", "score", "event_id").select("user_id", "bin", r6("score").alias("score"), "n")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_kinds FROM events GROUP BY 1")
def json_extra_extract(spark, sf):
    e = table(spark, sf, "events").withColumn("j", F.from_json("props", "k BIGINT"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("j.k").alias("k_sum"), F.countDistinct("j.k").alias("k_kinds"))


WEIGHTS = {"click": 0.3, "view": 0.25, "purchase": 0.2, "signup": 0.15, "error": 0.1}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"
COMPONENTS = f"""{ITEMS}, p AS (SELECT user_id, event_type, count(*) AS n, (sum(weight * score) / sum(weight) + 1.0) * 50.0 AS score, least(1.0, count(*) / 20.0) AS conf, {_CASE} AS w FROM items GROUP BY 1, 2),
e AS (SELECT *, w * (0.35 + 0.65 * conf) AS eff FROM p),
c AS (SELECT user_id, sum(eff * score) / sum(eff) AS raw, sum(w) AS coverage, sum(eff) AS total FROM e GROUP BY 1),
f AS (SELECT *, 0.35 + 0.65 * least(1.0, coverage / 0.6) AS pull FROM c)"""


def components(spark, sf):
    """(user_id, component, score, confidence, nominal and effective weight): tone of each event type of a user."""
    w = F.lit(None).cast("double")
    for k, v in WEIGHTS.items():
        w = F.when(F.col("event_type") == k, v).otherwise(w)
    p = items(spark, sf).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), S.points(A.weighted_mean(F.col("score"), F.col("weight"))).alias("score")
    )
    return p.withColumns({"conf": F.least(F.lit(1.0), F.col("n") / 20.0), "w": w}).withColumn("eff", F.col("w") * (0.35 + 0.65 * F.col("conf")))


def composed(spark, sf):
    c = components(spark, sf).groupBy("user_id").agg(
        (F.sum(F.col("eff") * F.col("score")) / F.sum("eff")).alias("raw"), F.sum("w").alias("coverage"), F.sum("eff").alias("total")
    )
    return c.withColumn("pull", 0.35 + 0.65 * F.least(F.lit(1.0), F.col("coverage") / 0.6))


BANDS = "CASE WHEN x >= 75 THEN 'very bullish' WHEN x >= 62 THEN 'bullish' WHEN x >= 55 THEN 'leaning bullish' WHEN x >= 46 THEN 'neutral' WHEN x >= 39 THEN 'leaning bearish' WHEN x >= 26 THEN 'bearish' ELSE 'very bearish' END"


@query(f"WITH {COMPONENTS} SELECT user_id, round(x, 6) AS score, round(coverage::DOUBLE, 6) AS coverage, {BANDS} AS band FROM (SELECT *, 50.0 + (raw - 50.0) * pull AS x FROM f)")
def composite_score(spark, sf):
    x = 50.0 + (F.col("raw") - 50.0) * F.col("pull")
    return composed(spark, sf).select("user_id", r6(x).alias("score"), r6("coverage").alias("coverage"), S.band_label(x).alias("band"))


@query(f"WITH {COMPONENTS} SELECT user_id, event_type, round(eff / total * (score - 50.0) * pull, 6) AS contribution FROM e JOIN f USING (user_id)")
def component_contributions(spark, sf):
    j = components(spark, sf).join(composed(spark, sf), "user_id")
    return j.select("user_id", "event_type", r6(F.col("eff") / F.col("total") * (F.col("score") - 50.0) * F.col("pull")).alias("contribution"))


@query(
    f"""WITH {COMPONENTS}, a AS (SELECT user_id, sum(eff / total * (score - 50.0) / 50.0) AS m, sum(w * least(1.0, conf / 0.6)) AS cov, count(*) AS k, sum(n) AS n FROM e JOIN f USING (user_id) GROUP BY 1),
d AS (SELECT user_id, sqrt(sum(eff / total * pow((score - 50.0) / 50.0 - m, 2))) AS sd FROM e JOIN f USING (user_id) JOIN a USING (user_id) GROUP BY 1)
SELECT user_id, round((0.45 * cov + 0.35 * n / (n + 12.0)) * (0.5 + 0.5 * CASE WHEN k >= 2 THEN 1.0 - least(1.0, sd / 0.6) ELSE 0.5 END), 6) AS confidence FROM a JOIN d USING (user_id)"""
)
def composite_confidence(spark, sf):
    j = components(spark, sf).join(composed(spark, sf), "user_id").withColumns({"x": (F.col("score") - 50.0) / 50.0, "q": F.col("eff") / F.col("total")})
    g = j.groupBy("user_id").agg(
        F.sum(F.col("q") * F.col("x")).alias("m"), F.sum(F.col("q") * F.col("x") * F.col("x")).alias("mm"), F.sum(F.col("w") * F.least(F.lit(1.0), F.col("conf") / 0.6)).alias("cov"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")
    )
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("mm") - F.col("m") * F.col("m")))
    agree = F.when(F.col("k") >= 2, 1.0 - F.least(F.lit(1.0), sd / 0.6)).otherwise(0.5)
    return g.select("user_id", r6((0.45 * F.col("cov") + 0.35 * F.col("n") / (F.col("n") + 12.0)) * (0.5 + 0.5 * agree)).alias("confidence"))


@query(
    f"""WITH {ITEMS}, h AS (SELECT user_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half, (sum(weight * score) / sum(weight) + 1.0) * 50.0 AS score FROM items GROUP BY 1, 2, 3),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, b.score - a.score AS move FROM (SELECT * FROM h WHERE half = 0) a FULL OUTER JOIN (SELECT * FROM h WHERE half = 1) b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT user_id, event_type, round(move, 6) AS move FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(move) DESC, event_type) AS k FROM j WHERE move IS NOT NULL) WHERE k <= 2"""
)
def component_movers(spark, sf):
    i = items(spark, sf).withColumn("half", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), 0).otherwise(1))
    side = lambda h, name: i.where(F.col("half") == h).groupBy("user_id", "event_type").agg(S.points(A.weighted_mean(F.col("score"), F.col("weight"))).alias(name))
    j = side(0, "was").join(side(1, "now"), ["user_id", "event_type"], "full").withColumn("move", F.col("now") - F.col("was")).where("move IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.abs("move")), "event_type"))
    return j.withColumn("k", k).where("k <= 2").select("user_id", "event_type", r6("move").alias("move"))


@query(
    f"""WITH {ITEMS}, l AS (SELECT user_id, max(s) AS last_s, arg_max(score, (s, event_id)) AS score FROM items GROUP BY 1),
b AS (SELECT i.user_id, arg_max(i.score, (i.s, i.event_id)) AS base FROM items i JOIN l ON i.user_id = l.user_id AND i.s <= l.last_s - 43200 GROUP BY 1)
SELECT user_id, round(l.score, 6) AS score, round(base, 6) AS baseline, round(l.score - base, 6) AS delta FROM l LEFT JOIN b USING (user_id)"""
)
def snapshot_baseline_12h(spark, sf):
    i = items(spark, sf).withColumn("s", F.unix_seconds("ts"))
    last = i.groupBy("user_id").agg(F.max("s").alias("last_s"), F.max_by("score", F.struct("s", "event_id")).alias("score"))
    base = i.select("user_id", "s", "event_id", F.col("score").alias("x")).join(last.select("user_id", "last_s"), "user_id").where(F.col("s") <= F.col("last_s") - 43200).groupBy("user_id").agg(F.max_by("x", F.struct("s", "event_id")).alias("base"))
    return last.join(base, "user_id", "left").select("user_id", r6("score").alias("score"), r6("base").alias("baseline"), r6(F.col("score") - F.col("base")).alias("delta"))


@query(
    f"""WITH {ITEMS} SELECT event_type, count(*) AS fetched, count(*) FILTER (label <> 'neutral') AS kept, round(count(*) FILTER (label = 'bullish')::DOUBLE / count(*), 6) AS bullish_pct,
       count(*) FILTER (label <> 'neutral')::DOUBLE / count(*) < 0.9 AS degraded FROM items GROUP BY 1"""
)
def run_quality(spark, sf):
    kept = F.count_if(F.col("label") != "neutral")
    n = F.count(F.lit(1))
    return items(spark, sf).groupBy("event_type").agg(n.alias("fetched"), kept.alias("kept"), r6(F.count_if(F.col("label") == "bullish") / n).alias("bullish_pct"), (kept / n < 0.9).alias("degraded"))
