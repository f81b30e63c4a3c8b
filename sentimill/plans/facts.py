"""Queries over event facts, with orders, line items, parts, customers and events standing for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentimill.functions import scalars as S
from sentimill.operators import facts as X
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


@query(
    f"""WITH {CLOSES}, {TONES}, v AS (SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, o_orderdate::DATE AS d, count(*)::DOUBLE AS views FROM orders GROUP BY 1, 2)
SELECT asset, d, round(close, 4) AS close, round(tone, 6) AS tone, views FROM closes FULL JOIN tones USING (asset, d) FULL JOIN v USING (asset, d)"""
)
def history_full_outer(spark, sf):
    v = orders_by_asset(spark, sf).groupBy("asset", "d").agg(F.count(F.lit(1)).alias("value"))
    h = X.history({"close": closes(spark, sf).withColumnRenamed("close", "value"), "tone": tones(spark, sf).withColumnRenamed("tone", "value"), "views": v}, "asset")
    return h.select("asset", "d", F.round("close", 4).alias("close"), r6("tone").alias("tone"), "views")


@query(
    """SELECT user_id, event_type AS metric, arg_min(value, event_id) FILTER (value > 20) AS value, min(event_id) FILTER (value > 20) AS source_order FROM events GROUP BY 1, 2 HAVING count(*) FILTER (value > 20) > 0"""
)
def first_known_metric(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("metric"), F.when(F.col("value") > 20, F.col("value")).alias("value"), F.col("event_id").alias("source_order"))
    return X.first_known(e, ["user_id", "metric"], "value", "source_order")


@query(
    "SELECT user_id, "
    + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 6) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY 1"
)
def metric_pivot(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(r6(F.max("value")))


@query("SELECT l_suppkey, l_quantity AS quantity, n FROM (SELECT l_suppkey, l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity DESC) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def most_quoted_amount(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("quantity", F.col("l_quantity"))  # noqa: E741
    return X.most_quoted(l, "l_suppkey", "quantity")


@query("SELECT l_partkey, round(sum(l_extendedprice) / sum(l_quantity), 6) AS vwap, round(sum(l_quantity), 2) AS shares FROM lineitem GROUP BY 1")
def average_price_paid(spark, sf):
    q = F.sum("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(r6(F.sum("l_extendedprice") / F.when(q > 0, q)).alias("vwap"), F.round(q, 2).alias("shares"))


@query(
    """WITH g AS (SELECT l_shipdate, l_quantity FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 3)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN g USING (l_shipdate, l_quantity)"""
)
def scheme_purchases(spark, sf):
    return X.same_day_plans(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity").select("l_orderkey", "l_linenumber")


@query(
    """WITH b AS (SELECT ts::DATE AS d, user_id, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT d, sum(n)::BIGINT AS board_total FROM b GROUP BY 1)
SELECT d, user_id, n, CASE WHEN board_total >= 300 AND n >= 4 THEN k END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, user_id) AS k FROM b) JOIN t USING (d)"""
)
def board_rank(spark, sf):
    b = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return X.board_ranks(b, "d", "user_id", "n", 300, 4).select("d", "user_id", "n", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH b AS (SELECT ts::DATE AS d, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT a.d, count(*) AS common, round(avg((a.n = b.n)::INT), 6) AS same, avg((a.n = b.n)::INT) < 0.5 AND count(*) >= 5 AS live FROM b a JOIN b ON a.user_id = b.user_id AND b.d = a.d - 14 GROUP BY 1"""
)
def scores_are_live(spark, sf):
    b = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    past = b.select(F.date_add("d", 14).alias("d"), "user_id", F.col("n").alias("m"))
    same = F.avg((F.col("n") == F.col("m")).cast("int"))
    return b.join(past, ["d", "user_id"]).groupBy("d").agg(F.count(F.lit(1)).alias("common"), r6(same).alias("same"), ((same < 0.5) & (F.count(F.lit(1)) >= 5)).alias("live"))


@query(
    """WITH k AS (SELECT o_custkey, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS est, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, count(est) AS scored, round(avg((o_totalprice > est)::INT), 6) AS beat_rate FROM k WHERE k <= 8 AND est IS NOT NULL GROUP BY 1 HAVING count(est) >= 2"""
)
def beat_rate(spark, sf):
    w = Window.partitionBy("o_custkey")
    before = w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-4, -1)
    k = table(spark, sf, "orders").withColumns({"est": F.avg("o_totalprice").over(before), "k": F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))})
    g = k.where("k <= 8 AND est IS NOT NULL").groupBy("o_custkey").agg(F.count("est").alias("scored"), r6(F.avg((F.col("o_totalprice") > F.col("est")).cast("int"))).alias("beat_rate"))
    return g.where("scored >= 2")


@query(
    """WITH r AS (SELECT o_custkey, avg(substring(o_orderpriority, 1, 1)::INT) AS rating, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3)
SELECT o_custkey, round(rating, 6) AS rating, CASE WHEN rating < 1.5 THEN 'strong buy' WHEN rating < 2.5 THEN 'buy' WHEN rating < 3.5 THEN 'hold' WHEN rating < 4.5 THEN 'sell' ELSE 'strong sell' END AS consensus FROM r"""
)
def rating_consensus(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg(F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    r = F.col("rating")
    name = F.when(r < 1.5, "strong buy").when(r < 2.5, "buy").when(r < 3.5, "hold").when(r < 4.5, "sell").otherwise("strong sell")
    return g.select("o_custkey", r6(r).alias("rating"), name.alias("consensus"))


@query(
    """WITH m AS (SELECT p_brand, avg(p_retailprice) AS mean, median(p_retailprice) AS mid, max(p_retailprice) AS top FROM part GROUP BY 1)
SELECT p_brand, round(mean, 6) AS mean_target, round(mid, 6) AS median_target, round(CASE WHEN mean > 1.2 * mid OR mid > 1.2 * mean THEN mid ELSE mean END / top - 1.0, 6) AS upside FROM m"""
)
def target_upside(spark, sf):
    m = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.median("p_retailprice").alias("mid"), F.max("p_retailprice").alias("top"))
    skewed = (F.col("mean") > 1.2 * F.col("mid")) | (F.col("mid") > 1.2 * F.col("mean"))
    return m.select("p_brand", r6("mean").alias("mean_target"), r6("mid").alias("median_target"), r6(F.when(skewed, F.col("mid")).otherwise(F.col("mean")) / F.col("top") - 1.0).alias("upside"))


@query(
    """WITH i AS (SELECT user_id, event_type || ' ' || (value > 100)::VARCHAR AS title, max((CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END, value)) AS z FROM events GROUP BY 1, 2)
SELECT user_id, title, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z[1] DESC, z[2] DESC, title) AS place FROM (SELECT user_id, title, [z[1]::DOUBLE, z[2]::DOUBLE] AS z FROM i)) WHERE place <= 4"""
)
def top_insights(spark, sf):
    e = table(spark, sf, "events")
    sev = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    i = e.select("user_id", F.concat_ws(" ", "event_type", (F.col("value") > 100).cast("string")).alias("title"), sev.alias("severity"), F.col("value").alias("priority"))
    return X.top_insights(i, "user_id", "title", "severity", "priority", 4).select("user_id", "title", F.col("place").cast("long").alias("place"))


@query(
    """SELECT p_partkey, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') THEN 1 WHEN contains(' ' || lower(p_name), ' ring') THEN 2 END AS match_rank FROM part
WHERE lower(p_name) = 'ring' OR starts_with(lower(p_name), 'ring') OR contains(' ' || lower(p_name), ' ring')"""
)
def symbol_search(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.search_rank(F.col("p_name"), "ring").alias("match_rank")).where("match_rank IS NOT NULL")


@query(
    f"""WITH {ITEMS}, h AS (SELECT user_id, (sum(weight * score) FILTER (event_type = 'view') / sum(weight) FILTER (event_type = 'view') + 1.0) * 50.0 AS a, (sum(weight * score) FILTER (event_type = 'click') / sum(weight) FILTER (event_type = 'click') + 1.0) * 50.0 AS b,
  CASE WHEN count(*) FILTER (event_type = 'error') >= 12 THEN 80.0 END AS c FROM items GROUP BY 1)
SELECT user_id, round(50.0 + (coalesce((a - 50.0) * 0.4, 0.0) + coalesce((b - 50.0) * 0.25, 0.0) + coalesce((c - 50.0) * 0.35, 0.0)) / greatest(0.6, CASE WHEN a IS NULL THEN 0.0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0.0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0.0 ELSE 0.35 END), 5) AS heat FROM h"""
)
def crowd_heat(spark, sf):
    tone = lambda t: S.points(F.sum(F.when(F.col("event_type") == t, F.col("weight") * F.col("score"))) / F.sum(F.when(F.col("event_type") == t, F.col("weight"))))
    h = items(spark, sf).groupBy("user_id").agg(tone("view").alias("a"), tone("click").alias("b"), F.when(F.count_if(F.col("event_type") == "error") >= 12, 80.0).alias("c"))
    return h.select("user_id", F.round(S.blend([(F.col("a"), 0.4), (F.col("b"), 0.25), (F.col("c"), 0.35)]), 5).alias("heat"))


@query(
    """WITH c AS (SELECT c_custkey, (c_custkey % 14)::INT - 1 AS failures FROM customer) SELECT c_custkey, CASE WHEN failures <= 0 THEN 0 ELSE least(86400.0, 900 * pow(2.0, failures - 1)) END::BIGINT AS wait_s FROM c"""
)
def refresh_backoff(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.backoff((F.col("c_custkey") % 14).cast("int") - 1, 900).alias("wait_s"))


@query(
    """WITH w AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000), l AS (SELECT o_custkey AS k, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT w.k, l.last::DATE AS last FROM w LEFT JOIN l USING (k) WHERE l.last IS NULL OR l.last < TIMESTAMP '2001-01-01'"""
)
def stale_watchlist(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    w = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).union(o.where("o_totalprice > 400000").select("o_custkey")).distinct()
    last = o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("last"))
    return w.join(last, "k", "left").where(F.col("last").isNull() | (F.col("last") < F.lit("2001-01-01").cast("timestamp_ntz"))).select("k", F.to_date("last").alias("last"))


@query("SELECT n_name, sum(c_acctbal) < 0 AS net_negative, round(sum(c_acctbal), 2) AS total, printf('%.2f', round(abs(sum(c_acctbal)) / 1e6, 2)) AS millions FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def nation_balances(spark, sf):
    total = F.sum("c_acctbal")
    j = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg((total < 0).alias("net_negative"), F.round(total, 2).alias("total"), F.format_string("%.2f", F.round(F.abs(total) / 1e6, 2)).alias("millions"))
