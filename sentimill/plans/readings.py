"""Queries of wordings, reading histories, leans, reversals and insider and analyst views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentimill.functions import wording as W
from sentimill.operators import alignment
from sentimill.plans.common import ITEMS, items, orders_by_asset, r6
from sentimill.sources import table

QUERIES, ORACLES = {}, {}
#: Typical tones of headlines and of posts, the usual bullish share of tagged posts.
NEWS_BASELINE, SOCIAL_BASELINE, TAGGED_NORM = 0.04, 0.05, 0.62
#: What a return to the typical counts for, what a pending deal leaves, and from which multiple sales make purchases a token.
REVERSION_CREDIT, DEAL_DAMPING, TOKEN_RATIO = 0.5, 0.5, 10.0
KNOTS = [(0.2, 0.3), (0.5, 0.55), (0.8, 0.85), (1.0, 0.95)]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """SELECT CASE WHEN round_even(v, 0) >= 55 THEN 'bullish' WHEN round_even(v, 0) <= 45 THEN 'bearish' ELSE 'neutral' END AS stance,
  CASE WHEN v >= 55 THEN 'bull' WHEN v <= 45 THEN 'bear' ELSE 'neutral' END AS polarity,
  CASE WHEN v < 25 THEN 'Extreme Fear' WHEN v < 45 THEN 'Fear' WHEN v <= 55 THEN 'Neutral' WHEN v <= 75 THEN 'Greed' ELSE 'Extreme Greed' END AS band, count(*) AS n
FROM (SELECT least(100.0, value) AS v FROM events) GROUP BY 1, 2, 3"""
)
def score_bands(spark, sf):
    v = F.least(F.lit(100.0), F.col("value"))
    return table(spark, sf, "events").groupBy(W.stance(v).alias("stance"), W.polarity(v).alias("polarity"), W.fear_greed_band(v).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {ITEMS}, v AS (SELECT event_id, score AS x, score * 60.0 AS p, abs(score) AS a FROM items)
SELECT event_id, CASE WHEN round(abs(x), 2) = 0 THEN '' WHEN x > 0 THEN '+' ELSE '−' END || printf('%.2f', round(abs(x), 2)) AS signed,
  CASE WHEN (CASE WHEN abs(p) >= 10 THEN round(abs(p)) ELSE round(abs(p), 1) END) = 0 THEN '' WHEN p > 0 THEN '+' ELSE '−' END
    || CASE WHEN abs(p) >= 10 THEN printf('%.0f', round(abs(p))) ELSE printf('%.1f', round(abs(p), 1)) END || '%' AS pct,
  round(CASE WHEN a <= 0.2 THEN a * 1.5 WHEN a <= 0.5 THEN 0.3 + (a - 0.2) * (0.25 / 0.3) WHEN a <= 0.8 THEN 0.55 + (a - 0.5) * (0.3 / 0.3) WHEN a <= 1.0 THEN 0.85 + (a - 0.8) * (0.1 / 0.2) ELSE 0.95 END, 6) AS calibrated
FROM v"""
)
def signed_numbers(spark, sf):
    x = F.col("score")
    return items(spark, sf).select("event_id", W.signed(x).alias("signed"), W.percent(x * 60.0).alias("pct"), r6(W.calibrated(F.abs(x), KNOTS)).alias("calibrated"))


@query(
    r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 140 THEN regexp_replace(regexp_replace(substring(t, 1, 139), ' [^ ]*$', ''), '[,;:-]+$', '') || '…' ELSE t END) AS digest,
  len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.75 * len(w) AS title_case FROM t JOIN w USING (doc_id)"""
)
def trimmed_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(W.trimmed(F.col("text")).cast("binary")).alias("digest"), W.is_title_case(F.col("text")).alias("title_case"))


@query(
    r"""WITH t AS (SELECT event_id, event_id % 5 = 0 AS am, event_type || CASE WHEN event_id % 3 = 0 THEN ': user ' || user_id ELSE '' END AS r FROM events)
SELECT event_id, split_part(r, ': ', 1) || CASE WHEN am THEN ' (amended)' ELSE '' END AS label, CASE WHEN contains(r, ': ') THEN split_part(r, ': ', 2) END AS description FROM t"""
)
def filing_parts(spark, sf):
    title = F.concat(F.when(F.col("event_id") % 5 == 0, "Amended:  ").otherwise(""), "event_type", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(":  user "), F.col("user_id"))).otherwise(""))
    return table(spark, sf, "events").select("event_id", W.filing_label(title).alias("label"), W.filing_description(title).alias("description"))


CODE = "CASE c_nationkey % 5 WHEN 0 THEN 'GBp' WHEN 1 THEN 'usd' WHEN 2 THEN 'ILA' WHEN 3 THEN 'EUR' ELSE 'n/a' END"


@query(
    f"""WITH c AS (SELECT c_custkey, c_acctbal AS cap, 12.5 + c_custkey % 7 AS price, {CODE} AS code FROM customer)
SELECT c_custkey, CASE code WHEN 'GBp' THEN 'GBP' WHEN 'ILA' THEN 'ILS' ELSE upper(code) END AS major, CASE WHEN regexp_matches(upper(code), '^[A-Z]{{3}}$') THEN upper(code) END AS iso,
  round(CASE WHEN cap > 0 AND code <> 'ILA' THEN cap / CASE WHEN code = 'GBp' THEN price / 100.0 ELSE price END END, 4) AS shares FROM c"""
)
def currency_units(spark, sf):
    k = F.col("c_nationkey") % 5
    code = F.when(k == 0, "GBp").when(k == 1, "usd").when(k == 2, "ILA").when(k == 3, "EUR").otherwise("n/a")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("cap"), (F.col("c_custkey") % 7 + 12.5).alias("price"), code.alias("code"))
    shares = W.shares_outstanding(F.col("cap"), F.col("price"), F.col("code"))
    return c.select("c_custkey", W.major_currency(F.col("code")).alias("major"), W.iso_currency(F.col("code")).alias("iso"), F.round(shares, 4).alias("shares"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stored, strftime(ts::DATE + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS noon, epoch(date_trunc('second', ts))::BIGINT AS compact,
  greatest(coalesce(try_cast(replace(replace(props, '{"k": ', ''), '}', '') AS BIGINT), 0), 0) AS k, concat_ws('|', strftime(ts, '%Y-%m-%d'), event_type, user_id) AS key FROM events"""
)
def times_and_keys(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.regexp_replace(F.regexp_replace("props", r'^\{"k": ', ""), r"\}$", "")
    return e.select(
        "event_id", W.stored_time(F.col("ts")).alias("stored"), F.date_format(W.noon(F.to_date("ts")), "yyyy-MM-dd HH:mm:ss").alias("noon"),
        F.unix_seconds(W.compact_time(F.date_format("ts", "yyyyMMdd'T'HHmmss"))).alias("compact"), W.lenient_count(k).alias("k"),
        F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), "event_type", F.col("user_id").cast("string")).alias("key"),
    )


@query(
    f"""WITH {ITEMS}, l AS (SELECT user_id, max(event_id) AS last FROM items GROUP BY 1), o AS (SELECT i.user_id, arg_min(i.event_id, (i.s, i.event_id)) AS oldest FROM items i JOIN l ON l.user_id = i.user_id
  WHERE i.ts >= TIMESTAMP '2024-01-10' AND i.event_id <> l.last AND i.event_type <> 'error' GROUP BY 1),
b AS (SELECT i.user_id, i.event_id, row_number() OVER (PARTITION BY i.user_id ORDER BY i.s DESC, i.event_id DESC) AS k FROM items i JOIN l ON l.user_id = i.user_id WHERE i.event_id < l.last AND i.ts >= TIMESTAMP '2024-01-10')
SELECT l.user_id, o.oldest, list(b.event_id ORDER BY b.k) FILTER (b.k <= 5)::VARCHAR AS before FROM l LEFT JOIN o ON o.user_id = l.user_id LEFT JOIN b ON b.user_id = l.user_id GROUP BY 1, 2"""
)
def reading_history(spark, sf):
    """The oldest sound reading since a time but for the last, and the five newest before it, of every key."""
    i = items(spark, sf).select("user_id", "event_id", "event_type", "ts", F.unix_seconds("ts").alias("s"))
    last = i.groupBy("user_id").agg(F.max("event_id").alias("last"))
    since = i.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).join(last, "user_id").where(F.col("event_id") < F.col("last"))
    oldest = since.where(F.col("event_type") != "error").groupBy("user_id").agg(F.min_by("event_id", F.struct("s", "event_id")).alias("oldest"))
    newest = since.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), F.desc("event_id")))).where("k <= 5")
    before = newest.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda z: z["event_id"].cast("string")).alias("before"))
    text = F.when(F.col("before").isNotNull(), F.concat(F.lit("["), F.array_join("before", ", "), F.lit("]")))
    return last.join(oldest, "user_id", "left").join(before, "user_id", "left").select("user_id", "oldest", text.alias("before"))


@query(
    """WITH k AS (SELECT event_id, user_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN props END AS props FROM events WHERE ts >= TIMESTAMP '2024-01-08'),
known AS (SELECT DISTINCT user_id FROM k WHERE ts < TIMESTAMP '2024-01-20'), added AS (SELECT user_id, min(ts) AS ts FROM k WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM known) GROUP BY 1)
SELECT (SELECT count(*) FROM k) AS kept, (SELECT count(props) FROM k) AS with_props, (SELECT count(*) FROM known) AS watched, (SELECT count(*) FROM added) AS added"""
)
def retention_and_watch(spark, sf):
    """Rows past the retention go, old ones lose their bulky field; names are added to the watched ones only if they aren't there."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") >= F.lit("2024-01-08").cast("timestamp"))
    new = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    kept = e.select("user_id", new.alias("new"), F.when(new, F.col("props")).alias("props"))
    by_user = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count("props").alias("props"), F.min("new").alias("only_new"))
    return by_user.agg(F.sum("rows").alias("kept"), F.sum("props").alias("with_props"), F.count_if(~F.col("only_new")).alias("watched"), F.count_if("only_new").alias("added"))


@query(
    f"""WITH {ITEMS}, c AS (SELECT user_id, ts::DATE AS d, count(*) AS n FROM items GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY n DESC, user_id) AS rk FROM c),
p AS (SELECT a.user_id, a.d, a.n, a.rk, b.n AS pn, b.rk AS prk FROM r a LEFT JOIN r b ON b.user_id = a.user_id AND b.d = a.d - 1)
SELECT user_id, d, CASE WHEN pn >= 3 THEN round((n - pn) * 100.0 / pn, 1) END AS change_pct, rk <= 25 AND (prk IS NULL OR prk >= 100) AND n >= 10 AS breakout FROM p"""
)
def mention_moves(spark, sf):
    """Growth of mentions against the day before (a base of three at least), and jumps into the first 25 from outside the first hundred."""
    c = items(spark, sf).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # whether a rank is among the first 99 is all that is asked, so no day is ranked whole: tasks keep 99 rows a day before they meet
    top = c.withColumn("rk", F.rank().over(Window.partitionBy("d").orderBy(F.desc("n"), "user_id"))).where("rk < 100").select("user_id", "d", "rk")
    before = c.select("user_id", F.date_add("d", 1).alias("d"), F.col("n").alias("pn"))
    ranked_before = top.select("user_id", F.date_add("d", 1).alias("d"), F.col("rk").alias("prk"))
    p = c.join(before, ["user_id", "d"], "left").join(top, ["user_id", "d"], "left").join(ranked_before, ["user_id", "d"], "left")
    jump = F.coalesce(F.col("rk") <= 25, F.lit(False)) & F.col("prk").isNull() & (F.col("n") >= 10)
    return p.select("user_id", "d", F.when(F.col("pn") >= 3, F.round((F.col("n") - F.col("pn")) * 100.0 / F.col("pn"), 1)).alias("change_pct"), jump.alias("breakout"))


@query(
    f"""WITH {ITEMS}, m AS (SELECT user_id, avg(score) FILTER (s >= epoch(TIMESTAMP '2024-01-24')) AS t7, avg(score) FILTER (s < epoch(TIMESTAMP '2024-01-24')) AS t30, count(*) AS n, avg(score) AS mean,
  count(*) FILTER (label = 'bullish') AS b, count(*) FILTER (label <> 'neutral') AS k FROM items GROUP BY 1), g AS (SELECT *, t30 - {NEWS_BASELINE} AS gap, t7 - t30 AS d FROM m),
v AS (SELECT *, CASE WHEN gap * d >= 0 THEN d ELSE sign(d) * ({REVERSION_CREDIT} * least(abs(d), abs(gap)) + abs(d) - least(abs(d), abs(gap))) END AS rev,
  CASE WHEN k >= 10 AND abs((b * 1.0 / k - {TAGGED_NORM}) / sqrt({TAGGED_NORM} * (1 - {TAGGED_NORM}) / k)) >= 1.64 THEN CASE WHEN b * 1.0 / k > {TAGGED_NORM} THEN 1 ELSE -1 END ELSE 0 END AS v1,
  CASE WHEN n >= 15 AND abs(mean - {SOCIAL_BASELINE}) >= 0.10 THEN CASE WHEN mean > {SOCIAL_BASELINE} THEN 1 ELSE -1 END ELSE 0 END AS v2 FROM g)
SELECT user_id, round(rev, 6) AS change, coalesce(sign(t7) <> sign(t30) AND abs(t7 - t30) >= 0.5, false) AS flipped, CASE WHEN n < 6 THEN 0 WHEN mean - {NEWS_BASELINE} >= 0.08 THEN 1 WHEN mean - {NEWS_BASELINE} <= -0.08 THEN -1 ELSE 0 END AS news_lean,
  CASE WHEN v1 * v2 < 0 THEN 0 ELSE sign(v1 + v2)::INT END AS crowd_lean, coalesce(abs(t7 - t30) * 50.0 >= 12, false) AS swing FROM v"""
)
def leans_and_reversals(spark, sf):
    """Leans of news and crowd off their usual levels, flips and swings of tone, and the change that counts a return to the usual by half."""
    i = items(spark, sf)
    new = F.col("ts") >= F.lit("2024-01-24").cast("timestamp")
    m = i.groupBy("user_id").agg(
        F.avg(F.when(new, F.col("score"))).alias("t7"), F.avg(F.when(~new, F.col("score"))).alias("t30"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
        F.count_if(F.col("label") == "bullish").alias("b"), F.count_if(F.col("label") != "neutral").alias("k"),
    )
    d, gap = F.col("t7") - F.col("t30"), F.col("t30") - NEWS_BASELINE
    back = F.least(F.abs(d), F.abs(gap))
    change = F.when(gap * d >= 0, d).otherwise(F.signum(d) * (REVERSION_CREDIT * back + F.abs(d) - back))
    ratio = F.col("b") / F.when(F.col("k") > 0, F.col("k"))
    z = (ratio - TAGGED_NORM) / F.sqrt(TAGGED_NORM * (1 - TAGGED_NORM) / F.when(F.col("k") > 0, F.col("k")))
    side = lambda c: F.when(c, 1).otherwise(-1)
    tags = F.when((F.col("k") >= 10) & (F.abs(z) >= 1.64), side(ratio > TAGGED_NORM)).otherwise(0)
    posts = F.when((F.col("n") >= 15) & (F.abs(F.col("mean") - SOCIAL_BASELINE) >= 0.10), side(F.col("mean") > SOCIAL_BASELINE)).otherwise(0)
    off = F.col("mean") - NEWS_BASELINE
    return m.select(
        "user_id", r6(change).alias("change"), F.coalesce((F.signum("t7") != F.signum("t30")) & (F.abs(d) >= 0.5), F.lit(False)).alias("flipped"),
        F.when(F.col("n") < 6, 0).when(off >= 0.08, 1).when(off <= -0.08, -1).otherwise(0).alias("news_lean"),
        F.when(tags * posts < 0, 0).otherwise(F.signum((tags + posts).cast("double")).cast("int")).alias("crowd_lean"),
        F.coalesce(F.abs(d) * 50.0 >= 12, F.lit(False)).alias("swing"),
    )


@query(
    f"""WITH o AS (SELECT 'a' || (o_custkey % 7)::VARCHAR AS asset, * FROM orders), t AS (SELECT asset, count(*) FILTER (o_orderstatus = 'F') AS buys, count(*) FILTER (o_orderstatus = 'O') AS sells,
  coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS bv, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS sv, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O' AND o_orderpriority LIKE '1%'), 0) AS planned FROM o GROUP BY 1)
SELECT asset, buys, sells, round(bv - sv, 2) AS net_value, round((bv - sv) / (bv + sv), 3) AS ratio, round(sv - planned, 2) AS free_sales,
  round(CASE WHEN sv - planned <= {TOKEN_RATIO} * bv OR sv <= planned THEN 1.0 ELSE {TOKEN_RATIO} * bv / (sv - planned) END, 6) AS token_factor FROM t"""
)
def insider_view(spark, sf):
    """Purchases and sales by value, what of the sales was not planned, and how far sales make purchases a token."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    total = lambda c: F.coalesce(F.sum(F.when(c, price)), F.lit(0.0))
    t = orders_by_asset(spark, sf).groupBy("asset").agg(
        F.count_if(status == "F").alias("buys"), F.count_if(status == "O").alias("sells"), total(status == "F").alias("bv"), total(status == "O").alias("sv"),
        total((status == "O") & F.col("o_orderpriority").startswith("1")).alias("planned"),
    )
    free, bought = F.col("sv") - F.col("planned"), F.col("bv")
    token = F.when((free <= TOKEN_RATIO * bought) | (free <= 0), 1.0).otherwise(TOKEN_RATIO * bought / free)
    gross = bought + F.col("sv")
    return t.select(
        "asset", "buys", "sells", F.round(bought - F.col("sv"), 2).alias("net_value"), F.round((bought - F.col("sv")) / F.when(gross > 0, gross), 3).alias("ratio"),
        F.round(free, 2).alias("free_sales"), r6(token).alias("token_factor"),
    )


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, 'firm ' || (o_custkey % 11) AS firm, o_orderstatus AS action, (o_custkey % 4)::INT AS target, o_totalprice FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY d, firm, action, target ORDER BY o_orderkey) AS k FROM o), p AS (SELECT o_orderkey, firm, d, action, target, lag(target) OVER (PARTITION BY firm ORDER BY d, o_orderkey) AS prior FROM k WHERE k = 1)
SELECT o_orderkey, firm, CASE WHEN action = 'P' THEN 1 WHEN target > 0 AND prior > 0 AND target > prior THEN 1 WHEN target > 0 AND prior > 0 AND target < prior THEN -1 ELSE 0 END AS direction FROM p"""
)
def analyst_actions(spark, sf):
    """Calls once a day, firm, action and target (the first counts), and which way each moves the firm's target."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("d"), F.concat(F.lit("firm "), (F.col("o_custkey") % 11).cast("string")).alias("firm"), F.col("o_orderstatus").alias("action"), (F.col("o_custkey") % 4).cast("double").alias("target")
    )
    once = o.groupBy("d", "firm", "action", "target").agg(F.min("o_orderkey").alias("o_orderkey"))
    word = F.when(F.col("action") == "P", "Raises").otherwise("")
    once = alignment.lag_in_blocks(once.withColumn("month", F.trunc("d", "month")), "firm", "month", ["d", "o_orderkey"], "target", "prior")
    return once.select("o_orderkey", "firm", W.target_direction(word, F.col("target"), F.col("prior")).alias("direction"))


@query(
    """WITH e AS (SELECT CASE quality WHEN 1 THEN 'bullish' ELSE 'bearish' END AS g, CASE WHEN doc_id % 5 = 0 THEN 'neutral' WHEN (doc_id % 7 < 5) = (quality = 1) THEN 'bullish' ELSE 'bearish' END AS p FROM labels WHERE quality IS NOT NULL)
SELECT count(*) AS n, round(count(*) FILTER (p <> 'neutral') * 1.0 / count(*), 4) AS coverage, round(count(*) FILTER (p = g) * 1.0 / count(*) FILTER (p <> 'neutral'), 4) AS accuracy,
  round((count(*) FILTER (p = g AND g = 'bullish') * 1.0 / count(*) FILTER (p <> 'neutral' AND g = 'bullish') + count(*) FILTER (p = g AND g = 'bearish') * 1.0 / count(*) FILTER (p <> 'neutral' AND g = 'bearish')) / 2, 4) AS balanced,
  round(count(*) FILTER (p NOT IN (g, 'neutral')) * 1.0 / count(*), 4) AS flipped FROM e"""
)
def directional_metrics(spark, sf):
    """How often a judge commits itself, how right it is then, by side too, and how often it turns the sign round."""
    y = table(spark, sf, "labels").where("quality IS NOT NULL")
    e = y.select(F.when(F.col("quality") == 1, "bullish").otherwise("bearish").alias("g"), F.when(F.col("doc_id") % 5 == 0, "neutral").when((F.col("doc_id") % 7 < 5) == (F.col("quality") == 1), "bullish").otherwise("bearish").alias("p"))
    n, said, hit = F.count(F.lit(1)), F.col("p") != "neutral", F.col("p") == F.col("g")
    share = lambda a, b: a / F.when(b > 0, b)
    recall = lambda s: share(F.count_if(hit & (F.col("g") == s)), F.count_if(said & (F.col("g") == s)))
    return e.agg(
        n.alias("n"), F.round(share(F.count_if(said), n), 4).alias("coverage"), F.round(share(F.count_if(hit), F.count_if(said)), 4).alias("accuracy"),
        F.round((recall("bullish") + recall("bearish")) / 2, 4).alias("balanced"), F.round(share(F.count_if(said & ~hit), n), 4).alias("flipped"),
    )


@query(
    f"""WITH {ITEMS}, p AS (SELECT user_id, 50 + 50 * sum(weight * score) / sum(weight) AS score, least(1.0, count(*) / 50.0) AS c, count(*) FILTER (event_type = 'purchase') > 0 AS pending,
  (max(s) - min(s)) / 3600.0 AS span, count(*) FILTER (ts IS NULL OR ts >= TIMESTAMP '2024-01-17') AS recent FROM items GROUP BY 1)
SELECT user_id, round(CASE WHEN pending THEN 50 + (score - 50) * {DEAL_DAMPING} ELSE score END, 6) AS score, round(CASE WHEN pending THEN c * {DEAL_DAMPING} ELSE c END, 6) AS confidence, round(span, 4) AS span_hours, recent FROM p"""
)
def deal_anchored(spark, sf):
    """A part's score and confidence, halved in strength while a deal is pending; the hours it spans and its items of two weeks (undated ones count)."""
    i = items(spark, sf).withColumn("s", F.unix_seconds("ts"))
    p = i.groupBy("user_id").agg(
        (50 + 50 * F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"), F.least(F.lit(1.0), F.count(F.lit(1)) / 50.0).alias("c"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("pending"),
        ((F.max("s") - F.min("s")) / 3600.0).alias("span"), F.count_if(F.col("ts").isNull() | (F.col("ts") >= F.lit("2024-01-17").cast("timestamp"))).alias("recent"),
    )
    kept = F.when(F.col("pending"), DEAL_DAMPING).otherwise(1.0)
    return p.select("user_id", r6(50 + (F.col("score") - 50) * kept).alias("score"), r6(F.col("c") * kept).alias("confidence"), F.round("span", 4).alias("span_hours"), "recent")
