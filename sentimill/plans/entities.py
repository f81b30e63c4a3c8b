"""Names, mentions, relevance and firms in titles, over the headlines that orders make; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentimill.functions.parsing import FANCY, PLAIN
from sentimill.operators import alignment
from sentimill.operators import entities as E
from sentimill.plans.common import r6
from sentimill.plans.headlines import _COMPANY, HEADLINES, headlines, q
from sentimill.sources import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Registered names of the headlines' companies, some in capitals, and their tickers, in words that Spark and DuckDB read alike.
_FORM = "split_part(' Inc.; Corp; PLC; Holdings Ltd.;, Inc. Class A Common Stock; S.A. / New; Group', ';', CAST(1 + k % 7 AS INT))"
_NAME = f"concat(CASE WHEN k % 3 = 0 THEN upper(company) WHEN k % 3 = 1 THEN concat('The ', company) ELSE company END, {_FORM})"
_TICKER = "concat(upper(substr(company, 1, 2)), upper(substr(company, length(company) - 2, 2)))"


def companies(spark, sf):
    """(k, name, short, ticker) of every company that orders name."""
    c = table(spark, sf, "orders").selectExpr("o_custkey % 60 AS k", f"{_COMPANY} AS company").distinct()
    return c.selectExpr("k", f"{_NAME} AS name", "CASE WHEN k % 4 = 0 THEN company END AS short", f"{_TICKER} AS ticker")


COMPANIES = f"companies AS (SELECT k, {_NAME} AS name, CASE WHEN k % 4 = 0 THEN company END AS short, {_TICKER} AS ticker FROM (SELECT DISTINCT o_custkey % 60 AS k, {_COMPANY} AS company FROM orders))"


def plain(x: str) -> str:
    return f"replace(translate({x}, {q(FANCY)}, {q(PLAIN)}), '…', '...')"


def words_sql(x: str, sign: str = "") -> str:
    return rf"list_filter(list_transform(regexp_extract_all(lower({plain(f'coalesce({x}, {chr(39) * 2})')}), '{sign}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}.&''-]*'), lambda w: trim(regexp_replace(w, '''s$', ''), '.''-')), lambda w: w <> '')"


def brand_sql(x: str) -> str:
    core = rf"regexp_replace(trim(regexp_replace({plain(x)}, '\s*[/,(].*$', '')), '(?i)^the\s+', '')"
    bare = rf"regexp_replace({core}, '(?i)(?:[\s.&]+(?:{'|'.join(E.LEGAL)})\.?)+$', '')"
    return f"trim(CASE WHEN trim({bare}) = '' THEN {core} ELSE {bare} END)"


def fixed_sql(x: str) -> str:
    return rf"CASE WHEN upper({x}) = {x} AND length({x}) > 4 THEN array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) <= 3 AND NOT regexp_matches(w, '[AEIOUY]') THEN w ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') ELSE {x} END"


_STRENGTH = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in E.RELEVANCE.items())
ALIASES = f"""strength(kind, v) AS (VALUES {_STRENGTH}),
nm AS (SELECT k, name AS n FROM companies UNION ALL SELECT k, short FROM companies WHERE short IS NOT NULL),
br AS (SELECT k, {words_sql(brand_sql("n"))} AS w FROM nm),
raw AS (SELECT k, {words_sql("n")} AS w, 'name' AS kind FROM nm UNION ALL SELECT k, w, 'brand' FROM br
  UNION ALL SELECT k, [w[1]], 'alias' FROM br WHERE length(w[1]) >= 5 AND NOT list_contains({E.PLAIN_WORDS!r}, w[1])
  UNION ALL SELECT k, [lower(ticker)], 'ticker' FROM companies UNION ALL SELECT k, ['$' || lower(ticker)], 'cashtag' FROM companies),
one AS (SELECT k, array_to_string(w, ' ') AS alias, len(w) AS words, arg_min(raw.kind, (-v, raw.kind)) AS kind FROM raw JOIN strength USING (kind) WHERE len(w) > 0 GROUP BY 1, 2, 3),
al AS (SELECT *, count(*) OVER (PARTITION BY alias) AS companies_of FROM one)"""
MENTIONS = f"""w AS (SELECT item, {words_sql("title", "[$]?")} AS w FROM heads),
rn AS (SELECT item, n, i - 1 AS place, array_to_string(w[i:i + n - 1], ' ') AS alias FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 7) AS s(n) WHERE len(w) >= n)),
hit AS (SELECT item, n, place, alias FROM rn WHERE alias IN (SELECT alias FROM al)),
best AS (SELECT h.* FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.item = h.item AND o.place <= h.place AND o.place + o.n > h.place AND (o.n > h.n OR (o.n = h.n AND o.place < h.place)))),
found AS (SELECT item, k, best.alias, kind, place, companies_of FROM best JOIN al ON al.alias = best.alias)"""


@query(f"WITH {COMPANIES} SELECT k, {brand_sql('name')} AS brand, {fixed_sql(brand_sql('name'))} AS fixed FROM companies")
def company_names(spark, sf):
    c = companies(spark, sf)
    return c.select("k", E.brand(F.col("name")).alias("brand"), E.fixed_case(E.brand(F.col("name"))).alias("fixed"))


@query(f"WITH {COMPANIES}, {ALIASES} SELECT k, alias, kind, companies_of FROM al")
def company_aliases(spark, sf):
    return E.aliases(companies(spark, sf), "k", ["name", "short"], "ticker").select("k", "alias", "kind", "companies_of")


def _found(spark, sf):
    names = E.aliases(companies(spark, sf), "k", ["name", "short"], "ticker")
    return E.mentions(headlines(spark, sf), "item", "title", names, "k")


@query(f"WITH {HEADLINES}, {COMPANIES}, {ALIASES}, {MENTIONS} SELECT item, k, alias, kind, place FROM found")
def company_mentions(spark, sf):
    return _found(spark, sf).select("item", "k", "alias", "kind", "place")


@query(
    f"""WITH {HEADLINES}, {COMPANIES}, {ALIASES}, {MENTIONS}, own AS (SELECT item, k, bool_or(companies_of = 1) AS own FROM found GROUP BY 1, 2),
s AS (SELECT item, k, max((v, kind)) AS b FROM (SELECT f.item, f.k, CASE WHEN companies_of > 1 AND NOT own THEN 'word' ELSE kind END AS kind FROM found f JOIN own USING (item, k)) JOIN strength USING (kind) GROUP BY 1, 2)
SELECT item, k, CASE WHEN len(list_distinct(regexp_extract_all(title, '\\$[A-Z]{{1,5}}'))) >= 4 OR regexp_matches(lower(title), '^(?:top )?\\d+ (?:best |top )?(?:stocks|shares|picks)\\b|stocks to (?:buy|watch|avoid)') THEN least(b[1], {E.ROUNDUP_MOST}) ELSE b[1] END AS relevance, b[2] AS evidence
FROM s JOIN heads USING (item)"""
)
def company_relevance(spark, sf):
    h = headlines(spark, sf)
    return E.relevance(_found(spark, sf), h, "item", "title", "k").select("item", "k", r6("relevance").alias("relevance"), "evidence")


#: The ratings feed: firms with their trade names' noise, an action in ten a change of rating, targets moved by a little or by much.
_FIRM = "split_part('Harbor Street,Northfield Research Group,Pine Ridge Capital Markets,Quayside Securities LLC,Stonebridge & Co,Windmere Partners', ',', CAST(1 + o_custkey % 6 AS INT))"
_ACTION = "CASE WHEN o_orderkey % 10 = 0 THEN 'up' ELSE 'main' END"
_FEED = f"{_FIRM} AS firm, o_orderdate AS day, {_ACTION} AS action, CASE WHEN o_orderkey % 5 > 0 THEN 100.0 + o_orderkey % 6 END AS target, 100.0 + o_custkey % 3 AS prior"


@query(
    f"""WITH {HEADLINES}, feed AS (SELECT {_FEED} FROM orders),
core AS (SELECT *, array_to_string(list_filter({words_sql("firm")}, lambda w: NOT list_contains({E.FIRM_NOISE!r}, w)), ' ') AS core, CASE WHEN target > 0 AND prior > 0 THEN abs(target / prior - 1) END AS moved FROM feed),
t AS (SELECT item, heads.at::DATE AS seen, ' ' || array_to_string({words_sql("title", "[$]?")}, ' ') || ' ' AS t FROM heads),
f AS (SELECT item, seen, core FROM t JOIN (SELECT DISTINCT core FROM core) ON contains(t, ' ' || core || ' ')),
m AS (SELECT item, count(*) AS actions, count(*) FILTER (action IN ('up', 'down', 'init')) AS changes, count(moved) AS moves, count(*) FILTER (moved >= 0.03) AS large
  FROM f JOIN core ON core.core = f.core AND abs(date_diff('day', core.day::DATE, f.seen)) <= 4 GROUP BY 1)
SELECT item, coalesce(actions, 0) AS actions, coalesce(changes = 0 AND large = 0 AND moves > 0, false) AS routine FROM heads LEFT JOIN m USING (item)"""
)
def routine_revisions(spark, sf):
    feed = table(spark, sf, "orders").selectExpr(f"{_FIRM} AS firm", "o_orderdate AS day", f"{_ACTION} AS action", "CASE WHEN o_orderkey % 5 > 0 THEN 100.0D + o_orderkey % 6 END AS target", "100.0D + o_custkey % 3 AS prior")
    return E.routine_revisions(headlines(spark, sf), "item", "title", "at", feed, "firm", "day", "action", "target", "prior")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT event_type || '-' || (ts::DATE)::VARCHAR AS story, user_id % 97 AS m, ts >= TIMESTAMP '2024-01-16' AS new FROM events),
n AS (SELECT story, count(*) AS k FROM e GROUP BY 1),
j AS (SELECT a.story, b.story AS old, count(*)::DOUBLE / least(any_value(na.k), any_value(nb.k)) AS share FROM e a JOIN e b ON a.m = b.m AND a.new AND NOT b.new JOIN n na ON na.story = a.story JOIN n nb ON nb.story = b.story GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (ORDER BY share DESC, story, old) AS i FROM j WHERE share >= 1.0 / 3),
r AS (SELECT i, story, old, share, true AS taken, [story] AS ua, [old] AS ub FROM p WHERE i = 1
  UNION ALL SELECT p.i, p.story, p.old, p.share, NOT (list_contains(ua, p.story) OR list_contains(ub, p.old)),
    CASE WHEN list_contains(ua, p.story) OR list_contains(ub, p.old) THEN ua ELSE list_append(ua, p.story) END, CASE WHEN list_contains(ua, p.story) OR list_contains(ub, p.old) THEN ub ELSE list_append(ub, p.old) END
  FROM r JOIN p ON p.i = r.i + 1)
SELECT story, old, 'members' AS by, round(share, 6) AS share FROM r WHERE taken"""
)
def story_identity(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("-", "event_type", F.to_date("ts").cast("string")).alias("story"), (F.col("user_id") % 97).alias("m"), (F.col("ts").cast("timestamp") >= F.lit("2024-01-16").cast("timestamp")).alias("new"))
    return alignment.story_identity(e.where("new"), e.where("NOT new"), "story", "m").select("story", "old", "by", r6("share").alias("share"))
