"""Text, duplicate, story and evaluation queries over pages, documents, conversations, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentimill.functions import lexicon as L
from sentimill.functions import scalars as S
from sentimill.operators import stories
from sentimill.operators import texts as X
from sentimill.plans.common import ITEMS, items, r6
from sentimill.sources import table

QUERIES, ORACLES = {}, {}
STOP = "[" + ", ".join(f"'{w}'" for w in sorted(L.STOPWORDS)) + "]"
WORDS = r"regexp_extract_all(lower({}), '[a-z][a-z0-9'']*')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), 'https?://[^ ]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)"""
)
def html_clean(spark, sf):
    t = table(spark, sf, "pages").select("page_id", X.clean_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1".replace("\\\\", "\\"))
def url_domains(spark, sf):
    return table(spark, sf, "pages").groupBy(S.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS n_words, len(list_distinct({WORDS.format('text')})) AS n_kinds, len(regexp_extract_all(text, '\\n')) AS n_breaks FROM documents")
def token_stats(spark, sf):
    w = X.words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_kinds"), F.regexp_count("text", F.lit("\n")).cast("long").alias("n_breaks"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (len(list_filter(list_distinct({WORDS.format('text')}), lambda x: NOT list_contains({STOP}, x))) >= 2) AS kept FROM documents GROUP BY 1")
def meaningful_filter(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_meaningful(F.col("text"))).alias("kept"))


@query(f"SELECT md5(array_to_string({WORDS.format('text')}, ' ')) AS form, min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT source) AS sources FROM documents WHERE len({WORDS.format('text')}) > 0 GROUP BY 1")
def exact_dedupe_collapse(spark, sf):
    c = X.collapse_exact(table(spark, sf, "documents"), "text", [F.col("doc_id")], "source", "doc_id")
    return c.select("form", "doc_id", "copies", "sources")


@query(
    f"""WITH s AS (SELECT min(doc_id) AS i, tokens FROM (SELECT doc_id, list_sort(list_distinct({WORDS.format('text')})) AS tokens FROM documents) WHERE len(tokens) > 0 GROUP BY tokens),
e AS (SELECT i, len(tokens) AS n, unnest(tokens) AS t FROM s), j AS (SELECT a.i AS a, b.i AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2)
SELECT a, b, round(k::DOUBLE / (na + nb - k), 6) AS jaccard FROM j WHERE k >= 0.8 * (na + nb - k)"""
)
def near_duplicate_links(spark, sf):
    return X.near_duplicate_links(table(spark, sf, "documents"), "doc_id", "text").select("a", "b", r6("jaccard").alias("jaccard"))


@query(
    f"""WITH RECURSIVE m AS (SELECT doc_id, list_sort(list_distinct({WORDS.format('text')})) AS tokens FROM documents), s AS (SELECT min(doc_id) AS i, tokens FROM m WHERE len(tokens) > 0 GROUP BY tokens),
e AS (SELECT i, len(tokens) AS n, unnest(tokens) AS t FROM s), j AS (SELECT a.i AS a, b.i AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.i <> b.i GROUP BY 1, 2),
l AS (SELECT a, b FROM j WHERE k >= 0.8 * (na + nb - k)), r AS (SELECT a AS i, a AS g FROM l UNION SELECT l.b, r.g FROM r JOIN l ON l.a = r.i), g AS (SELECT i, min(g) AS g FROM r GROUP BY 1), c AS (SELECT a AS i, count(*) AS links FROM l GROUP BY 1)
SELECT m.doc_id, coalesce(g.g, s.i) AS "group", s.i AS rep, coalesce(c.links, 0) AS links FROM m JOIN s ON s.tokens = m.tokens LEFT JOIN g ON g.i = s.i LEFT JOIN c ON c.i = s.i"""
)
def near_duplicate_groups(spark, sf):
    return X.near_duplicate_groups(table(spark, sf, "documents"), "doc_id", "text")


_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"


@query(
    rf"""WITH RECURSIVE p AS (SELECT page_id, {_DOMAIN} AS batch, regexp_extract(url, '^[^?#]*', 0) AS url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY page_id) AS i FROM p),
r AS (SELECT batch, page_id, i, true AS kept, [url] AS urls, [title] AS titles FROM n WHERE i = 1
  UNION ALL SELECT n.batch, n.page_id, n.i, NOT (list_contains(urls, n.url) OR list_contains(titles, n.title)),
    CASE WHEN list_contains(urls, n.url) OR list_contains(titles, n.title) THEN urls ELSE list_append(urls, n.url) END, CASE WHEN list_contains(urls, n.url) OR list_contains(titles, n.title) THEN titles ELSE list_append(titles, n.title) END
  FROM r JOIN n ON n.batch = r.batch AND n.i = r.i + 1)
SELECT page_id, batch FROM r WHERE kept"""
)
def first_wins_dedupe(spark, sf):
    p = table(spark, sf, "pages").select("page_id", S.domain(F.col("url")).alias("batch"), F.regexp_extract("url", r"^[^?#]*", 0).alias("url"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    return X.first_wins(p, "batch", "url", "title", "page_id").select("page_id", "batch")


@query(
    f"""WITH w AS (SELECT role, conv_id, turn, list_filter({WORDS.format('text')}, lambda x: len(x) >= 3 AND NOT list_contains({STOP}, x)) AS w FROM conversations),
t AS (SELECT role, unnest(list_distinct(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]))) AS term FROM w),
d AS (SELECT role, term, count(*) AS df FROM t GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT role, term, df FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY df DESC, length(term) DESC, term) AS k FROM d) WHERE k <= 15"""
)
def keyword_df(spark, sf):
    c = table(spark, sf, "conversations").withColumn("item", F.struct("conv_id", "turn"))
    return X.keywords(c, "role", "item", "text").select("role", "term", "df")


@query()
def story_clusters(spark, sf):
    d = table(spark, sf, "conversations").select("role", F.floor(F.col("conv_id") / 200).alias("week"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "text")
    return stories.story_clusters(d, "role", "week", "item", "text")


@query(
    """WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
s AS (SELECT x.label, x.vec_id, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) AS cosine FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY 1, 2)
SELECT label, arg_max(vec_id, (round(cosine, 9), -vec_id)) AS vec_id, round(max(cosine), 6) AS cosine FROM s GROUP BY 1"""
)
def cosine_representative(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = e.select("label", F.posexplode("v").alias("i", "x"))
    centre = x.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    s = e.join(centre, "label").select("label", "vec_id", (dot("v", "c") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("c", "c")))).alias("cosine"))
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("cosine", 9), -F.col("vec_id"))).alias("vec_id"), r6(F.max("cosine")).alias("cosine"))


@query(
    f"""WITH {ITEMS}, g AS (SELECT event_type || '-' || (ts::DATE)::VARCHAR AS story, count(DISTINCT outlet)::DOUBLE AS coverage, abs(sum(weight * score) / sum(weight)) AS intensity, (epoch(TIMESTAMP '2024-01-31 00:00:00') - max(s)) / 3600.0 AS age FROM items GROUP BY 1)
SELECT story, round(coverage * (0.5 + 0.5 * intensity) * pow(0.5, age / 72.0), 6) AS impact FROM g"""
)
def story_impact(spark, sf):
    i = items(spark, sf).withColumn("story", F.concat_ws("-", "event_type", F.to_date("ts").cast("string")))
    g = i.groupBy("story").agg(
        F.countDistinct("outlet").cast("double").alias("coverage"), F.abs(F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("intensity"),
        ((F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.max(F.unix_seconds("ts"))) / 3600.0).alias("age"),
    )
    return g.select("story", r6(X.impact(F.col("coverage"), F.col("intensity"), F.col("age"))).alias("impact"))


@query(
    """WITH d AS (SELECT source, doc_id, CASE WHEN n_chars > 5000 THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS c, n_chars FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source, c ORDER BY n_chars DESC, doc_id) AS k FROM d), q AS (SELECT *, CASE WHEN c = 1 AND k > 10 THEN 2 ELSE c END AS c2 FROM p)
SELECT source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c2, n_chars DESC, doc_id) AS place FROM q) WHERE place <= 20"""
)
def quota_topk(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    return X.quota_topk(d, "source", F.col("n_chars") > 5000, F.col("lang") == "en", F.col("n_chars"), "doc_id", 20).select("source", "doc_id", F.col("place").cast("long").alias("place"))


#: A simple rule to be evaluated: capitals and signs mark low quality.
RULE = "length(regexp_replace(text, '[^A-Z!#$%&*|]', '', 'g'))::DOUBLE / greatest(length(text), 1)"
EVAL = f"SELECT l.doc_id, l.quality AS y, CASE WHEN r < 0.15 THEN 1 ELSE 0 END AS p, CASE WHEN r < 0.15 THEN 1.0 - r ELSE least(1.0, 0.5 + r) END AS c FROM (SELECT doc_id, {RULE} AS r FROM documents) JOIN labels l USING (doc_id)"


def judged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.length(F.regexp_replace("text", "[^A-Z!#$%&*|]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("r"))
    p = F.when(F.col("r") < 0.15, 1).otherwise(0)
    c = F.when(F.col("r") < 0.15, 1.0 - F.col("r")).otherwise(F.least(F.lit(1.0), 0.5 + F.col("r")))
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"), c.alias("c"))


@query(
    f"""WITH e AS ({EVAL}), k AS (SELECT unnest([0, 1]) AS cls), m AS (SELECT cls, count(*) FILTER (p = cls AND y = cls)::DOUBLE AS tp, count(*) FILTER (p = cls)::DOUBLE AS pp, count(*) FILTER (y = cls)::DOUBLE AS yy FROM e, k GROUP BY 1)
SELECT cls, round(tp / pp, 6) AS precision_, round(tp / yy, 6) AS recall_, round(2 * tp / (pp + yy), 6) AS f1 FROM m"""
)
def eval_metrics(spark, sf):
    e = judged(spark, sf).select("y", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
    m = e.groupBy("cls").agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tp", (F.col("p") == F.col("cls")) & (F.col("y") == F.col("cls"))), ("pp", F.col("p") == F.col("cls")), ("yy", F.col("y") == F.col("cls")))])
    div = lambda a, b: r6(a / F.when(b > 0, b))
    return m.select("cls", div(F.col("tp"), F.col("pp")).alias("precision_"), div(F.col("tp"), F.col("yy")).alias("recall_"), div(2 * F.col("tp"), F.col("pp") + F.col("yy")).alias("f1"))


@query(f"WITH e AS ({EVAL}) SELECT y, p, count(*) AS n FROM e GROUP BY 1, 2")
def eval_confusion(spark, sf):
    return judged(spark, sf).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH e AS ({EVAL}), b AS (SELECT least(9, floor(c * 10))::INT AS bin, count(*) AS n, avg(c) AS mc, avg((p = y)::INT) AS acc FROM e GROUP BY 1)
SELECT bin, n, round(mc, 6) AS confidence, round(acc, 6) AS accuracy, round(abs(mc - acc), 6) AS gap FROM b"""
)
def eval_ece(spark, sf):
    b = judged(spark, sf).groupBy(F.least(F.lit(9), F.floor(F.col("c") * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mc"), F.avg((F.col("p") == F.col("y")).cast("int")).alias("acc"))
    return b.select("bin", "n", r6("mc").alias("confidence"), r6("acc").alias("accuracy"), r6(F.abs(F.col("mc") - F.col("acc"))).alias("gap"))


@query("SELECT substring(sha1(doc_id::VARCHAR || chr(31) || coalesce(source, '')), 1, 12) AS id, doc_id FROM documents")
def short_ids(spark, sf):
    return table(spark, sf, "documents").select(S.short_id(F.col("doc_id"), F.col("source")).alias("id"), "doc_id")


@query("SELECT conv_id, max(turn) + 1 AS turns, count(DISTINCT role) AS roles, arg_min(role, turn) AS opener FROM conversations GROUP BY 1")
def conversation_shape(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("turns"), F.countDistinct("role").alias("roles"), F.min_by("role", "turn").alias("opener"))
