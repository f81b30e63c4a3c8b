"""Headline queries: headlines that orders make, and the given texts, read by the headline operators; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentimill.functions import lexicon as L
from sentimill.functions import phrasebook as P
from sentimill.functions.parsing import FANCY, PLAIN
from sentimill.operators import headlines as H
from sentimill.plans.common import r6
from sentimill.sources import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: A headline for every order, in words that Spark and DuckDB read alike.
_COMPANY = "concat(split_part('Alder,Birch,Cedar,Dogwood,Elm,Fir,Ginkgo,Hazel,Ivy,Juniper,Larch,Maple', ',', CAST(1 + o_custkey % 12 AS INT)), ' ', split_part('Foods,Motors,Labs,Energy,Retail', ',', CAST(1 + o_custkey % 5 AS INT)))"
_BROKER = "split_part('Harbor Street,Harbor St.,Northfield,Pine Ridge Capital,Quayside Securities,Stonebridge,Windmere', ',', CAST(1 + o_orderkey % 7 AS INT))"
_UNIT = "split_part(' million, mln,m, Billion,bn,,k', ',', CAST(1 + (o_orderkey + o_custkey) % 7 AS INT))"
_A, _B = "CAST(CAST(floor(o_totalprice / 1000.0) AS BIGINT) AS {S})", "CAST(1 + (o_orderkey * 37 + o_custkey) % 500 AS {S})"
_MOVE = "split_part('jump,fall,rise,drop', ',', CAST(1 + o_custkey % 4 AS INT))"
TITLE = f"""CASE o_orderkey % 12
 WHEN 0 THEN concat(broker, ' upgrades ', company, ' to buy from hold, lifts price target to $', a, ' from $', b)
 WHEN 1 THEN concat(company, ' downgraded at ', broker, '; Windmere cuts price target to USD ', b, ' from USD ', a)
 WHEN 2 THEN concat(company, ' Q3 revenue $', a, '.50', unit, ' vs $', b, unit, ', beats estimates')
 WHEN 3 THEN concat(company, ' posts net loss of $', b, ' million against $', a, ',500 mln a year ago')
 WHEN 4 THEN concat(company, ' raises full-year guidance; shares ', {_MOVE}, ' ', CAST(o_custkey % 9 AS {{S}}), '.5%')
 WHEN 5 THEN concat('Will ', company, ' miss expectations? Costs rose from ', b, '% to ', a, '%')
 WHEN 6 THEN concat('Update: ', company, ' to acquire a rival for EUR ', a, unit, ' - Quayside downgrades it')
 WHEN 7 THEN concat('Exclusive | ', company, ' isn’t expected to cut dividend, says CEO (NYSE: ABC)')
 WHEN 8 THEN concat(company, ' shares fall ', b, '% after profit warning but margins improved sharply')
 WHEN 9 THEN concat('Why ', company, ' could surge: analysts weigh buyback, lawsuit settled')
 WHEN 10 THEN concat(company, ' sales of $', a, unit, ' vs. consensus of $', b, unit, ' “and” no growth')
 ELSE concat(company, ' jumps ', b, '%, stock slumps later; ', broker, ' upgrades and Windmere upgrades ', company) END"""


def headlines(spark, sf):
    """(item, company, at, title) of every order."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate", f"{_COMPANY} AS company", f"{_BROKER} AS broker", f"{_UNIT} AS unit", f"{_A.format(S='STRING')} AS a", f"{_B.format(S='STRING')} AS b")
    return o.selectExpr("o_orderkey AS item", "company", "o_orderdate AS at", f"{TITLE.format(S='STRING')} AS title")


HEADLINES = f"""heads AS (SELECT o_orderkey AS item, company, o_orderdate AS at, {TITLE.format(S="VARCHAR")} AS title FROM (
  SELECT o_orderkey, o_custkey, o_orderdate, {_COMPANY} AS company, {_BROKER} AS broker, {_UNIT} AS unit, {_A.format(S="VARCHAR")} AS a, {_B.format(S="VARCHAR")} AS b FROM orders))"""


# -- the operators' definitions in SQL --------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def prepared_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower(replace(translate(coalesce({x}, ''), {q(FANCY)}, {q(PLAIN)}), '…', '...')), '[\\s\\x0B]+', ' ', 'g'), {q(H.BEYOND)}, '_', 'g')"
    for sign, pattern in P.CODES:
        out = f"regexp_replace({out}, {q(pattern)}, '{sign}\\1', 'g')"
    return out


def tokens_sql(prepared: str) -> str:
    money = rf"""substr(t, 1, 1) || CASE WHEN contains(n, '.') THEN rtrim(rtrim(n, '0'), '.') ELSE n END || CASE WHEN u = 'thousand' THEN 'k' ELSE substr(u, 1, 1) END"""
    money = money.replace("n,", "replace(regexp_extract(t, '^[$€£](" + P.NUMBER + ")', 1), ',', ''),").replace("ELSE n ", "ELSE replace(regexp_extract(t, '^[$€£](" + P.NUMBER + ")', 1), ',', '') ").replace("u,", "regexp_extract(t, '([a-z]*)$', 1),").replace("WHEN u ", "WHEN regexp_extract(t, '([a-z]*)$', 1) ")
    return rf"list_filter(list_transform(regexp_extract_all({prepared}, {q(P.TOKEN)}), lambda t: CASE WHEN regexp_matches(t, '^[$€£]\d') THEN {money} ELSE trim(regexp_replace(t, '''s$', ''), '''-') END), lambda t: t <> '')"


def claimed_sql(x: str) -> str:
    out = rf"regexp_replace({prepared_sql(x)}, '([a-z])-([a-z])', '\1 \2', 'g')"
    for key, _, pattern in P.RULES:
        out = rf"regexp_replace({out}, {q(pattern)}, ' {H.OPEN}{key}{H.PART}_\1_{H.PART}_\2_{H.PART}_\3_{H.CLOSE} ', 'g')"
    out = rf"regexp_replace({out}, {q(H.trie_pattern(P.roles()))}, '{H.OPEN}{H.PART}\1{H.CLOSE}', 'g')"
    return rf"regexp_replace({out}, '\b(?:{'|'.join(P.CONTRAST)})\b', ' {H.TURN} ', 'g')"


def amount_sql(x: str) -> str:
    scale = f"regexp_extract({x}, '([a-z]*)$', 1)"
    number = f"replace(regexp_extract({x}, '({P.NUMBER})', 1), ',', '')"
    factor = f"CASE CASE WHEN {scale} = 'thousand' THEN 'k' ELSE substr({scale}, 1, 1) END WHEN 't' THEN 1e12 WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1.0 END"
    return rf"CASE WHEN {number} <> '' AND NOT regexp_matches({x}, '^(?:19|20)\d\d$') THEN TRY_CAST(nullif({number}, '') AS DOUBLE) * {factor} END"


def evidence_sql(source: str) -> str:
    """CTEs from ``source`` (id, text) to ``hits`` (id, s, ci, i, term, value)."""
    book = ", ".join(f"({q(k)}, '{r}', {v!r}::DOUBLE)" for k, (r, v) in P.roles().items())
    fixed = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v, _ in P.RULES if v is not None)
    part = lambda k: f"regexp_extract(p, {q(H.MARK)}, {k})"
    same = "n.id = h.id AND n.s = h.s AND n.ci = h.ci"
    return rf"""src AS ({source}), book(phrase, role, v) AS (VALUES {book}),
t AS (SELECT id, string_split({claimed_sql("text")}, '{H.TURN}') AS segs FROM src),
seg AS (SELECT id, len(segs) AS n, unnest(segs) AS seg, generate_subscripts(segs, 1) - 1 AS s FROM t),
cl AS (SELECT id, n, s, unnest(cs) AS c, generate_subscripts(cs, 1) AS ci FROM (SELECT *, regexp_split_to_array(seg, {q(H.CLAUSE)}) AS cs FROM seg)),
pc AS (SELECT id, n, s, ci, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT *, regexp_extract_all(c, {q(H.PIECE)}) AS ps FROM cl)),
mk AS (SELECT *, {part(1)} AS key, {part(2)} AS a, {part(3)} AS b, {part(4)} AS c, regexp_extract(p, '^{H.OPEN}{H.PART}(.*){H.CLOSE}$', 1) AS phrase FROM pc WHERE starts_with(p, '{H.OPEN}')),
sp AS (SELECT id, n, s, ci, i, a, b, c, CASE WHEN key <> '' THEN key ELSE mk.phrase END AS term, CASE WHEN key <> '' THEN 'rule' ELSE role END AS role, CASE WHEN key <> '' THEN CASE key {fixed} END ELSE v END AS v
  FROM mk LEFT JOIN book ON book.phrase = mk.phrase),
ctx AS (SELECT h.*,
  (SELECT arg_min(n.v, abs(h.i - n.i) * 2 + CASE WHEN n.i > h.i THEN 1 ELSE 0 END) FROM sp n WHERE {same} AND n.role = 'metric' AND abs(h.i - n.i) <= {H.NEAR}) AS metric,
  coalesce((SELECT arg_max(n.v, n.i) FROM sp n WHERE {same} AND n.role = 'metric' AND n.i BETWEEN h.i - {H.BEFORE} AND h.i - 1), 1.0) AS before,
  (SELECT count(*) FROM sp n WHERE {same} AND n.role = 'direction' AND n.i BETWEEN h.i - {H.GOVERNED} AND h.i - 1) AS governed,
  coalesce((SELECT max(n.v) FROM sp n WHERE {same} AND n.role = 'strength' AND abs(h.i - n.i) = 1), 1.0) AS strength,
  coalesce((SELECT min(n.v) FROM sp n WHERE {same} AND n.role = 'hedge' AND n.i < h.i), 1.0) AS hedge,
  (SELECT count(*) FROM sp n WHERE {same} AND n.role = 'not' AND n.i BETWEEN h.i - {H.NEGATED} AND h.i - 1) AS turned
  FROM sp h WHERE h.role IN ('word', 'direction', 'rule')),
am AS (SELECT *, CASE WHEN term = 'moved' THEN {amount_sql("c")} ELSE {amount_sql("a")} END AS new, CASE WHEN term = 'moved' THEN {amount_sql("a")} ELSE {amount_sql("c")} END AS old FROM ctx),
cmp AS (SELECT *, (new - old) * before AS moved, abs((new - old) * before) / greatest(abs(old), 1e-9) AS rel FROM am),
base AS (SELECT *, CASE WHEN role = 'direction' THEN v * coalesce(metric, 0.5) WHEN v IS NOT NULL THEN v WHEN governed > 0 THEN NULL
  WHEN ends_with(a, '%') = ends_with(c, '%') AND moved <> 0 THEN sign(moved) * CASE WHEN b <> '' THEN (0.5 + 0.4 * least(1.0, rel / 0.05)) * 0.7 ELSE (0.55 + 0.45 * least(1.0, rel / 0.2)) * 0.85 END END AS x FROM cmp),
hits AS (SELECT id, s, ci, i, term, x * strength * hedge * CASE WHEN turned > 0 THEN {H.TURNED} ELSE 1.0 END * CASE WHEN s < n - 1 THEN {H.CONCEDED} ELSE 1.0 END AS value FROM base WHERE x IS NOT NULL)"""


def scored_sql(source: str) -> str:
    """CTEs to ``scores`` (id, score, label, confidence, drivers)."""
    return f"""{evidence_sql(source)},
worth AS (SELECT *, value * pow({H.REPEAT}, row_number() OVER (PARTITION BY id, term ORDER BY s, ci, i) - 1) AS v FROM hits),
terms AS (SELECT id, term, round(-abs(sum(v)), 9) AS k FROM worth GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, term) AS place FROM terms),
d AS (SELECT id, -sum(k) AS mass, string_agg(term, ',' ORDER BY k, term) FILTER (place <= 5) AS drivers FROM ranked GROUP BY 1),
raw AS (SELECT id, sum(v) AS raw FROM worth GROUP BY 1),
sc AS (SELECT src.id, coalesce(raw, 0) AS raw, coalesce(mass, 0) AS mass, coalesce(drivers, '') AS drivers, tanh(coalesce(raw, 0) * CASE WHEN ends_with(rtrim(coalesce(text, '')), '?') THEN {H.ASKED} ELSE 1.0 END / {H.SCALE}) AS score FROM src LEFT JOIN raw USING (id) LEFT JOIN d USING (id)),
scores AS (SELECT id, round(score, 6) + 0.0 AS score, CASE WHEN score > 0.05 THEN 'bullish' WHEN score < -0.05 THEN 'bearish' ELSE 'neutral' END AS label,
  round(CASE WHEN mass > 0 THEN least(1.0, mass / 6.0) * abs(raw) / mass ELSE 0.0 END, 6) AS confidence, drivers FROM sc)"""


def events_sql(source: str) -> str:
    """CTEs to ``ev`` (id, place, key, polarity, firm, value)."""
    book = " UNION ALL ".join(f"SELECT u.*, {i} AS j, {q(k)} AS key, '{p}' AS polarity, before || ' ' || regexp_extract(part, {q(f'(?s)^(.*?)(?:{rx})')}, 1) AS lead FROM u WHERE regexp_matches(part, {q(rx)})" for i, (k, p, rx) in enumerate(P.EVENTS))
    firms = ", ".join(f"({q(a)}, {q(c)})" for a, c in P.FIRMS.items())
    alias = "|".join(sorted(P.FIRMS, key=lambda a: (-len(a), a)))
    return rf"""src AS ({source}), firms(alias, firm) AS (VALUES {firms}),
cl AS (SELECT id, unnest(cs) AS whole, generate_subscripts(cs, 1) AS ci FROM (SELECT id, string_split(regexp_replace(trim({prepared_sql("text")}), '([.;:!?]+)(?:\s+|$)|\s-\s', '\1{H.TURN}', 'g'), '{H.TURN}') AS cs FROM src)),
pt AS (SELECT id, ci, whole, ps, unnest(ps) AS part, generate_subscripts(ps, 1) AS pi FROM (SELECT *, regexp_split_to_array(whole, ',\s+|\s+(?:and|while)\s+') AS ps FROM cl)),
u AS (SELECT id, ci, pi, whole, part, array_to_string(ps[1:pi - 1], ', ') AS before FROM pt),
m AS ({book}),
f AS (SELECT m.*, regexp_extract(before || ', ' || part, {q(rf"(?s)^.*\b({alias})\b")}, 1) AS alias, regexp_matches(part, {q(P.MOVER)}) AS named,
  CASE WHEN starts_with(key, 'target') THEN {amount_sql("regexp_extract(part, " + q(rf"price target.*?\bto\s+({P.AMOUNT})") + ", 1)")}
    WHEN starts_with(key, 'price') THEN TRY_CAST(regexp_extract(part, '(\d{{1,4}}(?:\.\d{{1,3}})?)%', 1) AS DOUBLE) END AS value
  FROM m WHERE regexp_matches(lead, {q(P.FACT)}) OR NOT (regexp_matches(lead, {q(P.HYPOTHETICAL)}) OR (regexp_matches(whole, '^\s*(?:can|could|will|would|should|might|may)\b') AND regexp_matches(whole, '\?+$')))),
g AS (SELECT f.*, CASE WHEN key IN {P.ANALYST!r} THEN firms.firm END AS firm FROM f LEFT JOIN firms ON firms.alias = f.alias),
o AS (SELECT *, row_number() OVER (PARTITION BY id, key, firm ORDER BY ci, pi, j) AS k FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ci, pi, j) AS place FROM o WHERE k = 1),
mv AS (SELECT a.id, CASE WHEN a.named <> b.named THEN CASE WHEN a.named THEN b.place ELSE a.place END WHEN a.named THEN greatest(a.place, b.place)
  WHEN (a.value IS NULL) <> (b.value IS NULL) THEN CASE WHEN a.value IS NULL THEN a.place ELSE b.place END ELSE least(a.place, b.place) END AS lost
  FROM p a JOIN p b ON a.id = b.id AND a.key = 'price_up' AND b.key = 'price_down'),
ev AS (SELECT p.id, p.key, p.polarity, p.firm, p.value, row_number() OVER (PARTITION BY p.id ORDER BY p.place) AS place FROM p LEFT JOIN mv USING (id) WHERE lost IS NULL OR p.place <> lost)"""


# -- queries ----------------------------------------------------------------------------------------

_FORM = f"regexp_replace(regexp_replace(trim({prepared_sql('title')}), {q(P.LEAD)}, ''), {q(P.LISTING)}, ' ', 'g')"


@query(f"WITH {HEADLINES} SELECT item, array_to_string({tokens_sql(prepared_sql('title'))}, '|') AS tokens, array_to_string({tokens_sql(prepared_sql(_FORM))}, ' ') AS form FROM heads")
def headline_tokens(spark, sf):
    return headlines(spark, sf).select("item", F.array_join(H.tokens(F.col("title")), "|").alias("tokens"), H.dedup_form(F.col("title")).alias("form"))


def _listed(table: dict[str, str]) -> str:
    return "CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


_STEMS = rf"""w AS (SELECT lower(word) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z-]*')) AS word FROM documents UNION ALL SELECT unnest({tokens_sql(prepared_sql("title"))}) FROM heads) GROUP BY 1),
b AS (SELECT w, n, coalesce({_listed(P.IRREGULAR).format(x="w")}, w) AS b FROM w),
p AS (SELECT *, CASE WHEN b LIKE '%ies' AND length(b) > 4 THEN b[:-4] || 'y' WHEN regexp_matches(b, '(?:sses|shes|ches|xes|zes)$') THEN b[:-3] WHEN b LIKE '%s' AND NOT regexp_matches(b, '(?:ss|us|is)$') THEN b[:-2] ELSE b END AS p FROM b),
s AS (SELECT *, CASE WHEN p LIKE '%ied' AND length(p) > 4 THEN p[:-4] || 'y' WHEN p LIKE '%eed' AND length(p) > 4 THEN p[:-2] WHEN regexp_matches(p, '[aeiouy].*ing$') AND length(p) > 5 THEN p[:-4] WHEN regexp_matches(p, '[aeiouy].*ed$') AND length(p) > 4 THEN p[:-3] ELSE p END AS s,
  (regexp_matches(p, '[aeiouy].*ing$') AND length(p) > 5 OR regexp_matches(p, '[aeiouy].*ed$') AND length(p) > 4 AND NOT p LIKE '%eed') AND NOT (p LIKE '%ied' AND length(p) > 4) AS bare FROM p),
t AS (SELECT *, CASE WHEN bare AND length(s) > 2 AND s[-1] = s[-2] AND s[-1] NOT IN ('l', 's', 'z') THEN s[:-2] ELSE s END AS t FROM s),
e AS (SELECT w, n, CASE WHEN length(b) <= 3 OR NOT regexp_matches(replace(b, '-', ''), '^[a-z]+$') THEN b WHEN t LIKE '%e' AND length(t) > 3 THEN t[:-2] ELSE t END AS e FROM t)"""


@query(f"WITH {HEADLINES}, {_STEMS} SELECT CASE WHEN w IN {P.KEPT!r} THEN w ELSE coalesce({_listed(P.FINAL).format(x='w')}, e) END AS stem, count(*) AS forms, sum(n)::BIGINT AS n FROM e GROUP BY 1")
def word_stems(spark, sf):
    """Stems of all words of the documents and headlines; distinct words are stemmed, not occurrences."""
    words = H.each(table(spark, sf, "documents"), array=F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z-]*"), 0), name="w")
    words = words.unionByName(H.each(headlines(spark, sf), array=H.tokens(F.col("title")), name="w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).groupBy(H.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))


@query(f"WITH {HEADLINES}, {evidence_sql('SELECT item AS id, title AS text FROM heads')} SELECT id AS item, row_number() OVER (PARTITION BY id ORDER BY s, ci, i) AS place, term, round(value, 6) AS value FROM hits")
def headline_evidence(spark, sf):
    """Claimed spans, comparisons and composed directions of every headline, with their values."""
    h = H.each(H.evidence(headlines(spark, sf), "title"), "item", array=F.col("hits"), name="h", place="place")
    return h.select("item", (F.col("place") + 1).cast("long").alias("place"), "h.term", r6("h.value").alias("value"))


@query(f"WITH {HEADLINES}, {scored_sql('SELECT item AS id, title AS text FROM heads')} SELECT id AS item, score, label, confidence, drivers FROM scores")
def headline_scoring(spark, sf):
    d = H.scored(headlines(spark, sf), "title")
    return d.select("item", r6("score").alias("score"), "label", r6("confidence").alias("confidence"), F.array_join("drivers", ",").alias("drivers"))


@query(f"WITH {scored_sql('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, score, label, confidence, drivers FROM scores")
def text_scoring(spark, sf):
    d = H.scored(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", r6("score").alias("score"), "label", r6("confidence").alias("confidence"), F.array_join("drivers", ",").alias("drivers"))


@query(f"WITH {HEADLINES}, {events_sql('SELECT item AS id, title AS text FROM heads')} SELECT id AS item, place, key, polarity, firm, round(value, 6) AS value FROM ev")
def headline_events(spark, sf):
    e = H.each(H.events(headlines(spark, sf), "title"), "item", array=F.col("events"), name="e", place="place")
    return e.select("item", (F.col("place") + 1).cast("long").alias("place"), "e.key", "e.polarity", "e.firm", r6("e.value").alias("value"))


@query(
    f"WITH {events_sql('SELECT conv_id * 100000 + turn AS id, text FROM conversations')}, j AS (SELECT id, string_agg(key, ',' ORDER BY place) AS events FROM ev GROUP BY 1) "
    "SELECT conv_id, turn, coalesce(events, '') AS events FROM conversations LEFT JOIN j ON id = conv_id * 100000 + turn"
)
def event_detection(spark, sf):
    c = H.events(table(spark, sf, "conversations"), "text")
    return c.select("conv_id", "turn", F.array_join(F.transform("events", lambda e: e["key"]), ",").alias("events"))


_THEMES = ", ".join(f"({i}, '{k}', {w.split()!r})" for i, (k, w) in enumerate(L.THEMES.items()))


@query(
    f"""WITH b(j, theme, words) AS (VALUES {_THEMES}), x AS (SELECT role, conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations),
h AS (SELECT role, conv_id, turn, theme, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_intersect(list_distinct(w), words)) DESC, j) AS k FROM x JOIN b ON len(list_intersect(w, words)) > 0),
g AS (SELECT x.role, coalesce(h.theme, 'none') AS theme FROM x LEFT JOIN (SELECT * FROM h WHERE k <= 4) h ON h.conv_id = x.conv_id AND h.turn = x.turn)
SELECT role, theme, count(*) AS n FROM g GROUP BY 1, 2"""
)
def theme_classification(spark, sf):
    c = table(spark, sf, "conversations").select("role", F.explode_outer(H.themes(F.col("text"))).alias("theme"))
    return c.groupBy("role", F.coalesce("theme", F.lit("none")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))


def _stem_sql(w: str) -> str:
    """The steps of ``word_stems`` for one word, as an expression."""
    base = f"coalesce({_listed(P.IRREGULAR).format(x=w)}, {w})"
    let = lambda x, body: f"list_transform([{x}], lambda z: {body})[1]"
    singular = let(base, "CASE WHEN z LIKE '%ies' AND length(z) > 4 THEN z[:-4] || 'y' WHEN regexp_matches(z, '(?:sses|shes|ches|xes|zes)$') THEN z[:-3] WHEN z LIKE '%s' AND NOT regexp_matches(z, '(?:ss|us|is)$') THEN z[:-2] ELSE z END")
    single = lambda x: let(x, "CASE WHEN length(z) > 2 AND z[-1] = z[-2] AND z[-1] NOT IN ('l', 's', 'z') THEN z[:-2] ELSE z END")
    present = let(singular, f"CASE WHEN z LIKE '%ied' AND length(z) > 4 THEN z[:-4] || 'y' WHEN z LIKE '%eed' AND length(z) > 4 THEN z[:-2] WHEN regexp_matches(z, '[aeiouy].*ing$') AND length(z) > 5 THEN {single('z[:-4]').replace('lambda z', 'lambda y').replace('length(z)', 'length(y)').replace('z[-1]', 'y[-1]').replace('z[-2]', 'y[-2]').replace('THEN z[:-2] ELSE z', 'THEN y[:-2] ELSE y')} WHEN regexp_matches(z, '[aeiouy].*ed$') AND length(z) > 4 THEN {single('z[:-3]').replace('lambda z', 'lambda y').replace('length(z)', 'length(y)').replace('z[-1]', 'y[-1]').replace('z[-2]', 'y[-2]').replace('THEN z[:-2] ELSE z', 'THEN y[:-2] ELSE y')} ELSE z END")
    short = let(present, "CASE WHEN z LIKE '%e' AND length(z) > 3 THEN z[:-2] ELSE z END")
    return f"CASE WHEN {w} IN {P.KEPT!r} THEN {w} ELSE coalesce({_listed(P.FINAL).format(x=w)}, CASE WHEN length({base}) <= 3 OR NOT regexp_matches(replace({base}, '-', ''), '^[a-z]+$') THEN {base} ELSE {short} END) END"


@query(
    f"""WITH {HEADLINES}, s AS (SELECT item, list_sort(list_filter(list_distinct(list_transform(list_filter({tokens_sql(prepared_sql("title"))}, lambda t: regexp_matches(t, '^[a-z][a-z''-]{{2,}}$') AND NOT list_contains({sorted(L.STOPWORDS)!r}, t)), lambda w: {_stem_sql("w")})), lambda x: NOT list_contains({P.GENERIC!r}, x))) AS s FROM heads),
d AS (SELECT s, min(item) AS i FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT i, len(s) AS n, unnest(s) AS t FROM d),
j AS (SELECT a.i AS a, b.i AS b, least(any_value(a.n), any_value(b.n)) AS n, count(*) AS common FROM e a JOIN e b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2)
SELECT a, b, common::INT AS common FROM j WHERE common >= greatest(ceil(n * 0.5), least(3, n))"""
)
def headline_overlaps(spark, sf):
    """Distinct headlines of the same story by their stems: half of the smaller one's, and three, shared."""
    h = headlines(spark, sf).select("item", H.story_stems(F.col("title")).alias("s"))
    return H.overlap_links(h, "item", "s")


_TITLE = r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_TITLE_FORM = f"regexp_replace(regexp_replace(trim({prepared_sql(_TITLE)}), {q(P.LEAD)}, ''), {q(P.LISTING)}, ' ', 'g')"
_SLOTS = r"list_filter(q[:-2], lambda t: regexp_matches(t, '^\$?\d[\d.,]*[%tbmk]?$') OR list_contains(" + repr(list(P.CALENDAR)) + ", t))"


def _in_order(short: str, long_: str) -> str:
    """Tokens of one list found in another in order, by a fold over records of place, count and token."""
    place = f"list_position({long_}[acc.p + 1:], x.t)"
    return f"list_reduce(list_concat([{{'p': 0, 'n': 0, 't': ''}}], list_transform({short}, lambda t: {{'p': 0, 'n': 0, 't': t}})), lambda acc, x: {{'p': acc.p + CASE WHEN coalesce({place}, 0) > 0 THEN {place} ELSE 0 END, 'n': acc.n + CASE WHEN coalesce({place}, 0) > 0 THEN 1 ELSE 0 END, 't': x.t}}).n"


@query(
    f"""WITH RECURSIVE m AS (SELECT page_id, {tokens_sql(prepared_sql(_TITLE_FORM))} AS q FROM pages), s AS (SELECT min(page_id) AS i, q, list_distinct(q) AS s, {_SLOTS} AS slots FROM m WHERE len(q) > 0 GROUP BY q),
e AS (SELECT i, unnest(s) AS t FROM s), j AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM e a JOIN e b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN s x ON x.i = a JOIN s y ON y.i = b
  WHERE NOT (len(list_filter(x.slots, lambda v: NOT list_contains(y.slots, v))) > 0 AND len(list_filter(y.slots, lambda v: NOT list_contains(x.slots, v))) > 0)
    AND (n >= 0.8 * (len(x.s) + len(y.s) - n) OR least(len(x.q), len(y.q)) >= 6 AND n >= 0.9 * least(len(x.s), len(y.s))
      AND (len(x.q) <= len(y.q) AND {_in_order("x.q", "y.q")} >= 0.9 * len(x.q) OR len(y.q) <= len(x.q) AND {_in_order("y.q", "x.q")} >= 0.9 * len(y.q)))),
w AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a AS i, a AS g FROM w UNION SELECT w.b, r.g FROM r JOIN w ON w.a = r.i), g AS (SELECT i, min(g) AS g FROM r GROUP BY 1)
SELECT m.page_id, coalesce(g.g, s.i, m.page_id) AS "group" FROM m LEFT JOIN s ON s.q = m.q LEFT JOIN g ON g.i = s.i"""
)
def title_copies(spark, sf):
    """Pages whose titles are copies, truncations or extensions of each other."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    return H.title_groups(p, "page_id", "title")
