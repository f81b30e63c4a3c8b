"""Who a text is about: company names and aliases, mentions, relevance, firms named in titles.

Texts meet names by an inverted index: every run of words as long as some alias is looked up by
equality, so no text is compared with every company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimill.functions.parsing import is_roundup, plain_signs
from sentimill.sources.shared import cut

# Legal forms and share classes at a name's end, words too common to stand for a company, noise in brokers' names.
LEGAL = "inc incorporated corp corporation co company companies ltd limited plc llc lp sa ag nv se ab oyj asa spa group holdings holding trust adr class common stock ordinary shares".split() + [r"s\.a", r"n\.v", r"p\.l\.c"]
PLAIN_WORDS = "the first american united national global international general new great us energy capital financial motors foods labs retail technologies systems bank partners resources".split()
FIRM_NOISE = "group securities capital markets partners research financial company co inc llc ltd plc lp sa ag the and of & isi".split()
#: Relevance by kind of evidence, strongest first, and the most of a roundup.
RELEVANCE = {"cashtag": 1.0, "listing": 0.95, "ticker": 0.9, "brand": 0.9, "name": 0.9, "alias": 0.8, "word": 0.5}
ROUNDUP_MOST = 0.4


def name_words(text: Column) -> Column:
    """Lower-case words of a name or title: letters, digits and the signs inside them, possessives dropped."""
    found = F.regexp_extract_all(F.lower(plain_signs(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.&'-]*"), 0)
    return F.filter(F.transform(found, lambda w: F.btrim(F.regexp_replace(w, "'s$", ""), F.lit(".'-"))), lambda w: w != "")


def brand(name: Column) -> Column:
    """A registered name without what follows a slash or comma and without legal forms at its end; the whole name where nothing else is left."""
    core = F.regexp_replace(F.trim(F.regexp_replace(plain_signs(name), r"\s*[/,(].*$", "")), r"(?i)^the\s+", "")
    bare = F.regexp_replace(core, rf"(?i)(?:[\s.&]+(?:{'|'.join(LEGAL)})\.?)+$", "")
    return F.trim(F.when(F.trim(bare) == "", core).otherwise(bare))


def fixed_case(name: Column) -> Column:
    """A name in capitals with capitals at its words' starts only, words of up to three letters without a vowel as they are."""
    one = lambda w: F.when((F.length(w) <= 3) & ~w.rlike("[AEIOUY]"), w).otherwise(F.initcap(F.lower(w)))
    return F.when((F.upper(name) == name) & (F.length(name) > 4), F.array_join(F.transform(F.split(name, " "), one), " ")).otherwise(name)


def aliases(companies: DataFrame, key: str, names: list[str], ticker: str | None = None) -> DataFrame:
    """(key, alias, kind, words): the ways in which texts name each company, one row an alias and company with its strongest kind.

    ``name``: a registered name in full; ``brand``: it without legal forms; ``alias``: a brand's first
    word, if of five letters and not a plain word; ``ticker`` and ``cashtag``. ``companies_of`` says how
    many companies an alias may mean.
    """
    full = F.filter(F.array(*[F.col(n) for n in names]), lambda n: n.isNotNull())
    brands = F.transform(full, brand)
    first = F.filter(F.transform(brands, lambda b: F.try_element_at(name_words(b), F.lit(1))), lambda w: (F.length(w) >= 5) & ~w.isin(*PLAIN_WORDS))
    kind = lambda xs, k: F.transform(xs, lambda x: F.struct(x.alias("w"), F.lit(k).alias("kind")))
    all_ = [kind(F.transform(full, name_words), "name"), kind(F.transform(brands, name_words), "brand"), kind(F.transform(first, lambda w: F.array(w)), "alias")]
    if ticker:
        known = F.filter(F.array(F.lower(F.col(ticker))), lambda t: t.isNotNull())
        all_ += [kind(F.transform(known, lambda t: F.array(t)), "ticker"), kind(F.transform(known, lambda t: F.array(F.concat(F.lit("$"), t))), "cashtag")]
    rows = companies.select(key, F.explode(F.concat(*all_)).alias("x")).select(key, F.array_join("x.w", " ").alias("alias"), "x.kind", F.size("x.w").alias("words")).where(F.col("alias") != "")
    strength = F.map_from_arrays(F.array(*[F.lit(k) for k in RELEVANCE]), F.array(*[F.lit(v) for v in RELEVANCE.values()]))
    one = rows.groupBy(key, "alias", "words").agg(F.min_by("kind", F.struct(-F.element_at(strength, F.col("kind")), F.col("kind"))).alias("kind"))
    return one.join(one.groupBy("alias").agg(F.count(F.lit(1)).alias("companies_of")), "alias")


def runs(texts: DataFrame, item: str, text: str, longest: int, shortest: int = 1) -> DataFrame:
    """(item, run, words, place): every run of ``shortest`` to ``longest`` words of each text, places from 0; cashtags are words with their sign."""
    words = F.regexp_extract_all(F.lower(plain_signs(F.coalesce(F.col(text), F.lit("")))), F.lit(r"\$?[\p{L}\p{N}][\p{L}\p{N}.&'-]*"), 0)
    clean = F.filter(F.transform(words, lambda w: F.btrim(F.regexp_replace(w, "'s$", ""), F.lit(".'-"))), lambda w: w != "")
    at = texts.select(item, clean.alias("w")).select(item, "w", F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("n")).where(F.size("w") >= F.col("n"))
    run = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.col("n")), " ").alias("run"), i.alias("place")))
    return at.select(item, F.col("n").alias("words"), F.explode(run).alias("x")).select(item, "x.run", "words", "x.place")


def mentions(texts: DataFrame, item: str, text: str, names: DataFrame, key: str, longest: int = 6) -> DataFrame:
    """(item, key, alias, kind, place, companies_of): where each text names a company, the longest alias at a place only.

    Runs and aliases meet by equality. The aliases are written first, so that their size is known: Spark
    sends a small table to the texts, and otherwise deals both sides out by alias and splits a hot one.
    """
    found = runs(texts, item, text, longest)
    by_alias = names.groupBy("alias").agg(F.collect_list(F.struct(F.col(key), "kind", "companies_of")).alias("_of"))  # as many as share a name
    hit = cut(found.withColumnRenamed("run", "alias").join(cut(by_alias), "alias"))
    inside = F.explode(F.sequence("place", F.col("place") + F.col("words") - 1))
    taken = hit.select(item, F.col("words").alias("_w"), F.col("place").alias("_p"), inside.alias("_at"))
    longest_at = taken.groupBy(item, "_at").agg(F.max(F.struct("_w", -F.col("_p"))).alias("_best"))
    # an alias counts where it is the longest at its first word
    best = hit.join(longest_at.withColumnRenamed("_at", "place"), [item, "place"]).where((F.col("_best._w") == F.col("words")) & (-F.col("_best.col2") == F.col("place")))
    return best.select(item, "place", "alias", F.explode("_of").alias("c")).select(item, f"c.{key}", "alias", "c.kind", "place", "c.companies_of")


def relevance(found: DataFrame, texts: DataFrame, item: str, text: str, key: str) -> DataFrame:
    """(item, key, relevance, evidence): how surely each text is about each company it names.

    The strongest kind of evidence counts; an alias of several companies counts as a plain word, unless
    the text names the company in another way too; a roundup's relevance is at most ROUNDUP_MOST.
    """
    strength = F.map_from_arrays(F.array(*[F.lit(k) for k in RELEVANCE]), F.array(*[F.lit(v) for v in RELEVANCE.values()]))
    kinds = found.groupBy(item, key).agg(F.max(F.when(F.col("companies_of") == 1, 1).otherwise(0)).alias("_own"), F.collect_set(F.struct("kind", "companies_of")).alias("_k"))
    told = F.transform("_k", lambda k: F.when((k["companies_of"] > 1) & (F.col("_own") == 0), F.lit("word")).otherwise(k["kind"]))
    best = F.array_max(F.transform(told, lambda k: F.struct(F.element_at(strength, k).alias("v"), k.alias("k"))))
    scored = kinds.select(item, key, best.alias("_b"))
    rounds = texts.select(item, is_roundup(F.col(text)).alias("_round"))
    return scored.join(rounds, item).select(item, key, F.when(F.col("_round"), F.least(F.col("_b.v"), F.lit(ROUNDUP_MOST))).otherwise(F.col("_b.v")).alias("relevance"), F.col("_b.k").alias("evidence"))


def firm_core(firm: Column) -> Column:
    """A broker's name as headlines have it: its words without legal and trade noise."""
    return F.array_join(F.filter(name_words(firm), lambda w: ~w.isin(*FIRM_NOISE)), " ")


def same_firm(a: Column, b: Column) -> Column:
    """Whether either spelling of a broker names the other one as whole words."""
    text = lambda c: F.concat(F.lit(" "), F.array_join(name_words(c), " "), F.lit(" "))
    names = lambda x, y: (firm_core(y) != "") & F.contains(text(x), F.concat(F.lit(" "), firm_core(y), F.lit(" ")))
    return names(a, b) | names(b, a)


def routine_revisions(stories: DataFrame, story: str, title: str, at: str, actions: DataFrame, firm: str, day: str, action: str, target: str, prior: str, days: int = 4, small: float = 0.03, longest: int = 4) -> DataFrame:
    """(story, actions, routine): the actions within ``days`` of a story by firms that its title names, and whether they are all small target tweaks.

    Actions are summed by firm and day first, so a story meets at most 2 * days + 1 rows a firm however
    many actions there are. A story that names no firm with actions then has 0 and false; a change of
    rating (up, down, init) or a target moved by ``small`` or more is never routine.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    moved = F.when((F.col(target) > 0) & (F.col(prior) > 0), F.abs(F.col(target) / F.col(prior) - 1))
    daily = actions.withColumns({"_core": firm_core(F.col(firm)), "_day": number(day)}).where(F.col("_core") != "").groupBy("_core", "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(action).isin("up", "down", "init")).alias("_changes"), F.count(moved).alias("_moves"), F.count_if(moved >= small).alias("_large")
    )
    daily = cut(daily)
    cores = cut(daily.select(F.col("_core").alias("run")).distinct())  # of known size, so that a small table goes to the titles
    named = runs(stories, story, title, longest).join(cores, "run", "left_semi").select(story, F.col("run").alias("_core")).distinct()
    near = named.join(stories.select(story, number(at).alias("_s")), story).select(story, "_core", F.explode(F.sequence(F.col("_s") - days, F.col("_s") + days)).alias("_day"))
    sums = near.join(daily, ["_core", "_day"]).groupBy(story).agg(*[F.sum(c).alias(c) for c in ("_n", "_changes", "_moves", "_large")])
    routine = (F.col("_changes") == 0) & (F.col("_large") == 0) & (F.col("_moves") > 0)
    return stories.select(story).join(sums, story, "left").select(story, F.coalesce("_n", F.lit(0)).alias("actions"), F.coalesce(routine, F.lit(False)).alias("routine"))
