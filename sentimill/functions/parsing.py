"""Column expressions that read headlines, names, symbols and transaction texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms, one for one.
FANCY, PLAIN = "‘’“”–— ", "''\"\"-- "
#: Ordered patterns of transaction texts; the first that holds names the kind.
KINDS = [
    ("gift", r"\bgift\b"), ("award", r"\b(?:award|grant|vest)"), ("exercise", r"\b(?:exercise|conversion|option)"),
    ("sell", r"\b(?:sale|sold|sell|dispos)"), ("buy", r"\b(?:purchase|bought|buy|acqui)"),
]
GRADES = {"bull": r"\b(?:buy|outperform|overweight|positive|accumulate)\b", "bear": r"\b(?:sell|underperform|underweight|negative|reduce)\b"}


def plain_signs(text: Column) -> Column:
    """Typographic quotes, dashes and blanks as plain ones, the ellipsis as three dots."""
    for fancy, plain in [*zip(FANCY, PLAIN, strict=True), ("…", "...")]:
        text = F.replace(text, F.lit(fancy), F.lit(plain))
    return text


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def is_shouting(text: Column, share: float = 0.7, least: int = 6) -> Column:
    """Whether at least ``share`` of ASCII letters, of which there are ``least``, are capitals."""
    caps, letters = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.coalesce((letters >= least) & (caps >= share * letters), F.lit(False))


def is_question(title: Column) -> Column:
    return F.coalesce(F.trim(title).rlike(r"\?$") | F.lower(title).rlike(r"^(?:should|is|are|will|can|why|what|how|which)\b"), F.lit(False))


def is_roundup(title: Column) -> Column:
    """Four cashtags, or the wording of a list."""
    tags = F.size(F.array_distinct(F.regexp_extract_all(title, F.lit(r"\$[A-Z]{1,5}"), 0)))
    return F.coalesce((tags >= 4) | F.lower(title).rlike(r"^(?:top )?\d+ (?:best |top )?(?:stocks|shares|picks)\b|stocks to (?:buy|watch|avoid)"), F.lit(False))


def relevance(title: Column, ticker: str, name: str) -> Column:
    """0..1: cashtag 1.0, listing 0.95, bare ticker 0.9, name 0.8, else 0; a roundup is capped at 0.4."""
    x = (
        F.when(title.rlike(rf"\${ticker}(?![A-Za-z])"), 1.0)
        .when(title.rlike(rf"\((?:NYSE|NASDAQ): ?{ticker}\)"), 0.95)
        .when(title.rlike(rf"(?<![A-Za-z$]){ticker}(?![A-Za-z])"), 0.9)
        .when(F.lower(title).rlike(rf"(?<![a-z]){name.lower()}(?![a-z])"), 0.8)
        .otherwise(0.0)
    )
    return F.when(is_roundup(title), F.least(x, F.lit(0.4))).otherwise(x)


def transaction_kind(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(low.rlike(KINDS[0][1]), KINDS[0][0])
    for kind, rx in KINDS[1:]:
        out = out.when(low.rlike(rx), kind)
    return out.otherwise("other")


def grade_polarity(grade: Column) -> Column:
    low = F.lower(grade)
    return F.when(low.rlike(GRADES["bear"]), "bear").when(low.rlike(GRADES["bull"]), "bull").otherwise("neutral")


def person_name(text: Column) -> Column:
    """'DOE JANE M' as 'Jane M. Doe'; other forms are only put in title case."""
    last, first, middle = (F.regexp_extract(text, r"^([A-Z'\-]+) ([A-Z'\-]+)(?: ([A-Z]))?$", i) for i in (1, 2, 3))
    whole = F.concat(F.initcap(first), F.when(middle != "", F.concat(F.lit(" "), middle, F.lit("."))).otherwise(""), F.lit(" "), F.initcap(last))
    return F.when(last != "", whole).otherwise(F.initcap(text))


def canonical_symbol(symbol: Column) -> Column:
    """Upper case; share classes with a dot, crypto pairs with a dash, indices kept with their caret."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike(r"^[A-Z]{1,5}[-/ .][A-Z]$"), F.regexp_replace(s, r"[-/ .]([A-Z])$", r".$1")).when(s.rlike(r"^[A-Z]{2,5}[/ ]?USD$"), F.regexp_replace(s, r"[/ ]?USD$", "-USD")).otherwise(s)
