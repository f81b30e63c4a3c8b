"""Nested provider payloads, one a row as text: columnar filings, ownership documents, posts, boards, registries.

Each reader takes a DataFrame with the payload's text in a column and keeps that row's ``carry``
columns. Payloads and rows that can't be read are left out, or told with a reason, and never
fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILINGS = "cik STRING, filings STRUCT<recent STRUCT<accessionNumber ARRAY<STRING>, form ARRAY<STRING>, filingDate ARRAY<STRING>, items ARRAY<STRING>>>"
_VALUE = "STRUCT<value STRING>"
OWNERSHIP = (
    "aff10b5One STRING, reportingOwner STRUCT<reportingOwnerId STRUCT<rptOwnerName STRING>, reportingOwnerRelationship STRUCT<officerTitle STRING, isDirector STRING, isTenPercentOwner STRING, isOfficer STRING>>, "
    f"nonDerivativeTable STRUCT<nonDerivativeTransaction ARRAY<STRUCT<transactionDate {_VALUE}, transactionCoding STRUCT<transactionCode STRING>, "
    f"transactionAmounts STRUCT<transactionShares {_VALUE}, transactionPricePerShare {_VALUE}>, ownershipNature STRUCT<directOrIndirectOwnership {_VALUE}>>>>"
)
REGISTRY = "MAP<STRING, STRUCT<cik_str STRING, ticker STRING, title STRING>>"
BOARD = "results ARRAY<STRUCT<rank INT, ticker STRING, name STRING, mentions INT, upvotes INT, rank_24h_ago INT, mentions_24h_ago INT>>"
# What transaction codes mean.
CODE_KINDS = {"P": "buy", "S": "sell", "A": "award", "M": "exercise", "X": "exercise", "G": "gift", "F": "sell"}
CASHTAG = r"\$([A-Za-z][A-Za-z.-]{0,9})"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def filings(payloads: DataFrame, payload: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(filings, refused): columnar arrays zipped to (carry, cik, accession, form, filed, items), and what was left out with its reason.

    A payload without arrays and a row without a readable date are refused; arrays of unequal length are filled with nulls.
    """
    read = payloads.select(*carry, F.from_json(payload, FILINGS, {"mode": "PERMISSIVE"}).alias("p"))
    recent = "p.filings.recent"
    lost = read.where(F.col(f"{recent}.form").isNull()).select(*carry, F.lit("no filings").alias("reason"), F.lit(None).cast("string").alias("value"))
    rows = read.select(*carry, F.col("p.cik").alias("cik"), F.explode(F.arrays_zip(*[F.col(f"{recent}.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "items")])).alias("z"))
    dated = rows.withColumn("filed", F.try_to_timestamp("z.filingDate", F.lit("yyyy-MM-dd")).cast("date"))
    codes = F.filter(F.transform(F.split(F.coalesce("z.items", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    out = dated.where(F.col("filed").isNotNull()).select(*carry, "cik", F.col("z.accessionNumber").alias("accession"), F.col("z.form").alias("form"), "filed", codes.alias("items"))
    undated = dated.where(F.col("filed").isNull()).select(*carry, F.lit("no date").alias("reason"), F.col("z.filingDate").alias("value"))
    return out, lost.unionByName(undated)


def ownership(payloads: DataFrame, payload: str, carry: list[str]) -> DataFrame:
    """Transactions of ownership documents: (carry, day, insider, position, kind, shares, price, value, planned, indirect); those without a date, and unreadable documents, give no rows."""
    yes = lambda c: F.coalesce(F.lower(F.col(c)).isin("1", "true"), F.lit(False))
    read = payloads.where(F.col(payload).isNotNull()).select(*carry, F.from_xml(payload, OWNERSHIP, {"mode": "PERMISSIVE"}).alias("p"))
    rel = "p.reportingOwner.reportingOwnerRelationship"
    title = F.when(F.trim(F.col(f"{rel}.officerTitle")) != "", F.trim(F.col(f"{rel}.officerTitle")))
    role = F.when(yes(f"{rel}.isDirector"), "Director").when(yes(f"{rel}.isTenPercentOwner"), "10% Owner").when(yes(f"{rel}.isOfficer"), "Officer")
    rows = read.select(
        *carry, F.coalesce("p.reportingOwner.reportingOwnerId.rptOwnerName", F.lit("Unknown")).alias("insider"), F.coalesce(title, role).alias("position"), yes("p.aff10b5One").alias("_plan"),
        F.explode("p.nonDerivativeTable.nonDerivativeTransaction").alias("t"),
    )
    number = lambda c: F.expr(f"try_cast(t.transactionAmounts.{c}.value AS DOUBLE)")
    code = F.upper(F.coalesce("t.transactionCoding.transactionCode", F.lit("")))
    rows = rows.withColumns({"day": F.try_to_timestamp(F.substring("t.transactionDate.value", 1, 10), F.lit("yyyy-MM-dd")).cast("date"), "shares": number("transactionShares"), "price": number("transactionPricePerShare"), "_code": code})
    value = F.when((F.col("shares") != 0) & (F.col("price") != 0), F.round(F.col("shares") * F.col("price"), 2))
    return rows.where(F.col("day").isNotNull()).select(
        *carry, "day", "insider", "position", F.coalesce(F.element_at(_map(CODE_KINDS), F.col("_code")), F.lit("other")).alias("kind"), "shares", "price", value.alias("value"),
        (F.col("_plan") & F.col("_code").isin("S", "P")).alias("planned"), (F.coalesce("t.ownershipNature.directOrIndirectOwnership.value", F.lit("D")) == "I").alias("indirect"),
    )


def posts(payloads: DataFrame, payload: str, symbol: Column, order: str) -> DataFrame:
    """(symbol, id, text, author, url_id, engagement, stance, own, symbols, followers, ts): messages of a board's pages, a message that several pages of a symbol hold once, from the first page by ``order``.

    Payloads are open shapes, read as variants: what is missing or of another type counts as nothing. A
    post is the symbol's own if it names no other, or names it first among at most three; only own
    posts keep their author's stance.
    """
    page = payloads.select(symbol.alias("symbol"), F.col(order).alias("_page"), F.try_parse_json(payload).alias("v"))
    messages = page.select("symbol", "_page", F.posexplode(F.expr("try_variant_get(v, '$.messages', 'array<variant>')")).alias("_k", "m"))
    get = lambda path, kind: F.expr(f"try_variant_get(m, '$.{path}', '{kind}')")
    read = messages.select(
        "symbol", "_page", "_k", get("id", "bigint").alias("id"), F.trim(F.regexp_replace(get("body", "string"), r"\s+", " ")).alias("text"), get("user.username", "string").alias("author"), get("user.followers", "bigint").alias("followers"),
        get("entities.sentiment.basic", "string").alias("_basic"), F.try_to_timestamp(get("created_at", "string")).alias("ts"),
        (F.coalesce(get("likes.total", "bigint"), F.lit(0)) + F.coalesce(get("reshares.reshared_count", "bigint"), F.lit(0)) + F.coalesce(get("conversation.replies", "bigint"), F.lit(0))).alias("engagement"),
        F.transform(F.coalesce(F.expr("try_variant_get(m, '$.symbols', 'array<struct<symbol:string>>')"), F.array().cast("array<struct<symbol:string>>")), lambda s: F.upper(s["symbol"])).alias("_symbols"),
    )
    first = F.upper(F.regexp_replace(F.regexp_extract("text", CASHTAG, 1), r"[.-]+$", ""))
    own = (F.size("_symbols") == 1) & (F.try_element_at("_symbols", F.lit(1)) == F.col("symbol")) | (F.size("_symbols") <= 3) & first.isin(F.col("symbol"), F.regexp_replace("symbol", r"\.X$", ""))
    read = read.where((F.col("text") != "") & F.col("id").isNotNull()).withColumn("own", F.coalesce(own, F.lit(False)))
    stance = F.when(F.col("own") & F.col("_basic").isin("Bullish", "Bearish"), F.lower("_basic"))
    row = F.struct("text", "author", "engagement", stance.alias("stance"), "own", F.size("_symbols").alias("symbols"), F.coalesce("followers", F.lit(0)).alias("followers"), "ts")
    return read.groupBy("symbol", "id").agg(F.min_by(row, F.struct("_page", "_k")).alias("r")).select("symbol", "id", "r.*")


def registry(payloads: DataFrame, payload: str) -> DataFrame:
    """(ticker, cik, title) of registry maps; a ticker's first listing wins, rows without ticker or number are left out."""
    rows = payloads.select(F.posexplode(F.map_entries(F.from_json(payload, REGISTRY))).alias("i", "e")).select("i", "e.value.*")
    ticker, number = F.upper(F.replace("ticker", F.lit("."), F.lit("-"))), F.expr("try_cast(cik_str AS BIGINT)")
    named = rows.select("i", ticker.alias("ticker"), F.lpad(number.cast("string"), 10, "0").alias("cik"), "title").where(F.col("ticker").isNotNull() & F.col("cik").isNotNull())
    return named.groupBy("ticker").agg(F.min_by(F.struct("cik", F.coalesce("title", "ticker").alias("title")), "i").alias("r")).select("ticker", "r.cik", "r.title")


def leaderboard(pages: DataFrame, payload: str, order: str, least_base: int = 5) -> DataFrame:
    """(ticker, rank, name, mentions, upvotes, change_pct) of a paged board: a ticker's first row by page and place, unreadable pages left out; a change only from a base of ``least_base`` mentions, a rank of 0 or less is none."""
    rows = pages.select(F.col(order).alias("_page"), F.posexplode(F.from_json(payload, BOARD)["results"]).alias("_k", "r")).where(F.col("r.ticker").isNotNull())
    one = rows.groupBy(F.upper("r.ticker").alias("ticker")).agg(F.min_by("r", F.struct("_page", "_k")).alias("r"))
    base = F.col("r.mentions_24h_ago")
    change = F.when(base >= least_base, F.round(100.0 * (F.col("r.mentions") - base) / base, 1))
    return one.select("ticker", F.when(F.col("r.rank") > 0, F.col("r.rank")).alias("rank"), F.col("r.name").alias("name"), F.col("r.mentions").alias("mentions"), F.col("r.upvotes").alias("upvotes"), change.alias("change_pct"))
