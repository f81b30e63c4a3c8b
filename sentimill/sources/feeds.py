"""Landed provider payloads as raw signals: RSS in XML, keyed JSON, price CSV, and the sinks beside them.

Every reader declares its schema. What a provider calls a field is mapped to one signal shape, so the
operators downstream know no provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = ["source", "title", "body", "url", "author", "publisher", "ts", "engagement"]
RSS = "title STRING, link STRING, guid STRING, pubDate STRING, description STRING, source STRING"
NEWS = "uuid STRING, title STRING, publisher STRING, link STRING, providerPublishTime BIGINT, relatedTickers ARRAY<STRING>"
STORIES = "hits ARRAY<STRUCT<author STRING, created_at_i BIGINT, num_comments INT, objectID STRING, points INT, title STRING, url STRING>>"
BARS = "Datetime TIMESTAMP, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, `Adj Close` DOUBLE, Volume BIGINT"
TIMELINE = "timeline ARRAY<STRUCT<series STRING, data ARRAY<STRUCT<date STRING, value DOUBLE>>>>"


def rss_time(text: Column) -> Column:
    """'Tue, 01 Oct 2026 12:00:00 GMT' as a timestamp; the weekday is cut, as it says nothing and no pattern takes it."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*|\s*(GMT|UTC|\+0000)$", ""), F.lit("d MMM yyyy HH:mm:ss"))


def without_outlet(title: Column, publisher: Column) -> Column:
    """A headline without the ' - Outlet' that feeds append, where it names the publisher."""
    tail = F.concat(F.lit(" - "), publisher)
    return F.when(F.endswith(title, tail), F.substring(title, F.lit(1), F.length(title) - F.length(tail))).otherwise(title)


def unwrapped(link: Column) -> Column:
    """The address behind a redirect link that carries it in its ``url`` parameter."""
    inner = F.try_parse_url(link, F.lit("QUERY"), F.lit("url"))
    return F.coalesce(F.try_url_decode(inner), link)


def _signals(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    kinds = {"ts": "timestamp", "engagement": "int"}
    return df.select(F.lit(source).alias("source"), *[columns.get(c, empty).cast(kinds.get(c, "string")).alias(c) for c in SIGNAL[1:]])


def rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of RSS files; those without a title are dropped."""
    x = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path).where(F.trim("title") != "")
    return _signals(x, source, title=without_outlet(F.col("title"), F.col("source")), body=F.col("description"), url=unwrapped(F.col("link")), publisher=F.col("source"), ts=rss_time(F.col("pubDate")))


def keyed_news(spark: SparkSession, path: str, source: str, symbol: str | None = None) -> DataFrame:
    """Rows of keyed news JSON, of one symbol where given; rows without tags are kept."""
    x = spark.read.schema(NEWS).option("multiLine", True).json(path)
    if symbol:
        x = x.where(F.col("relatedTickers").isNull() | F.array_contains("relatedTickers", symbol))
    return _signals(x, source, title=F.col("title"), url=F.col("link"), publisher=F.col("publisher"), ts=F.timestamp_seconds("providerPublishTime"))


def discussion(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Stories of a discussion board's search; points and comments are engagement."""
    x = spark.read.schema(STORIES).option("multiLine", True).json(path).select(F.explode("hits").alias("h")).select("h.*")
    n = F.coalesce("points", F.lit(0)) + F.coalesce("num_comments", F.lit(0))
    return _signals(x, source, title=F.col("title"), url=F.col("url"), author=F.col("author"), ts=F.timestamp_seconds("created_at_i"), engagement=F.greatest(n, F.lit(0)))


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Price bars of CSV files as (t, o, h, l, c, v); rows without a close are dropped."""
    x = spark.read.schema(BARS).option("header", True).csv(path).where(F.col("Close").isNotNull())
    return x.select(F.col("Datetime").alias("t"), F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"), F.col("Close").alias("c"), F.col("Volume").cast("double").alias("v"))


def tone_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(d, series, value) of a news-tone timeline, several points of a day averaged."""
    x = spark.read.schema(TIMELINE).option("multiLine", True).json(path).select(F.explode("timeline").alias("t")).select("t.series", F.explode("t.data").alias("p"))
    return x.groupBy(F.to_date(F.substring("p.date", 1, 8), "yyyyMMdd").alias("d"), "series").agg(F.avg("p.value").alias("value"))


def union_signals(*feeds: DataFrame) -> DataFrame:
    """All feeds' signals in one table."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


def write_snapshots(df: DataFrame, path: str) -> None:
    """Run history as Parquet, a folder a ticker; appended, never rewritten."""
    df.write.mode("append").partitionBy("ticker").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with header; formula signs at the start of a text cell are quoted, so no sheet runs them."""
    safe = [F.when(F.col(f.name).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(f.name))).otherwise(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
