"""Operators over event facts: ratings, insider trades, earnings, boards, metrics and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(series: dict[str, DataFrame], key: str, day: str = "d") -> DataFrame:
    """Several daily series full-joined on key and day, a column each.

    One union and one aggregate in place of a chain of outer joins: each series is shuffled once.
    """
    names = list(series)
    parts = [
        df.select(key, day, *[(F.col("value") if n == m else F.lit(None)).cast("double").alias(m) for m in names]) for n, df in series.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, day).agg(*[F.max(m).alias(m) for m in names])


def first_known(metrics: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first known value of every key by source order, and which source gave it."""
    known = metrics.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def most_quoted(facts: DataFrame, key: str, amount: str) -> DataFrame:
    """The amount that a key quotes most often; of equally frequent ones the largest."""
    n = facts.where(F.col(amount).isNotNull()).groupBy(key, amount).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max(F.struct("n", amount)).alias("z")).select(key, f"z.{amount}", "z.n")


def same_day_plans(trades: DataFrame, insider: str, day: str, price: str, least: int = 3) -> DataFrame:
    """Trades of a day and price at which at least ``least`` insiders traded: purchases by plan. By an aggregate joined back."""
    groups = trades.groupBy(day, price).agg(F.count_distinct(insider).alias("insiders")).where(F.col("insiders") >= least)
    return trades.join(groups, [day, price])


def board_ranks(board: DataFrame, key: str, name: str, n: str, least_board: int, least_row: int) -> DataFrame:
    """Ranks on a board (ties by name), known only where the board has ``least_board`` comments and the row ``least_row``."""
    totals = board.groupBy(key).agg(F.sum(n).alias("board_total"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(n), name))
    ranked = board.withColumn("_rank", rank).join(totals, key)
    return ranked.withColumn("rank", F.when((F.col("board_total") >= least_board) & (F.col(n) >= least_row), F.col("_rank"))).drop("_rank")


def top_insights(insights: DataFrame, key: str, title: str, severity: str, priority: str, most: int = 8) -> DataFrame:
    """The worst ``most`` insights of a key, one a title: by severity, then priority, then title."""
    first = insights.groupBy(key, title).agg(F.max(F.struct(severity, priority)).alias("z")).select(key, title, f"z.{severity}", f"z.{priority}")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(severity), F.desc(priority), title))
    return first.withColumn("place", place).where(F.col("place") <= most)


def search_rank(name: Column, text: str) -> Column:
    """0 for the very name, 1 where it starts with the text, 2 where a word of it does, else null."""
    low, q = F.lower(name), text.lower()
    return F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).when(F.contains(F.concat(F.lit(" "), low), F.lit(" " + q)), 2)


def backoff(failures: Column, interval_s: int, most_s: int = 86_400) -> Column:
    """Seconds to wait after so many failures in a row: doubling, a day at most; 0 without failures."""
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(float(most_s)), interval_s * F.pow(F.lit(2.0), failures - 1))).cast("long")


def money(x: Column) -> Column:
    """$1.37B style: three significant steps from thousands to trillions."""
    a = F.abs(x)
    sign = F.when(x < 0, "-").otherwise("")
    part = lambda d, unit: F.concat(sign, F.lit("$"), F.format_number(a / d, "0.00"), F.lit(unit))
    return F.when(a >= 1e12, part(1e12, "T")).when(a >= 1e9, part(1e9, "B")).when(a >= 1e6, part(1e6, "M")).when(a >= 1e3, part(1e3, "K")).otherwise(part(1.0, ""))
