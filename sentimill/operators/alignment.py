"""Joins in time and identity: as-of, nearest, interval, and anti-joins by shared members.

Spark has no as-of join. These carry values along one ordered pass over the union of both sides, or
turn a range condition into an equality on day buckets, so that no pair is formed only to be dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimill.sources.shared import cut

#: Pairs of a one-to-one matching that one task walks.
MATCHING_BLOCK = 100_000


def asof_backward(left: DataFrame, right: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row at or before its ``on``, and where that row stands."""
    cols = left.columns
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_at": F.lit(None).cast(right.schema[on].dataType)})
    b = right.where(F.col(value).isNotNull()).select(
        *[F.col(c) if c in (key, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols],
        F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(on).alias("_at"),
    )
    w = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return a.unionByName(b).withColumns({value: last("_v"), f"{on}_of_{value}": last("_at")}).where(F.col("_side") == 1).drop("_side", "_v", "_at")


def nearest_ago(series: DataFrame, key: str, day: str, value: str, ago: int, slack: int) -> DataFrame:
    """A row per key: its last day, and the value nearest to ``ago`` days before, within ``slack`` days (ties: the later)."""
    last = series.groupBy(key).agg(F.max(day).alias("_last"))
    off = F.abs(F.datediff("_last", day) - ago)
    return (
        series.join(last, key)
        .where(off <= slack)
        .groupBy(key, "_last")
        .agg(F.min_by(F.col(value), F.struct(off, -F.datediff(day, F.lit("1970-01-01")))).alias(value))
        .withColumnRenamed("_last", day)
    )


def within_days(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, before: int, after: int, how: str) -> DataFrame:
    """Semi, anti or inner join on ``keys`` where right_day lies within [left_day - before, left_day + after].

    Days are cut into buckets as wide as the window; a right row is sent to the buckets it can meet,
    at most three, and the join is an equality on keys and bucket with the range checked after it.
    """
    width = before + after + 1
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    r = right.withColumn("_d", number(right_day))
    spread = F.sequence(F.floor((F.col("_d") - after) / width), F.floor((F.col("_d") + before) / width))
    r = r.select(*[F.col(k).alias(f"_{k}") for k in keys], "_d", *[c for c in right.columns if c not in keys and how == "inner"], F.explode(spread).alias("_b"))
    a = left.withColumns({"_l": number(left_day)}).withColumn("_lb", F.floor(F.col("_l") / width))
    near = (F.col("_d") >= F.col("_l") - before) & (F.col("_d") <= F.col("_l") + after) & (F.col("_b") == F.col("_lb"))
    for k in keys:
        near = near & (F.col(k) == F.col(f"_{k}"))
    return a.join(r, near, how).drop("_l", "_lb", "_d", "_b", *[f"_{k}" for k in keys])


def new_by_members(now: DataFrame, before: DataFrame, story: str, member: str, least_share: float = 1 / 3) -> DataFrame:
    """Stories of ``now`` (story, member rows) that share less than ``least_share`` of the smaller side's members with every story before."""
    a, b = now.select(story, member).distinct(), before.select(F.col(story).alias("_old"), member).distinct()
    size_a = a.groupBy(story).agg(F.count(F.lit(1)).alias("_na"))
    size_b = b.groupBy("_old").agg(F.count(F.lit(1)).alias("_nb"))
    shared = a.join(b, member).groupBy(story, "_old").agg(F.count(F.lit(1)).alias("_n")).join(size_a, story).join(size_b, "_old")
    old = shared.where(F.col("_n") >= least_share * F.least("_na", "_nb")).select(story).distinct()
    return size_a.join(old, story, "left_anti").select(story, F.col("_na").alias("members"))


def lag_in_blocks(rows: DataFrame, key: str, block: str, order: list[str], value: str, to: str) -> DataFrame:
    """``rows`` with column ``to``: the ``value`` of the row before in its key's order, where ``block`` never falls along that order.

    A window holds a key's block only; a block's first row takes the last value of the block before,
    from a table of one row a block.
    """
    inside = Window.partitionBy(key, block).orderBy(*order)
    marked = rows.withColumns({"_n": F.row_number().over(inside), "_lag": F.lag(value).over(inside)})
    ends = rows.groupBy(key, block).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    before = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(key).orderBy(block)))
    return marked.join(before, [key, block]).withColumn(to, F.when(F.col("_n") == 1, F.col(f"_end.{value}")).otherwise(F.col("_lag"))).drop("_n", "_lag", "_end")


def member_overlaps(now: DataFrame, before: DataFrame, story: str, member: str, least_share: float = 1 / 3) -> DataFrame:
    """(story, _old, shared, share): pairs of a story now and one before that share ``least_share`` of the smaller one's members or more."""
    a, b = cut(now.select(story, member).where(F.col(member).isNotNull()).distinct()), cut(before.select(F.col(story).alias("_old"), member).where(F.col(member).isNotNull()).distinct())
    size_a = a.groupBy(story).agg(F.count(F.lit(1)).alias("_na"))
    size_b = b.groupBy("_old").agg(F.count(F.lit(1)).alias("_nb"))
    shared = a.join(b, member).groupBy(story, "_old").agg(F.count(F.lit(1)).alias("shared"))
    pairs = shared.join(size_a, story).join(size_b, "_old").withColumn("share", F.col("shared") / F.least("_na", "_nb"))
    return pairs.where(F.col("share") >= least_share).select(story, "_old", "shared", "share")


def one_to_one(pairs: DataFrame, a: str, b: str, strength: str, block: int = MATCHING_BLOCK) -> DataFrame:
    """Pairs of a one-to-one matching: the strongest pair first, then the strongest of what is left; ties by the smaller ``a``, then ``b``.

    The walk over all pairs in order is made by rounds. One task walks the first ``block`` pairs in order,
    which decides all of them; those are all pairs in most cases. Where more are left, a pair that is the
    best of both its ends is in the matching whatever else is, and what touches a matched pair is not. So
    every round decides ``block`` pairs at least, also where ties make each pair wait for the one before it.
    """
    order = F.struct(-F.col(strength), F.col(a), F.col(b))
    left = cut(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(strength).isNotNull()).select(a, b, strength).withColumn("_o", order).groupBy(a, b).agg(F.min("_o").alias("_o")))
    kind = left.select(a, b, "_o").schema

    def walk(batches):
        used_a, used_b = set(), set()
        for batch in batches:
            free = []
            for i, (x, y) in enumerate(zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)):
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    free.append(i)
            yield batch.take(pa.array(free, pa.int64()))

    done = None
    while True:
        n = left.count()
        first = left.select(a, b, "_o")
        first = first.coalesce(1).sortWithinPartitions("_o") if n <= block else first.orderBy("_o").limit(block).coalesce(1).sortWithinPartitions("_o")
        taken = first.mapInArrow(walk, kind)  # at most ``block`` rows in the task
        if n > block:
            taken = cut(taken)
            left = cut(_untouched(left, taken, a, b))
            best_a = left.groupBy(a).agg(F.min("_o").alias("_a"))
            best_b = left.groupBy(b).agg(F.min("_o").alias("_b"))
            best = cut(left.join(best_a, a).join(best_b, b).where((F.col("_o") == F.col("_a")) & (F.col("_o") == F.col("_b"))).select(a, b, "_o"))
            left = cut(_untouched(left, best, a, b))
            taken = taken.unionByName(best)
        found = taken.select(a, b, (-F.col("_o.col1")).alias(strength))
        done = found if done is None else done.unionByName(found)
        if n <= block:
            return done


def _untouched(left: DataFrame, taken: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs neither end of which is taken."""
    return left.join(taken.select(a), a, "left_anti").join(taken.select(b), b, "left_anti")


def story_identity(now: DataFrame, before: DataFrame, story: str, member: str, headlines: tuple[DataFrame, DataFrame] | None = None, tone_gap: float = 0.15, least_share: float = 1 / 3) -> DataFrame:
    """(story, old, by, share): which story before each story is, at most one on either side; stories without one are left out.

    Shared members decide first. A story that no members match may be the one of the same headline form
    (``headlines``: (story, form, tone) of both sides), unless their tones are opposite by ``tone_gap`` each.
    """
    by_members = cut(one_to_one(member_overlaps(now, before, story, member, least_share), story, "_old", "share").withColumn("by", F.lit("members")))
    if headlines is None:
        return by_members.select(story, F.col("_old").alias("old"), "by", "share")
    new, old = headlines[0].where(F.col("form") != ""), headlines[1].where(F.col("form") != "").select(F.col(story).alias("_old"), "form", F.col("tone").alias("_tone"))
    new, old = new.join(by_members, story, "left_anti"), old.join(by_members, "_old", "left_anti")
    # of one form's stories the n-th on either side belong together, so no form's pairs are all made
    place = lambda d, c, t: d.withColumns({"_side": F.when(F.col(t) <= -tone_gap, -1).when(F.col(t) >= tone_gap, 1).otherwise(0)}).withColumn("_k", F.row_number().over(Window.partitionBy("form", "_side").orderBy(c)))
    n, o = place(new.select(story, "form", F.coalesce("tone", F.lit(0.0)).alias("tone")), story, "tone"), place(old.withColumn("_tone", F.coalesce("_tone", F.lit(0.0))), "_old", "_tone").withColumnRenamed("_side", "_other")
    near = n.join(o, ["form", "_k"]).where(F.col("_side") * F.col("_other") >= 0).withColumn("share", F.when(F.col("_side") == F.col("_other"), 1.0).otherwise(0.5))
    by_form = one_to_one(near, story, "_old", "share").withColumn("by", F.lit("headline"))
    return by_members.unionByName(by_form).select(story, F.col("_old").alias("old"), "by", "share")
