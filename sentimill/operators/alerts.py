"""Edge-triggered alerts with cooldown and re-arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COOLDOWN_S = 2 * 3600


def crossings(readings: DataFrame, key: str, at: str, tie: str, value: str, threshold: float, above: bool = True) -> DataFrame:
    """(key, tie, at) of readings on which a threshold rule fires, each key's readings taken in order.

    A rule fires where the value holds, the last known value before did not (or there was none), and
    two hours have passed since it last fired. Only such edges can fire, and an edge two hours or more
    after the edge before it always does; so edges are cut into chains at these gaps and only a chain
    is walked. A key's history streams through an ordered window and is never held. Null values neither
    hold nor count as known.
    """
    holds = lambda v: (v >= threshold) if above else (v <= threshold)
    ordered = Window.partitionBy(key).orderBy(at, tie)
    known = F.last(value, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    edges = readings.select(key, at, tie, value, known.alias("_known")).where(holds(F.col(value)) & (F.col("_known").isNull() | ~holds(F.col("_known"))))
    gap = F.col(at) - F.lag(at).over(ordered)
    edges = edges.withColumn("_new", F.when(gap < COOLDOWN_S, 0).otherwise(1))
    chains = edges.withColumn("_chain", F.sum("_new").over(ordered)).groupBy(key, "_chain").agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), F.col(tie).alias("tie")))).alias("e"))

    def step(s: Column, x: Column) -> Column:
        fires = x["at"] - F.element_at(s, -1)["at"] >= COOLDOWN_S
        return F.when(fires, F.concat(s, F.array(x))).otherwise(s)

    fired = F.aggregate(F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0))), F.slice("e", 1, 1), step)
    return chains.select(key, F.explode(fired).alias("f")).select(key, F.col("f.tie").alias(tie), F.col("f.at").alias(at))
