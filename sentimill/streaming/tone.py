"""Streaming forms: tone per window with a watermark, de-duplicated input, and edge-triggered alerts.

Event time must be a timestamp with zone; files often hold one without, so readers cast it first.
State is bounded by the watermark, or by one small row a key for alerts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sentimill.operators.aggregates import weighted_mean
from sentimill.operators.alerts import COOLDOWN_S

#: How long a rule rests where the value before is unknown.
REARM_S = 7 * 86400


def landed(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land in a folder, with ``ts`` as a timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tone_windows(items: DataFrame, key: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Weighted tone and count per key and tumbling window; items later than ``late`` are left out, a window is final once passed."""
    w = F.window("ts", width)
    return (
        items.withWatermark("ts", late)
        .groupBy(key, w.alias("w"))
        .agg(weighted_mean(F.col("score"), F.col("weight")).alias("tone"), F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("bucket"), "tone", "n")
    )


def once_each(items: DataFrame, ids: list[str], late: str = "1 hour") -> DataFrame:
    """Each id once, for copies that land within the watermark of each other."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(ids)


def superseding(answers: DataFrame, key: str, run: str, source: str, keep_s: int = 7200) -> DataFrame:
    """(key, run, version, sources, tone) whenever an answer changes a run: late answers reopen only their own run and supersede what it gave.

    ``answers`` are (key, run, source, ts, score, weight). A source's newest answer counts (by ``ts``, then
    the larger score and weight), so the last version of a run hangs on its answers and not on the order in
    which they arrive. A run's state goes ``keep_s`` seconds after the watermark has passed its last answer; what is
    later than that is left out, as the watermark leaves it out of any window.
    """
    kinds = {c: answers.schema[c].dataType.simpleString() for c in (key, run, source)}
    out = f"`{key}` {kinds[key]}, `{run}` {kinds[run]}, version int, sources int, tone double"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, last, held = state.get if state.exists else (0, 0, [])
        best = {s: (t, x, w) for s, t, x, w in held}
        before = dict(best)
        for rows in batches:
            for s, t, x, w in zip(rows["_source"].tolist(), rows["_t"].tolist(), rows["score"].tolist(), rows["weight"].tolist(), strict=True):
                if x == x and w == w and w > 0 and (s not in best or (t, x, w) > best[s]):
                    best[s] = (t, x, w)
                last = max(last, t)
        changed = best != before
        state.update((version + changed, last, [(s, *v) for s, v in sorted(best.items())]))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1 + 1000 * keep_s)
        if changed:
            total = sum(w for _, _, w in best.values())
            yield pd.DataFrame({key: [k[0]], run: [k[1]], "version": [version + 1], "sources": [len(best)], "tone": [sum(x * w for _, x, w in best.values()) / total]})

    timed = answers.withWatermark("ts", f"{keep_s} seconds").select(key, run, "ts", F.col(source).cast("string").alias("_source"), F.unix_millis("ts").alias("_t"), F.col("score").cast("double").alias("score"), F.col("weight").cast("double").alias("weight"))
    held = "version int, last long, held array<struct<source:string,t:long,score:double,weight:double>>"
    return timed.groupBy(key, run).applyInPandasWithState(fold, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def crossings(readings: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """(key, s) of readings on which the threshold rule fires, over micro-batches: the rule of ``operators.alerts`` with its state kept.

    A key's readings within a micro-batch are taken by their time. The state is the time the rule last
    fired and the last known value.
    """
    out = f"{key} {readings.schema[key].dataType.simpleString()}, s long"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, prev = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("s", kind="stable")
        fired = []
        for s, v in zip(rows["s"].tolist(), rows[value].tolist(), strict=True):
            if v is None or v != v:
                continue
            edge = last is None or (s - last > REARM_S if prev is None else prev < threshold)
            if v >= threshold and edge and (last is None or s - last >= COOLDOWN_S):
                fired.append(s)
                last = s
            prev = v
        state.update((last, prev))
        yield pd.DataFrame({key: [k[0]] * len(fired), "s": fired})

    timed = readings.select(key, F.unix_seconds("ts").alias("s"), F.col(value).cast("double").alias(value))
    return timed.groupBy(key).applyInPandasWithState(fold, out, "last long, prev double", "append", GroupStateTimeout.NoTimeout)
