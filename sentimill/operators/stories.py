"""Story clusters of headlines: TF-IDF vectors, exact average-link agglomeration within a key's window, at any size.

Average link is reducible: merging two clusters never brings a third one nearer to them than it was to
either. So pairs that are each other's nearest can all be merged at once, and rounds of that end where
merging the one nearest pair at a time does. A small window's rounds are matrix products in one task;
a larger one's are joins on terms, with no window in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimill.operators.texts import content_words
from sentimill.sources.shared import cut

#: Average cosine from which clusters merge; background documents behind the idf; weight of words that one headline has.
THRESHOLD, BACKGROUND, SINGLETON = 0.08, 10, 0.3
#: Headlines of a window up to which one task clusters it (its matrix is their square).
DENSE_MOST = 1000
#: Digits that average cosines are compared to, so that equal ones are equal however they were summed.
DIGITS = 12


def cluster_vectors(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of average-link agglomeration over unit rows; the label is the smallest row of the cluster, ties go to the smallest rows."""
    label, at, sums, sizes = np.arange(len(x)), np.arange(len(x)), x.copy(), np.ones(len(x))
    while len(at) > 1:
        mean = sums / sizes[:, None]
        sim = np.round(mean @ mean.T, DIGITS)
        np.fill_diagonal(sim, -1)
        best = sim.argmax(axis=1)
        i = np.flatnonzero((best[best] == np.arange(len(at))) & (np.arange(len(at)) < best) & (sim[np.arange(len(at)), best] >= threshold))
        if not len(i):
            break
        j = best[i]
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        into = np.arange(len(x))
        into[at[j]] = at[i]
        label = into[label]
        keep = np.setdiff1d(np.arange(len(at)), j)
        at, sums, sizes = at[keep], sums[keep], sizes[keep]
    return label


def story_clusters(items: DataFrame, key: str, window: str, item: str, text: str, dense_most: int = DENSE_MOST) -> DataFrame:
    """(key, window, item, story) for every item, the story named by its smallest item.

    ``dense_most`` says only where a window's rounds run, not what they give. Headlines without content
    words, key or window are stories of their own.
    """
    placed = F.col(key).isNotNull() & F.col(window).isNotNull()
    rows = items.where(placed).select(key, window, item, content_words(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    alone = items.where(~placed).select(key, window, item, F.col(item).alias("story"))
    size = rows.groupBy(key, window).agg(F.count(F.lit(1)).alias("_size"))
    large = [tuple(r) for r in size.where(F.col("_size") > dense_most).select(key, window).limit(1).collect()]
    if not large:
        return _in_tasks(rows, key, window, item).unionByName(alone)
    sized = cut(rows.join(size, [key, window]))
    small = _in_tasks(sized.where(F.col("_size") <= dense_most).drop("_size"), key, window, item)
    return small.unionByName(_by_joins(sized.where(F.col("_size") > dense_most), key, window, item)).unionByName(alone)


def _in_tasks(rows: DataFrame, key: str, window: str, item: str) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{key}` {kind[key]}, `{window}` {kind[window]}, `{item}` {kind[item]}, story {kind[item]}"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable").reset_index(drop=True)
        vocabulary: dict[str, int] = {}
        at = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms] for terms in pdf["terms"]]
        x = np.zeros((len(pdf), len(vocabulary)))
        for i, ks in enumerate(at):
            x[i, ks] = 1
        df = x.sum(axis=0)
        x *= np.log((len(pdf) + BACKGROUND) / (df + 1)) * np.where(df == 1, SINGLETON, 1.0)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({key: pdf[key], window: pdf[window], item: pdf[item], "story": pdf[item].to_numpy()[cluster_vectors(x, THRESHOLD)]})

    return rows.groupBy(key, window).applyInPandas(one, schema)


def _by_joins(rows: DataFrame, key: str, window: str, item: str) -> DataFrame:
    """The same rounds over tables: mean vectors meet on their terms, nearest clusters that agree merge, sums are added up."""
    g = [key, window]
    terms = cut(rows.select(*g, F.col(item).alias("c"), F.col("_size").alias("n"), F.explode("terms").alias("t")))
    df = terms.groupBy(*g, "t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((F.col("n") + BACKGROUND) / (F.col("df") + 1)) * F.when(F.col("df") == 1, SINGLETON).otherwise(1.0)
    weighed = cut(terms.join(df, [*g, "t"]).select(*g, "c", "t", "df", weight.alias("x")))
    norm = weighed.groupBy(*g, "c").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-12)).alias("norm"))
    # what one headline alone has adds to its norm and to no product
    sums = cut(weighed.join(norm, [*g, "c"]).where("df > 1").select(*g, "c", "t", (F.col("x") / F.col("norm")).alias("s")))
    labels = cut(rows.select(*g, item, F.col(item).alias("c")))
    while True:
        sizes = labels.groupBy(*g, "c").agg(F.count(F.lit(1)).alias("n"))
        mean = cut(sums.join(sizes, [*g, "c"]).select(*g, "c", "t", (F.col("s") / F.col("n")).alias("m")))
        other = mean.select(*g, F.col("c").alias("d"), "t", F.col("m").alias("o"))
        sims = mean.join(other, [*g, "t"]).where(F.col("c") < F.col("d")).groupBy(*g, "c", "d").agg(F.round(F.sum(F.col("m") * F.col("o")), DIGITS).alias("sim"))
        sims = cut(sims.where(F.col("sim") >= THRESHOLD))
        ends = sims.select(*g, "c", "d", "sim").unionByName(sims.select(*g, F.col("d").alias("c"), F.col("c").alias("d"), "sim"))
        best = cut(ends.groupBy(*g, "c").agg(F.min_by("d", F.struct(-F.col("sim"), F.col("d"))).alias("d")))
        agreed = best.where(F.col("c") < F.col("d")).join(best.select(*g, F.col("c").alias("d"), F.col("d").alias("c")), [*g, "c", "d"], "left_semi")
        into = cut(agreed.select(*g, F.col("d").alias("c"), F.col("c").alias("_into")))
        if into.isEmpty():
            return labels.select(*g, item, F.col("c").alias("story"))
        moved = lambda t: t.join(into, [*g, "c"], "left").withColumn("c", F.coalesce("_into", "c")).drop("_into")  # noqa: E731, B023
        labels = cut(moved(labels))
        sums = cut(moved(sums).groupBy(*g, "c", "t").agg(F.sum("s").alias("s")))
