"""Bounded samples of labelled rows, for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimill.llm.arrow import crc_bucket

#: Pieces, spread evenly over the whole text, that a longer labelled text is learnt from, and their characters.
PIECES, PIECE_CHARS = 12, 1000


def excerpt(text: Column, pieces: int = PIECES, size: int = PIECE_CHARS) -> Column:
    """A text of at most ``pieces * size`` characters as it is; of a longer one, that many pieces from its start to its end, a line break between them.

    It bounds what a training row brings to the driver, and leaves no row out for its length. Scores are of whole texts.
    """
    n = F.length(text)
    step = (n - size) / F.lit(float(pieces - 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(n <= pieces * size, text).otherwise(F.array_join(spread, "\n"))


def sample_labels(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(doc_id, y): up to ``per_class`` labelled ids of each class outside the held-out fold.

    Ids are drawn by a hash, so the sample doesn't follow the table's layout, and the sort that cuts
    it to size sees a bounded number of rows. A document with several labels counts as its largest;
    rows with null id or label are left out.
    """
    h = F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 30))
    ids = (
        labels.where(F.col(label).isin(*classes) & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("h", h)
    )
    counts = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    out = None
    for c in classes:
        share = min(1.0, (1.5 * per_class + 20) / max(1, counts.get(c, 0)))
        part = ids.where((F.col("y") == c) & (F.col("h") < int(share * (1 << 30)) + 1)).orderBy("h", "doc_id").limit(per_class)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "y")


def sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text) of sampled ids, one text an id; the ids are few by construction and go to the scan, not the texts to a shuffle."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def sample_texts(docs: DataFrame, ids: DataFrame) -> list[tuple[str, int]]:
    """The (text, y) of sampled ids in id order, long texts by ``excerpt``."""
    rows = sampled(docs, ids).select("doc_id", "y", excerpt(F.col("text")).alias("text")).orderBy("doc_id").collect()
    return [(r["text"], r["y"]) for r in rows]
