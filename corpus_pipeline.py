"""From raw documents to token ids, in five stages that each write Parquet and read it again.

Toxic documents go, low-quality documents go, one document of each group of near copies stays,
documents that leak benchmark passages go, and what is left is encoded. Each stage works on all that
the one before kept. Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimill.llm import byte_bpe, decontaminate, line_quality, near_copies, toxicity
from sentimill.llm.arrow import fresh
from sentimill.sources import table
from sentimill.sources.shared import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the machine learnt from the labelled documents among these."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    p = fresh(docs, "_toxic")
    return toxicity.score(docs, model, p, keep=True).where(F.col(p) < 0.5).select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least 0.5 by the random field learnt from the labelled documents among these."""
    model = line_quality.train(docs, table(spark, sf_dir, "labels"))
    p = fresh(docs, "_good")
    return line_quality.score(docs, model, p, keep=True).where(F.col(p) >= 0.5).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies (five-word shingles of Jaccard 0.8 or more); rows without an id are kept, as nothing names them.

    Where rows share an id, one is as much a copy of the other as any; the rows of a kept id stay.
    """
    groups = near_copies.near_copies(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    n = fresh(docs, "_leaks")
    return decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), n).where(F.col(n) == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the digest of what decoding gives back."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("encoding", encode),
]

#: The models and the edit search are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
