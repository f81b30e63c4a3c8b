"""Connected components over a distributed edge table, and joins that stand one hot key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimill.sources.shared import cut

#: A key that holds at least this share of the rows counts as hot; there are at most 1 / HOT_SHARE of them, which bounds what is broadcast.
HOT_SHARE = 1 / 500
#: Fewer rows than this of one key aren't hot, whatever their share.
LEAST_HOT = 1000
#: Edges that one task joins to trees; more edges are dealt over more tasks.
BLOCK = 250_000


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, by ``key``; ``left`` is read three times, so give it cut.

    The rows of hot keys never meet in one task: their few right rows are broadcast, and only the
    other keys, each below HOT_SHARE of the rows, are shuffled. Null keys match nothing.
    """
    total = left.count()
    if total < LEAST_HOT:
        return left.join(right, key, how)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= max(LEAST_HOT, total * HOT_SHARE)).select(key)
    hot_keys = [r[0] for r in hot.collect()]  # at most 1 / HOT_SHARE keys
    if not hot_keys:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot_keys), F.lit(False))
    return (
        left.where(is_hot)
        .join(F.broadcast(right.where(F.col(key).isin(hot_keys))), key, how)
        .unionByName(left.where(~is_hot).join(right.where(~F.col(key).isin(hot_keys)), key, how))
    )


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest one that the links between ``a`` and ``b`` lead to."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(further := label[label], label):
            label = further
    return label


def _contracted(pairs: DataFrame, blocks: int) -> DataFrame:
    """The edges dealt by their hash into ``blocks`` tasks, each of which gives its trees as stars on their smallest nodes: what was joined stays joined, by as many edges or fewer."""

    def task(batches):
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        u, v = (pa.concat_arrays([x.column(name) for x in held]) for name in ("u", "v"))
        nodes = pc.unique(pa.concat_arrays([u, v]))
        nodes = nodes.take(pc.sort_indices(nodes))
        label = least_labels(len(nodes), pc.index_in(u, nodes).to_numpy(), pc.index_in(v, nodes).to_numpy())
        hung = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(hung)), nodes.take(pa.array(label[hung]))], names=["u", "v"])

    # one block is one task whatever partitions the session deals keys to: several would leave trees apart
    dealt = pairs.coalesce(1) if blocks == 1 else pairs.repartition(blocks, "u", "v")
    return dealt.mapInArrow(task, pairs.schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40, block: int = BLOCK) -> DataFrame:
    """(node, root): the smallest node id reachable from every node that has an edge.

    Edges are first joined to stars in blocks of a fixed number of edges; where one block holds all
    of them, these are the components. What several blocks leave goes through alternating stars: every
    node's larger neighbours are hung on the smallest node it sees, then the smaller ones with it,
    until nothing moves or the edges left fit a block; the number of rounds is logarithmic in the longest
    path. Each round's edges are cut to checkpoint files. Rounds beyond
    ``most_rounds`` (2^40 links in a path need no more) are an error, never a part of the answer. A hub's links are split by ``join_unique``.
    """
    pairs = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = _mark(pairs)
    if before[0] > block:
        pairs = cut(_contracted(pairs, -(-before[0] // block)).distinct())
        before = _mark(pairs)
    for _ in range(most_rounds):
        if before[0] <= block:
            pairs = cut(_contracted(pairs, 1))
            break
        both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(join_unique(both, least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = join_unique(large, least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: links still move after {most_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them; stars that no longer move keep both."""
    r = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)
