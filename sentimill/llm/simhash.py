"""Near duplicates by SimHash: fingerprints, a binary trie joined with itself, connected components.

The join. Fingerprints are 64 bits, cut into five blocks. If two differ in at most four bits, then for
one of the five rotations of the blocks the first block differs in no bit, the first two together in
at most one, the first three in at most two, and so on (the cycle lemma, applied to the differing
bits less 4/5 a block). So each fingerprint is sent once under each rotation's first block; those
that share it form the trie below that block, and pairs of trie nodes are walked down together, their
differing bits added up, and a pair of nodes is dropped once it is over the error budget of its depth.

Bounds. A block value that holds many fingerprints is split one trie level after another: by the next
bits, again within budget, so that no task grows with a hot block. Within a task only a spanning
forest of the links leaves; a pair of nodes whose fingerprints are all in one tree already is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentimill.llm.arrow import slices
from sentimill.operators.components import components, join_unique
from sentimill.sources.shared import cut

WORDS = 4
SEED = 42
MOST_BITS = 4
#: Bits of the blocks, from the highest bit down.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints under one trie node that a task walks; fuller nodes are split by further bits, at most SPLIT_BITS of the second block.
NODE_ROWS, SPLIT_BITS = 4096, 12
#: Node pairs walked at a time.
FRONTIER = 400_000


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words.

    ASCII letters are lowered, words are what white space (blank, tab to carriage return) leaves.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total, counts = len(words) - WORDS + 1, np.zeros(64, np.int64)
    for i in range(0, total, 65_536):
        j = min(total, i + 65_536)
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i:j].tolist(), ends[i + WORDS - 1 : j + WORDS - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed long. A map over the rows; null texts count as empty."""

    def task(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(task, f"doc_id {kind}, fp long")


def _rotations(fp: str):
    """Columns of the five rotations: (rotation, its bits as a long with the first block on top)."""
    out, shift = [], 0
    for k, size in enumerate(BLOCKS):
        x = F.col(fp)
        turned = x if shift == 0 else F.shiftleft(x, shift).bitwiseOR(F.shiftrightunsigned(x, 64 - shift))
        out.append(F.struct(F.lit(k).alias("rotation"), turned.alias("bits")))
        shift += size
    return out


def turned_blocks(rotation: int) -> tuple[int, ...]:
    return BLOCKS[rotation:] + BLOCKS[:rotation]


class _Forest:
    """Trees over positions 0..n-1 as labels; labels of linked positions are joined, smaller label wins."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                return
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while True:  # labels point at smaller labels: follow them to the end
                further = to[to]
                if np.array_equal(further, to):
                    break
                to = further
            self.label = to[self.label]

    def uniform(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For intervals [lo, hi): whether one tree holds the whole of each; its label is that of lo."""
        changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return changes[hi - 1] == changes[lo]


def walk(keys: np.ndarray, start: list[tuple[int, int, int, int, int]], depth: int, budget: np.ndarray, frontier: int = FRONTIER) -> np.ndarray:
    """Labels that join every two positions of the sorted 64-bit ``keys`` whose nodes' pairs stay within budget to the last bit.

    ``start`` has node pairs (lo, hi, lo', hi', bits that differ so far) at ``depth``; equal nodes stand for the pairs within one node.
    """
    forest = _Forest(len(keys))
    stack = [(depth, np.array(start, np.int64).reshape(-1, 5))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > frontier:
            for i in range(0, len(pairs), frontier):
                stack.append((depth, pairs[i : i + frontier]))
            continue
        while len(pairs):
            lo, hi, lo2, hi2, d = pairs.T
            single = (hi - lo == 1) & (hi2 - lo2 == 1)
            if single.any():  # two fingerprints: count what is left at once, under the budgets of all depths
                at = np.flatnonzero(single & (lo != lo2))
                ok = _within(keys[lo[at]] ^ keys[lo2[at]], budget)
                forest.link(lo[at[ok]], lo2[at[ok]])
                pairs = pairs[~single]
                continue
            whole = forest.uniform(lo, hi) & forest.uniform(lo2, hi2) & (forest.label[lo] == forest.label[lo2])
            if whole.any():
                pairs = pairs[~whole]
                continue
            if depth == 64:  # equal keys in different positions
                forest.link(lo, lo2)
                break
            if len(pairs) > frontier:
                stack.append((depth, pairs))
                break
            ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
            mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
            same = lo == lo2
            new = [
                np.stack([lo, mid, lo2, mid2, d], axis=1),
                np.stack([mid, hi, mid2, hi2, d], axis=1),
                np.stack([lo, mid, mid2, hi2, d + 1], axis=1),
                np.stack([mid, hi, lo2, mid2, d + 1], axis=1)[~same],
            ]
            pairs = np.concatenate(new)
            depth += 1
            pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget[depth])]
    return forest.label


def _within(x: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Whether the differing bits ``x`` keep within budget at the end of every block."""
    ok = np.ones(len(x), bool)
    for depth in np.flatnonzero(np.diff(budget, append=MOST_BITS + 1)):
        ok &= np.bitwise_count(x >> np.uint64(64 - depth)) <= budget[depth] if depth else True
    return ok & (np.bitwise_count(x) <= MOST_BITS)


def budget_of(rotation: int) -> np.ndarray:
    """The error budget at each depth: after the l-th block 4 l / 5, rounded down; inside a block, that of its end."""
    out, depth = np.zeros(65, np.int64), 0
    for k, size in enumerate(turned_blocks(rotation)):
        out[depth + 1 : depth + size + 1] = MOST_BITS * (k + 1) // len(BLOCKS)
        depth += size
    return out


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprint pairs whose connected components are those of all pairs at MOST_BITS or fewer differing bits.

    ``distinct`` has one row per fingerprint in ``fp`` and is read twice, so give it cut.
    """
    turned = distinct.select("fp", F.explode(F.array(*_rotations("fp"))).alias("r")).select("fp", "r.*")
    block, below = F.lit(None), F.lit(None)
    for k in range(len(BLOCKS)):
        top = turned_blocks(k)[0]
        block = F.when(F.col("rotation") == k, F.shiftrightunsigned("bits", 64 - top)).otherwise(block)
        below = F.when(F.col("rotation") == k, F.shiftrightunsigned(F.shiftleft("bits", top), 1)).otherwise(below)
    turned = turned.withColumns({"block": block, "below": below})
    # at most 5 x 2^13 rows, whatever the input
    depth = F.greatest(F.lit(0), F.least(F.lit(SPLIT_BITS), F.ceil(F.log2(F.col("count") / NODE_ROWS))))
    full = turned.groupBy("rotation", "block").count().where(F.col("count") > 1).select("rotation", "block", depth.cast("int").alias("split"))
    rows = turned.join(F.broadcast(full), ["rotation", "block"])
    # a split node's fingerprints go to the trie node of their next bits, and to the pairs with each node one bit off
    sub = F.when(F.col("split") > 0, F.expr("shiftrightunsigned(below, 63 - split)")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("sub", sub)
    own = F.array(F.struct(F.col("sub").alias("node"), F.lit(-1).alias("bit"), F.lit(0).alias("side")))
    others = F.expr("transform(sequence(0, split - 1), i -> struct(sub & ~shiftleft(1L, i) as node, i as bit, int(shiftright(sub, i) & 1L) as side))")
    rows = rows.select(
        "fp", "rotation", "bits", "block", "split", F.explode(F.when(F.col("split") > 0, F.concat(own, others)).otherwise(own)).alias("n")
    ).select("fp", "rotation", "bits", "block", "split", "n.*")
    dealt = rows.repartition("rotation", "block", "node", "bit").sortWithinPartitions("rotation", "block", "node", "bit", "bits")
    names = ["rotation", "block", "node", "bit", "side", "split", "bits", "fp"]

    def task(batches):
        held: list[np.ndarray] = []

        def out(rows):
            a, b = _edges_of_groups(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:-1, :4] != rows[1:, :4]).any(axis=1))
            cut_at = last[-1] + 1 if len(last) else 0
            if held and (cut_at or (held[-1][-1, :4] != rows[0, :4]).any()):  # all groups but the last are whole
                yield from out(np.concatenate([*held, rows[:cut_at]]))
                held = []
            elif cut_at:
                yield from out(rows[:cut_at])
            held.append(rows[cut_at:])
        if held:
            yield from out(np.concatenate(held))

    return dealt.select(*names).mapInArrow(task, "a long, b long")


def _edges_of_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links in whole groups of rows (rotation, block, node, bit, side, split, bits, fp), sorted by group and bits.

    Groups of one rotation are walked as one trie: their nodes are the start, so small groups cost no call each.
    """
    out_a, out_b = [], []
    for rotation in np.unique(rows[:, 0]):
        mine = rows[rows[:, 0] == rotation]
        budget = budget_of(int(rotation))
        top = turned_blocks(int(rotation))[0]
        ends = np.concatenate([np.flatnonzero((mine[:-1, 1:4] != mine[1:, 1:4]).any(axis=1)) + 1, [len(mine)]])
        begins = np.concatenate([[0], ends[:-1]])
        keys = np.ascontiguousarray(mine[:, 6]).view(np.uint64)
        for split, within in sorted({(int(s), int(b) < 0) for s, b in zip(mine[begins, 5], mine[begins, 3], strict=True)}):
            at = np.flatnonzero((mine[begins, 5] == split) & ((mine[begins, 3] < 0) == within))
            start = []
            if within:  # pairs within one trie node, at the depth of its block and split bits
                start = [(int(begins[i]), int(ends[i]), int(begins[i]), int(ends[i]), 0) for i in at if ends[i] - begins[i] > 1]
            else:  # pairs over two nodes whose split bits differ in one place
                for i in at:
                    lo, hi = int(begins[i]), int(ends[i])
                    mid = lo + int((mine[lo:hi, 4] == 0).sum())  # sorted by bits: the node without the bit comes first
                    if lo < mid < hi:
                        start.append((lo, mid, mid, hi, 1))
            if start:
                label = walk(keys, start, top + split, budget)
                moved = np.flatnonzero(label != np.arange(len(label)))
                out_a.append(mine[moved, 7])
                out_b.append(mine[label[moved], 7])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Fingerprints at MOST_BITS or fewer differing bits are linked; component_id is the smallest doc_id
    in a row's component. Null and empty texts have fingerprint zero and are linked like any other.
    Rows with a null id keep their row and take part in links, but give no component_id of their own:
    it is null only where all ids of a component are. Repeated rows are repeated in the result; other
    columns are ignored. Empty input gives no rows.
    """
    fps = cut(fingerprints(docs, doc_id, text))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct))
    grown = cut(join_unique(distinct, roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = grown.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = cut(join_unique(grown, least, "root").select("fp", "component_id"))
    return join_unique(fps, by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
