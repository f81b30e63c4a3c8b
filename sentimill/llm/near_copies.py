"""Near copies by SimHash and the exact likeness of their word shingles, for the pipeline.

A text is the set of its five-word shingles. Texts with the same set are one node. The sets' SimHashes meet
in ``simhash``'s trie join, and each of its components is a bucket of candidates. Four differing bits of 64
stand for a Jaccard of about 0.95, so the fingerprints alone would miss the pairs down to 0.8; for those,
nodes that agree in all rows of one of some MinHash bands share a bucket too, which two sets of Jaccard 0.8
do with probability 1 - (1 - 0.8^4)^16 = 0.9998, more alike ones with more. No pair is linked but by the
exact Jaccard of its sets, and every pair that shares a bucket is linked, found too unlike, or in one
component already.

Bounds. In every bucket the members are first compared with a few of them, a fixed number of pairs a
member and round; buckets whose members then are in one component, or have all met, need no more. What is
left of the others meets by rare shingles it shares, an exact bound; sizes that can't be that alike are never
compared. Texts are read again where sets are needed, not kept, and texts and sets that no pair needs are
left out by a bitmap of fixed size before they are shuffled; its false hits cost work only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentimill.llm.arrow import slices
from sentimill.llm import simhash
from sentimill.operators.components import components, join_unique
from sentimill.sources.shared import cut

WORDS = 5
#: Jaccard of a link as a ratio of whole numbers, so that no pair hangs on rounding.
LIKE, OF = 4, 5
BANDS, ROWS = 16, 4
#: Rounds in which a bucket's members are compared with at most so many of them, before the pairs that are left.
ROUNDS, STARS = 2, 4
#: Shingles hashed by all rows at a time.
CHUNK = 4096
#: Bits of the map of wanted keys, in pieces of 2^15 bits as ``bitmap_construct_agg`` makes them: 4 MB in all, whatever the input.
MAP_BITS = 1 << 25
_MIX = np.uint64(0x9E3779B97F4A7C15)
_R = np.random.default_rng(29)
_FLIP = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: words as in ``simhash``; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    out = np.zeros(n - WORDS + 1, np.uint64)
    for j in range(WORDS):
        out = (out ^ h[j : n - WORDS + 1 + j]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: the least hashes of its rows, and the band, in one number."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[i : i + CHUNK, None] ^ _FLIP) * _TIMES).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(31)
    return out


def print_of(found: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if more than half of their hashes have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 65_536):
        counts += np.unpackbits(found[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, n, keys, fp, key): the set's digest, its size, its band keys, its SimHash and the text's key for every row."""

    def task(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = [shingles(t) for t in texts]
                nodes = np.array([xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                keys = np.concatenate([bands(s) for s in sets]).view(np.int64)
                ends = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
                prints = pa.array(np.array([print_of(s) for s in sets], np.uint64).view(np.int64))
                columns = [part.column("doc_id"), pa.array(nodes), pa.array(np.array([len(s) for s in sets], np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys)), prints, part.column("key")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "keys", "fp", "key"])

    kind = docs.schema[doc_id].dataType.simpleString()
    bare = _texts(docs, text, doc_id)
    return bare.mapInArrow(task, f"doc_id {kind}, node long, n int, keys array<long>, fp long, key long")


def _texts(docs: DataFrame, text: str, doc_id: str | None = None) -> DataFrame:
    """(key, text), and doc_id where named: the texts' bytes under their 64-bit hashes."""
    ids = [] if doc_id is None else [F.col(doc_id).alias("doc_id")]
    body = F.col(text).cast("binary")
    return docs.select(*ids, F.xxhash64(body).alias("key"), body.alias("text"))


def _only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is among the keys of ``wanted``, a single column, and few others: by a bitmap of MAP_BITS bits, nothing is shuffled."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(MAP_BITS))
    own = wanted.toDF(key).select(at.alias("_at"))
    bits = own.groupBy(F.bitmap_bucket_number("_at").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = rows.withColumn("_piece", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "_piece")  # at most MAP_BITS / 2^15 pieces
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(rows.columns)


def sketch(found: np.ndarray) -> np.ndarray:
    """A bitmap of the hashes' low bits, some four to eight bits a hash, as 64-bit words: an eighth of the set's size or less."""
    size = max(64, 1 << (4 * len(found) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """(node, s, bits) from (node, text): the set and its sketch."""

    def task(batches):
        for batch in batches:
            for part, found in slices(batch, "text"):
                sets = [shingles(t) for t in found]
                lists = [[s.view(np.int64) for s in sets], [sketch(s) for s in sets]]
                ends = [pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)) for xs in lists]
                arrays = [pa.ListArray.from_arrays(e, pa.array(np.concatenate(xs))) for e, xs in zip(ends, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), *arrays], names=["node", "s", "bits"])

    return texts.mapInArrow(task, "node long, s array<long>, bits array<long>")


def _fits(na, nb):
    """Sizes so unlike can't be of that Jaccard."""
    return F.least(na, nb) * OF >= F.greatest(na, nb) * LIKE


def _may_be_alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs, given cut, that their sketches don't rule out.

    Each bit that one sketch has beyond the other stands for a hash at least that the other set lacks, which
    bounds what they share. Of two sketches' lengths the longer is folded; further apart than that they rule out nothing.
    """
    side = lambda c: sets.select(F.col("node").alias(c), F.size("s").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    both = join_unique(cut(join_unique(pairs, side("a"), "a")), side("b"), "b")
    half = lambda x, n: F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda u, v: u.bitwiseOR(v))
    folded = lambda x, y: F.when(F.size(x) == 2 * F.size(y), half(F.col(x), F.size(y))).otherwise(F.col(x))
    both = both.withColumns({"ya": folded("xa", "xb"), "yb": folded("xb", "xa")})
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda acc, k: acc + k)
    most = F.least(F.col("na") - lacks("ya", "yb"), F.col("nb") - lacks("yb", "ya"))
    can = most * (LIKE + OF) >= (F.col("na") + F.col("nb")) * LIKE
    return both.where((F.size("ya") != F.size("yb")) | can).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs whose sets are alike enough."""
    pairs = cut(_may_be_alike(cut(pairs), sets))
    few = _only(sets, "node", pairs.select("a").union(pairs.select("b")))
    one = cut(join_unique(pairs, few.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a"))
    both = join_unique(one, few.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut(both.where(shared * OF >= (F.size("sa") + F.size("sb") - shared) * LIKE).select("a", "b"))


def _buckets(rows: DataFrame) -> DataFrame:
    """The rows (node, n, bucket) of buckets with several nodes."""
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    return cut(join_unique(rows, cut(shared.where("c > 1").select("bucket")), "bucket"))


def _to_star(members: DataFrame) -> DataFrame:
    """(a, b): members of each bucket with one of them: the shortest, which the others may contain."""
    stars = cut(members.groupBy("bucket").agg(F.min_by("node", F.struct("n", "node")).alias("star"), F.min("n").alias("star_n")))
    met = join_unique(members, stars, "bucket").where((F.col("node") != F.col("star")) & _fits(F.col("n"), F.col("star_n")))
    return met.select(F.least("star", "node").alias("a"), F.greatest("star", "node").alias("b")).distinct()


def _to_stars(members: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): members of each bucket with each of up to STARS of them, where they are in different components and may be alike; and the members of buckets in which some have not met.

    The stars of a bucket are drawn by a hash of bucket, node and round ``k``, so that a node meets others in each of its buckets.
    Only members that are no stars don't meet each other, so a bucket with one of them, or none, is done with.
    """
    draw = F.xxhash64("bucket", "node", F.lit(k))
    drawn = members.groupBy("bucket", F.pmod(draw, F.lit(STARS)).alias("slot")).agg(F.min_by(F.struct("node", "n", "root"), draw).alias("z"), F.count(F.lit(1)).alias("c"))
    stars = cut(drawn.groupBy("bucket").agg(F.collect_list("z").alias("stars"), F.sum("c").alias("c")))
    left = join_unique(members, stars.where(F.col("c") - F.size("stars") > 1).select("bucket"), "bucket")
    met = join_unique(members, stars, "bucket").select("node", "n", "root", F.explode("stars").alias("z"))
    met = met.where((F.col("root") != F.col("z.root")) & _fits(F.col("n"), F.col("z.n")))
    return met.select(F.least("z.node", "node").alias("a"), F.greatest("z.node", "node").alias("b")).distinct(), left


def _by_rare_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): of the nodes of ``members``, all pairs of different components that can be alike enough.

    Alike sets share at least ceil(0.8 n) shingles of the n of either one, so with all shingles in one order, here the
    rarest first, they share one of the first n - ceil(0.8 n) + 1 of each. Shingles of one node fill these places first,
    so texts alike by a common passage alone, with other words of their own, give no pairs. The first shingle that two
    sets share must leave enough places behind it in both. Under a shingle the members of its largest component are not
    paired with each other.
    """
    nodes = cut(members.select("node", "n", "root").distinct())
    told = cut(join_unique(nodes, _only(sets, "node", nodes.select("node")), "node").select("node", "n", "root", F.explode("s").alias("t")))
    common = cut(told.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    order = Window.partitionBy("node").orderBy("c", "t")
    ranked = join_unique(told, common, "t").withColumns({"at": F.row_number().over(order), "m": F.count(F.lit(1)).over(Window.partitionBy("node"))})
    ranked = ranked.withColumn("rest", F.col("m") - F.col("at") + 1)  # places from this one on
    first = cut(ranked.where(F.col("rest") >= F.expr(f"({LIKE} * n + {OF - 1}) div {OF}")).select("t", "node", "n", "root", "rest"))
    parts = first.groupBy("t", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = cut(parts.groupBy("t").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"))
    under = cut(join_unique(first, mixed, "t"))
    a = under.where("root != largest").select("t", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("rest").alias("rest_x"))
    enough = F.least("rest_x", "rest") * (LIKE + OF) >= (F.col("nx") + F.col("n")) * LIKE
    both = a.join(under.select("t", "node", "n", "root", "rest"), "t").where((F.col("rx") != F.col("root")) & enough)
    return both.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _with_roots(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n, bucket, root) of what buckets are left with more than one component by the links found."""
    roots = cut(components(found).select("node", "root"))
    rooted = cut(join_unique(members.select("node", "n", "bucket"), roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    return cut(join_unique(rooted, mixed, "bucket"))


def links(hashed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): node pairs whose components are those of all pairs that share a bucket and are alike enough. Give ``hashed`` cut; of ``texts`` (key, text) one is read for each node of a shared bucket.

    The SimHash buckets go first: they join most copies, each by one comparison, and the bands then compare only nodes of different components.
    """
    nodes = cut(hashed.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.min("key").alias("key")))
    near = cut(components(simhash.links(cut(nodes.select("fp").distinct()))).select(F.col("node").alias("fp"), "root"))
    by_print = _buckets(cut(join_unique(nodes.select("node", "n", "fp"), near, "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("bucket"))))
    by_band = _buckets(cut(nodes.select("node", "n", F.explode("keys").alias("bucket"))))
    wanted = cut(nodes.select("node", "key").join(by_print.select("node").union(by_band.select("node")).distinct(), "node"))
    read = _only(texts, "key", wanted.select("key")).groupBy("key").agg(F.first("text").alias("text"))
    sets = cut(_sets(read.join(wanted, "key").select("node", "text")))
    found = _alike(_to_star(by_print), sets)
    members = _with_roots(by_band, found)
    for k in range(ROUNDS):
        pairs, left = _to_stars(members, k)
        found = cut(found.unionByName(_alike(pairs, sets)))
        members = _with_roots(left, found)
    return cut(found.unionByName(_alike(_by_rare_shingles(members, sets), sets)))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id for every row: the smallest id among the rows linked to it, itself included.

    Null texts count as empty, and texts without words are copies of each other. Rows with a null id
    take part in links but give no component_id of their own; repeated rows are repeated in the result.
    """
    hashed = cut(_hashed(docs, doc_id, text))
    ids = cut(hashed.select("doc_id", "node"))
    first = cut(ids.groupBy("node").agg(F.min("doc_id").alias("first")))
    grown = cut(join_unique(first, components(links(hashed, _texts(docs, text))), "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = cut(grown.groupBy("root").agg(F.min("first").alias("component_id")))
    by_node = cut(join_unique(grown, least, "root").select("node", "component_id"))
    return join_unique(ids, by_node, "node").select("doc_id", "component_id")
