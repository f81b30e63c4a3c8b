"""The pipeline stage by stage against plain versions of each decision."""

import hashlib
import random

import numpy as np

import corpus_pipeline as P
from sentimill.llm import decontaminate, line_quality, near_copies, toxicity
from sentimill.sources import table
from tests.llm.test_llm import slow_components

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    labels, benchmark = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    rows = {r["doc_id"]: r for r in docs.collect()}
    state, df = dict(rows), docs
    for name, stage in P.STAGES:
        out = stage(spark, df, SF)
        if name == "encoding":
            got = {r["doc_id"]: r for r in out.collect()}
            assert set(got) == set(state)
            for i, r in got.items():
                assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(state[i]["text"].encode()).hexdigest()
            continue
        assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.collect()}
        texts = [state[i]["text"] for i in sorted(state)]
        if name == "toxicity":
            m = toxicity.train(df, labels)
            want = {i for i, p in zip(sorted(state), m.probability(m.document_margins(texts)), strict=True) if p < 0.5}
        elif name == "quality":
            want = {i for i, p in zip(sorted(state), line_quality.train(df, labels).score(texts), strict=True) if p >= 0.5}
        elif name == "near_copies":
            ids = sorted(state)
            sets = [slow_shingles(t) for t in texts]
            want = {ids[c] for c in slow_groups(sets)}
            # what the fingerprints alone would find is among it
            assert len(want) <= len({ids[c] for c in slow_components([near_copies.print_of(near_copies.shingles(t.encode())) for t in texts])})
        else:
            items = [decontaminate.normal(r["text"].encode()) for r in benchmark.collect()]
            want = {i for i in state if not any(t in decontaminate.normal(state[i]["text"].encode()) for t in items)}
        assert kept == want and kept
        state = {i: state[i] for i in kept}
        df = docs.where(docs.doc_id.isin(list(kept)))


def test_run(spark):
    out = P.run(spark, SF)
    n = out.count()
    assert 0 < n < table(spark, SF, "documents").count() and out.select("doc_id").distinct().count() == n


def test_odd_and_empty_documents(spark):
    schema = table(spark, SF, "documents").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "A plain sentence of text.", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    for docs in (odd, spark.createDataFrame([], schema)):
        for _, stage in P.STAGES:
            out = stage(spark, docs, SF)
            ids = [r["doc_id"] for r in out.collect()]
            assert set(ids) <= {1, 2, None} and len(ids) <= docs.count()
            if stage is P.keep_one_of_near_copies and docs is odd:  # the wordless are copies of the first of them; what has no id stays
                assert sorted(ids, key=str) == [1, None]
            if stage in (P.drop_leaks, P.encode):
                assert len(ids) == docs.count()


def slow_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_groups(sets):
    """The least place linked to each set, by all pairs' exact Jaccard."""
    out = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                low, high = sorted((out[i], out[j]))
                out = [low if w == high else w for w in out]
    return out


def test_near_copies_beyond_a_few_bits(spark):
    """Texts of Jaccard 0.8 to 0.95, chains and unlike texts with shared passages, against all pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 60, 150, 400]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5):  # the last ones are mostly under 0.8
            base = list(base)
            for _ in range(edits * max(1, len(base) // 150)):
                base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
    sets = [slow_shingles(t) for t in texts]
    want, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                links += 1
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, SF, "documents").schema)
    kept = {x["doc_id"] for x in P.keep_one_of_near_copies(spark, docs, SF).collect()}
    assert links > 40 and len(set(want)) < len(texts)
    assert kept == set(want)


def test_pairs_by_rare_shingles(spark):
    """Of sets with common passages, chains and tiny sets, no alike pair of different components is left out, and none within a component is given."""
    r = random.Random(3)
    pool = list(range(1000, 1040))
    sets = [set(r.sample(pool, r.choice([1, 4, 20, 35]))) for _ in range(60)] + [set(pool) | {2000 + 9 * i + j for j in range(i % 12)} for i in range(40)] + [{5 * i + j for j in range(5)} for i in range(20)]
    nodes = [(10 + i, len(s), 10 + r.randrange(i + 1)) for i, s in enumerate(sets)]
    members = spark.createDataFrame([(*x, b) for x in nodes for b in (1, 2)], "node long, n int, root long, bucket long")
    found = {(x["a"], x["b"]) for x in near_copies._by_rare_shingles(members, spark.createDataFrame([(10 + i, sorted(s)) for i, s in enumerate(sets)], "node long, s array<long>")).collect()}
    root = {x[0]: x[2] for x in nodes}
    alike = {
        (10 + j, 10 + i)
        for i in range(len(sets))
        for j in range(i)
        if root[10 + i] != root[10 + j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    }
    assert len(alike) > 50 and alike <= found
    assert all(a < b and root[a] != root[b] for a, b in found)
    assert not any(a >= 110 for a, _ in found)  # sets that share nothing


def test_near_copies_keeps_neither_texts_nor_needless_pairs(spark):
    """Hashed rows carry no text; the bitmap and the sketches lose nothing that is wanted; members that have all met leave the rounds."""
    r = random.Random(14)
    hashed = near_copies._hashed(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), "doc_id", "text")
    assert "text" not in hashed.columns

    rows = spark.createDataFrame([(i, str(i)) for i in range(2000)], "k long, v string")
    wanted = set(r.sample(range(3000), 150))
    got = [x["k"] for x in near_copies._only(rows, "k", spark.createDataFrame([(k,) for k in wanted], "w long")).collect()]
    assert {k for k in wanted if k < 2000} <= set(got) and len(got) == len(set(got)) < 200

    sets = [{r.randrange(1 << 63) for _ in range(n)} for n in (1, 2, 15, 16, 17, 33, 400)]
    for s in list(sets):
        for share in (0.02, 0.1, 0.2, 0.5):  # of the hashes replaced, and some left out
            kept = set(r.sample(sorted(s), max(1, round(len(s) * (1 - share)))))
            sets += [kept, kept | {r.randrange(1 << 63) for _ in range(round(len(s) * share))}]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    table_ = spark.createDataFrame([(i, [int(x) for x in a], near_copies.sketch(a).tolist()) for i, a in enumerate(arrays)], "node long, s array<long>, bits array<long>")
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    found = {(x["a"], x["b"]) for x in near_copies._may_be_alike(spark.createDataFrame(pairs, "a long, b long"), table_).collect()}
    alike = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(alike) > 30 and alike <= found and len(found) < len(pairs) // 2

    members = spark.createDataFrame([(i, 10, i, b) for b, size in ((1, 2), (2, 40)) for i in range(100 * b, 100 * b + size)], "node long, n int, root long, bucket long")
    met, left = near_copies._to_stars(members, 0)
    assert {(100, 101)} <= {(x["a"], x["b"]) for x in met.collect()} and {x["bucket"] for x in left.select("bucket").collect()} == {2}


def test_near_copies_with_common_passage(spark):
    """Texts that share a long passage but have words of their own stay apart; a large group of altered copies is one group; against all pairs."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(120)]
    texts = [" ".join([*passage, *(word() for _ in range(r.choice([5, 20, 40])))]) for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3])):
            copy[r.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    sets = [slow_shingles(t) for t in texts]
    want = slow_groups(sets)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) > 40 and max(map(want.count, want)) > 40
