"""Story identity: one-to-one matching against the walk over all pairs in order."""

import random

from sentimill.operators import alignment


def walk(pairs):
    used_a, used_b, out = set(), set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in used_a and b not in used_b:
            out.add((a, b))
            used_a.add(a)
            used_b.add(b)
    return out


def test_rounds_of_best_pairs_are_the_walk(spark):
    r = random.Random(2)
    for n in (0, 1, 60, 200):
        pairs = [(r.randrange(25), r.randrange(25), r.randrange(6) / 5) for _ in range(n)]
        chain = [(i, i, float(2 * i)) for i in range(8)] + [(i, i + 1, float(2 * i + 1)) for i in range(8)] if n == 60 else []
        best: dict = {}
        for a, b, s in pairs + chain:
            best[a, b] = max(best.get((a, b), s), s)
        df = spark.createDataFrame([(a, b, s) for a, b, s in pairs + chain], "a int, b int, s double")
        got = {(x["a"], x["b"]) for x in alignment.one_to_one(df, "a", "b", "s").collect()}
        assert got == walk([(a, b, s) for (a, b), s in best.items()])


def test_ties_that_wait_for_each_other_need_no_round_each(spark):
    pairs = [(i, j, 1.0) for i in range(70) for j in range(70)]
    df = spark.createDataFrame(pairs, "a int, b int, s double")
    assert {(x["a"], x["b"]) for x in alignment.one_to_one(df, "a", "b", "s").collect()} == {(i, i) for i in range(70)}


def test_blocks_of_pairs_in_order_are_the_walk(spark):
    r = random.Random(3)
    pairs = [(r.randrange(40), r.randrange(40), r.randrange(3) / 2) for _ in range(400)]
    best: dict = {}
    for a, b, s in pairs:
        best[a, b] = max(best.get((a, b), s), s)
    df = spark.createDataFrame(pairs, "a int, b int, s double")
    got = {(x["a"], x["b"]) for x in alignment.one_to_one(df, "a", "b", "s", block=50).collect()}
    assert got == walk([(a, b, s) for (a, b), s in best.items()])


def test_story_identity_by_members_then_headlines(spark):
    now = spark.createDataFrame([("n1", m) for m in "abc"] + [("n2", m) for m in "xyz"] + [("n3", m) for m in "pq"] + [("n4", "u"), ("n5", "v"), ("n6", None)], "story string, m string")
    old = spark.createDataFrame([("o1", m) for m in "ab"] + [("o2", m) for m in "abcd"] + [("o3", m) for m in "xklmn"] + [("o4", "t"), ("o5", "w")], "story string, m string")
    heads = "story string, form string, tone double"
    new_heads = spark.createDataFrame([("n1", "same", 0.9), ("n4", "deal closes", 0.5), ("n5", "shares move", 0.5), ("n6", "", 0.0)], heads)
    old_heads = spark.createDataFrame([("o4", "deal closes", 0.1), ("o5", "shares move", -0.5), ("o2", "same", 0.9), ("o3", "", 0.0)], heads)
    got = {r["story"]: (r["old"], r["by"]) for r in alignment.story_identity(now, old, "story", "m", (new_heads, old_heads)).collect()}
    # n1 shares all members of o1 and o2 alike, the smaller name wins; n2 shares one of three with o3; n5's tone is opposite
    assert got == {"n1": ("o1", "members"), "n2": ("o3", "members"), "n4": ("o4", "headline")}
