"""Token sets in numpy against regular expressions and brute force, and the join on them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentimill.operators import sets, texts


def runs(lists):
    n = np.array([len(x) for x in lists])
    return n, np.concatenate([np.sort(np.array(x, np.int64)) for x in lists])


def alike(x, y, least):
    return len(x & y) >= least * len(x | y)


def near_sets(r, count, sizes, kinds, least):
    """Sets of hashed numbers below ``kinds``, small numbers in many of them, with some that differ about as much as ``least`` lets them."""
    spell = sets.mix(np.arange(kinds, dtype=np.uint64) + np.uint64(1)).view(np.int64).tolist()
    draw = lambda k: {spell[int(kinds * r.random() ** 3)] for _ in range(k)}
    found = []
    while len(found) < count:
        own = draw(r.choice(sizes))
        found.append(own)
        for _ in range(3):
            moved = r.randint(0, int(len(own) * (1 - least)) + 1)
            kept = set(r.sample(sorted(own), max(1, len(own) - r.choice([0, moved // 2, moved]))))
            found.append(kept | draw(r.choice([0, moved // 2, moved])))
    return [list(x) for x in dict.fromkeys(map(frozenset, found))]


@pytest.mark.parametrize("least", [0.8, 0.6, 0.95])
def test_sets_meet_as_often_as_asked(least):
    r = random.Random(3)
    lists = near_sets(r, 240, [1, 2, 4, 5, 7, 12, 30, 63, 64, 130, 300], 4000, least) + near_sets(r, 60, [4, 6, 9], 25, least)
    lists = [list(x) for x in dict.fromkeys(map(frozenset, lists))]
    n, t = runs(lists)
    levels = np.bincount(t & (sets.TOKEN_BUCKETS - 1), minlength=sets.TOKEN_BUCKETS)
    p, row, i, x, up, q = sets.meeting_keys(n, t, sets.worths(levels), least)
    by: dict = {}
    for e in zip(p.tolist(), row.tolist(), i.tolist(), x.tolist(), up.tolist(), q.tolist(), strict=True):
        by.setdefault(e[0], []).append(e[1:])
    met, asked = Counter(), {}
    for rows in by.values():
        for a, i_, x_, u, k in rows:
            for b, j, y, v, m in rows:
                far = (n[a] + n[b]) * (1 - least) / (1 + least) + 1e-9
                if a < b and min(u, v) == 0 and min(n[a], n[b]) >= least * max(n[a], n[b]) and (x_ < 0 or max(i_, j) <= far + x_) and not (k == m and 0 <= x_ < min(i_, j)):
                    met[a, b] += 1
                    asked[a, b] = min(x_, y, asked.get((a, b), 1 << 30))
    whole = [set(s) for s in lists]
    want = {(a, b) for a in range(len(lists)) for b in range(a + 1, len(lists)) if alike(whole[a], whole[b], least)}
    assert len(want) > 30
    assert not [(whole[a], whole[b]) for a, b in want if met[a, b] <= asked.get((a, b), 0)]


def test_unlike_sets_of_few_words_rarely_meet():
    """Texts of one small vocabulary: single rare tokens let most pairs meet, what sets have in parts lets few."""
    r = random.Random(4)
    lists = [r.sample(range(1, 1500), 200) for _ in range(300)]
    lists = [sets.mix(np.array(x, np.uint64)).view(np.int64).tolist() for x in lists]
    n, t = runs(lists)
    worth = sets.worths(np.bincount(t & (sets.TOKEN_BUCKETS - 1), minlength=sets.TOKEN_BUCKETS))
    p, row, _, x, *_ = sets.meeting_keys(n, t, worth, 0.8)
    by: dict = {}
    for key, a in zip(p.tolist(), row.tolist(), strict=True):
        by.setdefault(key, []).append(a)
    met = Counter((a, b) for rows in by.values() for a in rows for b in rows if a < b)
    assert sum(c > x.max() for c in met.values()) < 50  # of 44,850 pairs


def test_words_as_regular_expressions_take_them(monkeypatch):
    r = random.Random(6)
    signs = ["a", "Z", "k", "7", "'", " ", "\n", "é", "É", "K", "İ", "ß", "中", "-", "don't", "9x", "x9"]
    rows = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(300)] + [None, "", "'''", "a" * 500, "ends here", "starts", "Kelvin İf"]
    want = [len(set(re.findall("[a-z][a-z0-9']*", (s or "").replace("İ", "i̇").lower()))) for s in rows]
    spelt = lambda s: sorted(set(re.findall("[a-z][a-z0-9']*", (s or "").replace("İ", "i̇").lower())))
    for piece, part in ((1 << 16, 1 << 20), (16, 64)):
        monkeypatch.setattr(sets, "PIECE_BYTES", piece)
        monkeypatch.setattr(sets, "SLICE_BYTES", part)
        of: dict = {}
        for kind in (pa.string(), pa.large_string()):
            got = np.zeros(len(rows), int)
            for at, n, t in sets.token_sets(pa.array(["skipped", *rows], kind).slice(1)):
                got[at : at + len(n)] = n
                for k, own in enumerate(np.split(t, np.cumsum(n)[:-1])):
                    assert of.setdefault(tuple(spelt(rows[at + k])), own.tolist()) == own.tolist() == sorted(set(own.tolist()))
            assert got.tolist() == want
        assert len({tuple(v) for v in of.values()}) == len(of)


def test_shared_tokens_and_digests():
    r = random.Random(8)
    lists = [r.sample(range(100), r.randint(1, 60)) for _ in range(30)]
    n, t = runs(lists)
    a, b = np.array([r.randrange(30) for _ in range(200)]), np.array([r.randrange(30) for _ in range(200)])
    assert sets.shared(np.split(t, np.cumsum(n)[:-1]), a, b).tolist() == [len(set(lists[x]) & set(lists[y])) for x, y in zip(a, b, strict=True)]
    h, g = sets.digests(*runs([[1, 2], [2, 1], [1, 3], [3]]))
    assert h[0] == h[1] and g[0] == g[1] and len(set(h)) == len(set(g)) == 3


def test_large_components_are_dealt_into_cells(spark, monkeypatch):
    """One large group of near copies, small ones, exact copies, repeated rows and ids of text."""
    monkeypatch.setattr(sets, "CELL", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"n{i:03}", " ".join(r.sample(base, 58) + [f"own{i}", f"w{i % 7}x"])) for i in range(90)]
    rows += [(f"s{i:03}", f"Small GROUP {i // 3} of five words{i // 3} and more{'s' * (i % 3)} there it's") for i in range(30)]
    rows += [(f"z{i:03}", rows[i % 100][1].upper()) for i in range(120)] + [("e", ""), ("f", None)]
    df = spark.createDataFrame(rows + rows[:40], "i string, t string")
    first: dict = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        if t:
            first.setdefault(frozenset(re.findall("[a-z][a-z0-9']*", t.lower())), i)
    want = {(min(a, b), max(a, b)): round(len(s & u) / len(s | u), 9) for s, a in first.items() for u, b in first.items() if a < b and alike(s, u, 0.8)}
    got = [(x["a"], x["b"], round(x["jaccard"], 9)) for x in texts.near_duplicate_links(df, "i", "t").collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items()) and len(want) > 1000
    links = Counter(x for k in want for x in k)
    groups = {x["i"]: (x["rep"], x["links"]) for x in texts.near_duplicate_groups(df, "i", "t").collect()}
    assert groups == {i: ((rep := first[frozenset(re.findall("[a-z][a-z0-9']*", t.lower()))]), links[rep]) for i, t in rows if t}
