"""Fill-in-middle, the URL filter and phrases: against SQL, plain versions, and on odd input."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sentimill.llm import fill_middle, phrases, queries, url_filter
from sentimill.sources import table
from tests.duck import SF_DIR, connect, duck_rows, spark_rows
from tests.llm.test_llm import empty_docs, odd_docs


def views(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return c


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_phrases"])
def test_matches_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF_DIR)) == duck_rows(connect(), queries.ORACLES[name])


# -- fill in the middle -------------------------------------------------------------------------


def test_rotation_exchanges_blocks_of_any_size():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 7, 2 * fill_middle.STEP + 5]:
        for _ in range(4):
            a, b = sorted((r.randint(0, n), r.randint(0, n)))
            x = np.frombuffer(r.randbytes(n), np.uint8).copy()
            want = np.concatenate([x[:a], x[b:], x[a:b]])
            fill_middle.rotate(x, a, b, n)
            assert (x == want).all()


def test_forms_are_as_defined_and_come_back():
    r = random.Random(2)
    forms = Counter()
    for i in range(5000):
        t = "".join(r.choice("ab<PSM>é中😀 \n") for _ in range(r.randrange(40)))
        h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        assert tuple(h) == fill_middle.draws(i, 1)
        out, form, n, a, m = fill_middle.transform_text(t.encode(), tuple(h))
        x, y = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want = ("plain", t, None, None)
        elif h[3] % 100 < 20:
            want = ("spm", f"<S>{t[y:]}<P>{t[:x]}<M>{t[x:y]}", x, y - x)
        else:
            want = ("psm", f"<P>{t[:x]}<S>{t[y:]}<M>{t[x:y]}", x, y - x)
        assert (form, out.decode(), a, m) == want and n == len(t)
        assert fill_middle.restore_text(out, form) == t.encode()
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 100


def test_fill_middle_on_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("found", "output")
    out = fill_middle.fill_middle(docs, restored=True)
    assert out.columns.count("output") == 1 and {"ids", "score", "restored"} <= set(out.columns)
    rows = out.collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], r["restored"]) for r in rows) == texts
    assert all((r["prefix_chars"] is None) == (r["form"] == "plain") and r["n"] == len(r["restored"]) for r in rows)
    again = fill_middle.restore(fill_middle.fill_middle(docs))
    assert Counter((r["doc_id"], r["restored"]) for r in again.collect()) == texts
    assert fill_middle.fill_middle(empty_docs(spark)).count() == 0


# -- URL filter ---------------------------------------------------------------------------------

ODD_URLS = [None, "", "x", "://", "http://", "HTTP://A.COM", "http://a.com", "http://a.com/", "https://WWW.Example.com/en/x?y#z", "https://www.example.com/EN/", "https://example.com/en/://b.net/es/", "ftp://u:p@b.net:80/es/1", "http://b.net/es", "http://net/fr/", "http://bnet/fr/", "http://ü.net/fr/é?q", "mailto:a@b.com", "//a.com/", "http://a.com?x/y", "http://a.com#/", "http://a.com/\n/en/", "http://b.org/" + "x" * 5000]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for _, rule in queries.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def plain_difference(url, learnt, share):
    """Both models by their definition, one character at a time."""
    logs = []
    for urls in learnt:
        n, mass = Counter(), 0
        for u in urls:
            b = b"\0" * 5 + u.encode() + b"\0"
            mass += len(b) - 5
            for i in range(5, len(b)):
                for k in range(6):
                    n[b[i - k : i + 1]] += 1
        n = {g: c for g, c in n.items() if c >= max(1, math.ceil(mass * share))}
        by = defaultdict(dict)
        for g, c in n.items():
            by[g[:-1]][g[-1]] = c

        def p(context, c, by=by):
            lower = p(context[1:], c) if context else 1 / 256
            after = by.get(context)
            return (after.get(c, 0) + len(after) * lower) / (sum(after.values()) + len(after)) if after else lower

        b = b"\0" * 5 + (url or "").encode() + b"\0"
        logs.append(sum(math.log(p(b[i - 5 : i], b[i])) for i in range(5, len(b))) / (len(b) - 5))
    return logs[0] - logs[1]


def test_models_are_witten_bell_models(spark):
    rows = table(spark, SF_DIR, "pages").select("page_id", "url").collect()
    labelled = [(r["url"], rule in [t for v, t in queries.URL_RULES if v == "block"]) for r in rows if (rule := plain_rule(r["url"])[2])]
    share = 0.004
    model = url_filter.train(spark.createDataFrame(labelled + labelled[:5], "url string, blocked boolean"), share=share)
    import zlib

    learnt = [[u for u, b in labelled if b == side and zlib.crc32(u.encode()) % url_filter.FOLDS] for side in (False, True)]
    urls = [r["url"] for r in rows][:60] + [None, "", "http://ü.org/é", "zzz"]
    got = model.differences(urls)
    assert np.allclose(got, [plain_difference(u, learnt, share) for u in urls], atol=1e-9)
    held = [(u, b) for u, b in labelled if zlib.crc32(u.encode()) % url_filter.FOLDS == 0]
    d, y = np.round(model.differences([u for u, _ in held]), 3), np.array([b for _, b in held])
    p = model.p_block(d)
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    assert abs((p - target).sum()) < 1e-3 and abs(((p - target) * d).sum()) < 1e-3  # where the fit's loss is least


def test_url_rules_and_verdicts(spark):
    rows = [(i, u, "x", "h") for i, u in enumerate(ODD_URLS)] + [(99, f"http://n{i}.net/es/{i}", "x", "h") for i in range(40)] + [(98, f"http://n{i}.com/ok/{i}", "x", "h") for i in range(40)]
    pages = spark.createDataFrame([*rows, rows[7], rows[7], (None, "http://c.com/", None, None)], "page_id bigint, url string, rule string, host string")
    out = url_filter.url_filter(pages, queries.URL_RULES).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        host, path, rule = plain_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        by_rule = dict((t, v) for v, t in queries.URL_RULES).get(rule)
        assert r["verdict"] == (by_rule or ("block" if r["p_block"] >= 0.5 else "allow"))
    query = queries.QUERIES["op12_url_filter"](spark, SF_DIR)
    assert query.count() == table(spark, SF_DIR, "pages").count() and {r[0] for r in query.select("verdict").distinct().collect()} == {"allow", "block"}


def test_held_out_urls_are_told_apart(spark):
    """Rules' own URLs, judged by models that haven't seen them."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("url")
    host, path = url_filter.url_parts(pages["url"])
    labelled = pages.withColumn("rule", url_filter.rule_of(host, path, queries.URL_RULES)).where("rule is not null").selectExpr("url", "rule <> 'com/' AS blocked", "crc32(url) % 7 = 3 AS test")
    model = url_filter.train(labelled.where("NOT test"))
    rows = labelled.where("test").collect()
    p = model.p_block(model.differences([r["url"] for r in rows]))
    assert sum((x >= 0.5) == r["blocked"] for x, r in zip(p, rows, strict=True)) >= 0.9 * len(rows)


def test_url_filter_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id bigint, url string")
    assert {r["verdict"] for r in url_filter.url_filter(pages, queries.URL_RULES).collect()} == {"allow"}
    assert {r["verdict"] for r in url_filter.url_filter(pages, ()).collect()} == {"allow"}
    only = pages.unionByName(spark.createDataFrame([(3, "http://b.net/es/")], pages.schema))
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_filter(only, queries.URL_RULES).collect()}[3] == "block"
    assert url_filter.url_filter(pages.limit(0), queries.URL_RULES).count() == 0


# -- phrases ------------------------------------------------------------------------------------


def test_summaries_keep_what_is_frequent():
    """Merged in any order and beyond their capacity: error below mass over capacity, frequent keys held."""
    r = np.random.default_rng(3)
    for capacity in (5, 50, 400):
        s, exact = phrases.Summary(capacity), Counter()
        for _ in range(60):
            k, c = np.unique((r.zipf(1.3, 300) % 5000).astype(np.uint32), return_counts=True)
            exact.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
            s.merge(k, c)
            if r.random() < 0.3:
                s.settle()
        s.settle()
        assert len(s.keys) <= capacity and s.taken <= sum(exact.values()) / (capacity + 1)
        held = dict(zip(s.keys.tolist(), s.counts.tolist(), strict=True))
        assert all(0 <= exact[k] - held.get(k, 0) <= s.taken for k in exact)
        t = s.taken + 1
        assert {k for k, n in exact.items() if n >= t} <= set(s.survivors(t).tolist())


def small_rows(seed=5, n=400):
    r = random.Random(seed)
    vocabulary = ["a", "B", "the", "of", "New", "york", "naïve", "中文", "x" * 30, "x" * 29 + "y", "<|>", "a\x00", "a\x01"]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) if r.random() < 0.7 else r.choice(["new york city", "of the a b a", "New\tYork  city"]) for _ in range(r.randrange(60))]
        rows.append((i, "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for w in words), r.choice(["en", "fr", "und", None])))
    return [*rows, *rows[:30], (None, None, None), (7, "", "xx"), (8, " .,. ", "en")]


def test_phrases_match_sql_on_odd_rows(spark):
    rows = small_rows()
    got = phrases.phrases(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert got.count() > 20 and spark_rows(got) == duck_rows(views(rows), queries.ORACLES["op13_phrases"])


def test_phrases_with_tiny_summaries(spark):
    """Counts sent early, summaries that take off, a bitmap full of false hits: the same phrases."""
    rows = small_rows(6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    limits = phrases.Limits(run_bytes=300, held=50, held_phrases=5, mass=500, slack=2, bits=1 << 15)
    assert spark_rows(phrases.phrases(docs, limits=limits)) == duck_rows(views(rows), queries.ORACLES["op13_phrases"])


def test_phrases_absorbed_ranked_and_empty(spark):
    rows = [(i, "red apple pie. red apple", "en") for i in range(3)] + [(9, "apple pie", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["phrase"]: r for r in phrases.phrases(docs, threshold=2).collect()}
    assert set(got) == {"red apple", "apple pie", "red apple pie"}
    assert (got["red apple pie"]["a"], got["red apple pie"]["n"], got["red apple pie"]["score"]) == (3, 17, min(1000 * 3 * 17 // (6 * 4), 1000 * 3 * 17 // (6 * 4)))
    assert set(r["phrase"] for r in phrases.phrases(docs, threshold=2, absorbed_percent=70).collect()) == {"red apple", "red apple pie"}
    assert [r["rank"] for r in phrases.phrases(docs, threshold=2, first=1).collect()] == [1]
    assert phrases.phrases(empty_docs(spark)).count() == 0
    assert phrases.phrases(odd_docs(spark)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_equal_keys_are_told_apart_by_their_bytes():
    """Words whose keys are made to clash still get ids of their own."""
    texts = [b"aa bb aa cc " + b"d" * 20 + b" " + b"d" * 19 + b"e aa"]
    w = phrases.read_words(texts, np.zeros(1, np.int64), np.array([3], np.uint64))
    w.key[:] = 1
    one, of = w.ids()
    assert len(one) == 5 and [w.word(i) for i in one[of]] == texts[0].split()


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, l, r = 987_654_321_012, 123_456_789_012_345, 987_654_321_013, 987_654_321_014  # noqa: E741
    df = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    assert df.selectExpr(phrases.SCORE).first()[0] == 1000 * a * n // (l * r)


def test_no_bin_of_the_calibration_takes_the_rest():
    assert url_filter._bins(np.array([-30.0, -25.0, 25.0, 30.0])).to_pylist() == [-30_000, -25_000, 25_000, 30_000]
