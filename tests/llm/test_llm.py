"""The corpus operators against libraries, brute force, round trips and held-out accuracy, and on odd input."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sentimill.llm import byte_bpe, decontaminate, html_text, imatch, language_id, licenses, line_quality, simhash, token_counts, toxicity
from sentimill.operators.components import components
from sentimill.sources import table

SF = "/root/testdata/sf0.001"
SPM = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "x" * 5000, "the the the the", "naïve café — “quoted” 中文 😀‍\x1c²", "<s></s>▁ ▁", "ten\ttabs\r\n"]
#: Extra columns whose names the operators use inside.
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, fp bigint, found string, held_out string, path string, _group int"


def odd_docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5, "x", 7, "f", "h", "p", 3) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "a", None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10)]
    return spark.createDataFrame(rows, CLASH)


def empty_docs(spark):
    return spark.createDataFrame([], CLASH)


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels").cache()


# -- token counts ------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, docs):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=SPM)
    rows = docs.select("doc_id", "text").collect()
    got = as_dict(token_counts.token_counts(docs, SPM))
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["n_tokens"] == len(p.encode(r["text"])) and got[r["doc_id"]]["n_bytes"] == len(r["text"].encode())


def test_token_units_on_random_text():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=SPM)
    counts = token_counts._Counts(p, token_counts.prove(SPM))
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice("abcdefgh éß\n\t  .,'0²中😀‍\xa0▁<s>\r") for _ in range(r.randint(0, 40)))
        assert token_counts.count_text(counts, t) == len(p.encode(t)), repr(t)


def test_token_counts_on_odd_input(spark):
    got = token_counts.token_counts(odd_docs(spark), SPM, limit=2).collect()
    assert len(got) == len(ODD) + 4 and got[0]["n_tokens"] == 0 and not got[0]["over_limit"] and got[5]["over_limit"]
    assert token_counts.token_counts(empty_docs(spark), SPM).count() == 0


# -- byte-level BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(BPE) as f:
        ranks = byte_bpe.read_ranks(f.readlines())
    return byte_bpe.Codec(ranks, byte_bpe.token_halves(ranks), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_is_the_librarys(codec, tik, docs):
    for r in docs.select("text").collect():
        assert [i for p in codec.encode(r["text"]) for i in p] == tik.encode_ordinary(r["text"])


def test_bpe_on_random_and_long_text(codec, tik):
    r = random.Random(7)
    for alphabet in ("abcdeth éß\n\t  \x1c\x85.,'s0²中😀‍\xa0_", "aab", "thinge "):
        for _ in range(1500):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 50)))
            assert [i for p in codec.encode(t) for i in p] == tik.encode_ordinary(t), repr(t)
    for t in ("a" * 3000, "ab" * 2000, "\n" * 1000, "tionthing" * 300):
        assert [i for p in codec.encode(t) for i in p] == tik.encode_ordinary(t)


def test_bpe_seams_against_plain_merges(codec):
    r = random.Random(9)
    tokens = [t for t in codec.ranks if 1 < len(t) < 6]
    for _ in range(2000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert codec.compatible(codec.ranks[a], codec.ranks[b]) == (byte_bpe.plain_merges(codec.ranks, a + b) == [a, b])


def test_bpe_round_trip(spark):
    got = byte_bpe.digests(odd_docs(spark), BPE, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) + 4
    for r, t in zip(got, ODD, strict=False):
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digests(empty_docs(spark), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_maps_agree(spark):
    """Encoding and decoding apart, and the one map of both, give the same ids, bytes and digests."""
    apart = byte_bpe.decode(byte_bpe.encode(odd_docs(spark), BPE, public_tokenizers.PATTERN), BPE).collect()
    both = byte_bpe.round_trip(odd_docs(spark), BPE, public_tokenizers.PATTERN).collect()
    assert len(apart) == len(both)
    for a, b in zip(apart, both, strict=True):
        assert a["ids"] == b["ids"] and b["n_tokens"] == len(b["ids"]) and a["score"] == b["score"]
        assert b["decoded_sha256"] == hashlib.sha256(bytes(a["decoded"])).hexdigest() and b["ids_sha256"] == hashlib.sha256(",".join(map(str, a["ids"])).encode()).hexdigest()


def test_memos_of_two_generations():
    memo = byte_bpe.Memo(4)
    for k in range(5):
        memo.put(k, k * k)
    assert memo.get(4) == 16 and memo.get(2) == 4 and memo.get(0) is None and len(memo.new) + len(memo.old) <= 5


# -- SimHash -----------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    fps = [slow_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", rows[c]["doc_id"]) for r, f, c in zip(rows, fps, slow_components(fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want and len(set(got.values())) < len(got)


@pytest.mark.parametrize("node_rows", [4096, 4, 1])
def test_trie_join_by_brute_force(spark, node_rows, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(r.randint(0, 6)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {x["node"]: x["root"] for x in components(links).collect()}
    got, want = {}, {}
    for f, c in zip(signed, slow_components(fps), strict=True):
        got.setdefault(root.get(f, f), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert links.count() < 5 * len(fps) * 13


def test_simhash_on_odd_input(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 4
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zero} == {0} and any(r["doc_id"] is None for r in zero)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (1, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (5, 7, 900)} == {5}


# -- HTML --------------------------------------------------------------------------------------


def test_html_article_only():
    page = """<!DOCTYPE html><html><head><title>No</title><script>var p="</p>";</script><style>p{}</style></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu, item</a></li></ul></nav><div class="cookie-notice">We use cookies, lots, of them.</div>
    <div id="main"><article><h1>The &amp; title</h1><p>First   paragraph, with <a href=x>a link</a>, long enough to count &mdash; yes.
    <p>Second paragraph,<br>broken, and also long enough to count as prose.</p><form><p>Sign up now, please, for our great newsletter today.</p></form>
    <ul><li>one item</li><li>two</li></ul></article>
    <div class="comments"><p>I disagree, strongly, with all of this, and more, and more, and more.</p></div></div>
    <aside class="sidebar"><p>Related, stories, that you, may, like, as, well.</p></aside><div class="ad">Buy, buy, buy, our thing, it is very good, cheap.</div>
    <footer>&copy; somebody, some rights</footer></body></html>"""
    want = "The & title\n\nFirst paragraph, with a link, long enough to count — yes.\n\nSecond paragraph, broken, and also long enough to count as prose.\n\none item\n\ntwo"
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<div><p></div></p>", "</p></p>", "<script>x", "<!-- ", "&am", "<a href='>x</a>", "<p>" * 3000, "<div>" * 3000 + "deep text"])
def test_html_never_fails(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_short_and_plain_pages():
    assert html_text.main_text("<p>Hi there</p>") == "Hi there"
    assert html_text.main_text("just text &lt;b&gt;") == "just text <b>"


def test_html_given_pages(spark):
    pages = table(spark, SF, "pages")
    got = as_dict(html_text.extract(pages), "page_id")
    for r in pages.collect():
        t = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(t) and "\n\n\n" not in t and "track(" not in t and "©" not in t
    assert len(got) == pages.count()


ARTICLE = "<h1>Title of it</h1>" + "".join(f"<p>Paragraph number {k}, with words, and commas, which goes on for a while.</p>" for k in range(4))


@pytest.mark.parametrize("around", ['<div class="sidebar">%s</div>', "<form>%s</form>", '<div class="promo">%s</div>'])
def test_noise_with_most_of_the_prose_is_left_out(around):
    noise = "".join(f"<p>Other story number {i}, with, some, commas, and a good many words to read.</p>" for i in range(5))
    article = "<p>The article, which is short, has just these two paragraphs of text, no more.</p><p>And this, the second one, is where it ends, as far as we can tell.</p>"
    for page in (f"<body><div>{article}</div>{around % noise}</body>", f"<body>{around % noise}<article>{article}</article></body>"):
        text = html_text.main_text(page)
        assert "The article" in text and "where it ends" in text and "Other story" not in text


def test_licences_of_string_ids(spark):
    docs = spark.createDataFrame([("a-1", "Licensed under the MIT License", "en", "s"), ("7", None, None, None), (None, "x", "en", "s")], "doc_id string, text string, lang string, source string")
    rows = licenses.document_licenses(docs).collect()
    assert {r["doc_id"] for r in rows} == {"a-1", "7", None} and all(r["path"] for r in rows)


@pytest.mark.parametrize("around", ['<div class="layout with-sidebar">%s</div>', '<div class="has-header">%s</div>', '<form id="page"><div>%s</div></form>', '<div class="widget">%s</div>', '<div class="banner"><div class="share">%s</div></div>'])
def test_html_articles_in_odd_containers(around):
    page = "<body><nav><a href=x>menu</a></nav>" + around % ARTICLE + "<div class=comments><p>" + "I, myself, disagree with it. " * 60 + "</p></div><footer>foot</footer></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title of it\n\nParagraph number 0") and got.count("Paragraph") == 4 and "disagree" not in got and "menu" not in got and "foot" not in got


def test_html_lists_and_headings_beside_the_container():
    page = "<div><div class=post>" + ARTICLE + "</div><h3>Sub head</h3><ul><li>first item of the list</li><li>second item</li></ul><h4>Menu</h4><ul><li><a href=x>a link here</a></li><li><a>menu two is here</a></li></ul></div>"
    assert html_text.main_text(page).endswith("\n\nSub head\n\nfirst item of the list\n\nsecond item")
    assert html_text.main_text("<p>With math <math><mi>x</mi><mo>=</mo><mn>2</mn></math> inside and more words here.</p>") == "With math x=2 inside and more words here."


@pytest.mark.parametrize("bad", ['<a "', '<a href="', "<a x='\"", "<!--", "</", "<b><i>", "<div><b></div></b>", "</b>"])
def test_html_hostile_markup_is_linear(bad):
    import time

    start = time.perf_counter()
    assert isinstance(html_text.main_text(bad * 20_000), str) and time.perf_counter() - start < 15


def test_html_scores_by_brute_force(spark):
    """Every element's points from its paragraphs' distances, one by one, on all given pages."""

    def slow(root):
        nodes, out = [], {}

        def walk(x):
            nodes.append(x)
            for y in x.parts:
                if not isinstance(y, str):
                    walk(y)

        walk(root)
        text_of = lambda x, block: "".join(y if isinstance(y, str) else "" if block and y.name in html_text.BLOCK else text_of(y, block) for y in x.parts)
        links = lambda x: len(text_of(x, False)) if x.name == "a" else sum(links(y) for y in x.parts if not isinstance(y, str))
        for x in nodes:
            direct = x.name in ("div", "section", "article", "main") and any(isinstance(y, str) and len(y) > html_text.LEAST_PARAGRAPH for y in x.parts)
            text = " ".join(text_of(x, True).split())
            if (x.name in html_text.PARAGRAPHS or direct) and len(text) >= html_text.LEAST_PARAGRAPH:
                up, far = (x.parent if x.name in html_text.PARAGRAPHS else x), 0
                while up is not None:
                    out[up] = out.get(up, 0) + (1 + text.count(",") + min(len(text) / 100, 3)) * (1, 1 / 2)[far] if far < 2 else out.get(up, 0) + (1 + text.count(",") + min(len(text) / 100, 3)) / (3 * far)
                    up, far = up.parent, far + 1
        prior = {"article": 25, "main": 25, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3}
        for x in nodes:
            size = len(text_of(x, False))
            add = prior.get(x.name, 0) + 25 * bool(html_text.BODYISH.search(x.label)) - 25 * bool(html_text.NOISE.search(x.label) or html_text.COMMENTS.search(x.label))
            out[x] = (out.get(x, 0) + add * (size > 0)) * (1 - links(x) / size if size else 0)
        return out

    for r in table(spark, SF, "pages").collect():
        order = html_text._prune(html_text.parse(r["html"]), True)
        html_text.score(order)
        want = slow(order[0])
        assert len(want) == len(order) and all(x.points == pytest.approx(want[x]) for x in order)


# -- learnt classifiers ------------------------------------------------------------------------


def held_out_accuracy(rows, truth):
    hits = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(hits) / len(hits)


def test_quality_held_out(spark):
    d, y = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = line_quality.quality(d, y).collect()
    assert len(rows) == d.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert held_out_accuracy(rows, {r["doc_id"]: r["quality"] for r in y.collect()}) > 0.97


def test_toxicity_held_out(spark):
    d, y = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.toxicity(d, y).collect()
    # in these rows some insults of three of the languages share their stems with clean words
    assert held_out_accuracy(rows, {r["doc_id"]: r["toxic"] for r in y.collect()}) > 0.95


def test_string_kernel_by_brute_force():
    from itertools import combinations

    def slow(a, b):
        total = 0.0
        for s in combinations(range(len(a)), 3):
            for t in combinations(range(len(b)), 3):
                if all(a[i] == b[j] for i, j in zip(s, t, strict=True)):
                    total += toxicity.DECAY ** (s[2] - s[0] + 1 + t[2] - t[0] + 1)
        return total

    for a, b in (("idiot", "idixot"), ("moron", "oron"), ("aaaa", "aaa"), ("loser", "closer")):
        x, y = f"<{a}>", f"<{b}>"  # words stand between a start and an end
        assert toxicity.kernel(a, b) == pytest.approx(slow(x, y) / (slow(x, x) * slow(y, y)) ** 0.5)


def test_folded_machine_equals_its_kernels():
    r = random.Random(2)
    fill = [a + b for a in ("gra", "sto", "fel", "run", "wat", "lig") for b in ("ss", "ne", "d", "er", "ing", "ht", "en", "sy")]
    line = lambda: [r.choice(fill) for _ in range(12)]
    insults = ["idiot", "moron", "clown", "loser"]
    texts = [" ".join(line() + [insults[k % 4], insults[(k + 1) % 4]] + line()) for k in range(60)] + [" ".join(line() + line()) for _ in range(60)]
    m = toxicity.Model().fit(texts, [1] * 60 + [0] * 60)
    got = m.probability(m.document_margins(["an idiot", "an i d i o t here", "an idi.ot", "grass and stone"]))
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] > 0.5 and got[3] < 0.5
    words = ["idiot", "idixot", "mroron", "clwn", "loserr", "gran", "grass", "ab", "i.d.i.o.t"]
    plain = [sum(b * toxicity.kernel(landmark, w) for landmark, b in m.kernels.items()) + m.bias for w in words]
    assert m.margins(words) == pytest.approx([max(x, m.bias) for x in plain], abs=1e-4)


def test_toxicity_learns_without_a_plain_insult():
    """Too few documents for any word to be plainly toxic: the likeliest words stand in."""
    texts = [f"{a} vexing {b}" for a, b in zip("one two three four".split(), "red blue green grey".split(), strict=True)] + ["one red two", "blue three", "green four one", "grey two red"]
    m = toxicity.Model().fit(texts, [1] * 4 + [0] * 4)
    worst, clean = m.document_margins(["so vexing here", "so one here"])
    assert worst > clean


def test_toxicity_tolerates_altered_insults(spark):
    """Insults with one letter or sign put in, doubled or spaced, in sentences of clean words of the held-out documents."""
    d, y = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    m = toxicity.train(d, y)
    r = random.Random(1)
    forms = {
        "letter": lambda w, k: w[:k] + r.choice("abcdefghijklmnopqrstuvwxyz") + w[k:],
        "double": lambda w, k: w[:k] + w[k - 1] + w[k:],
        "sign": lambda w, k: w[:k] + r.choice(".-_*") + w[k:],
        "spaced": lambda w, k: " ".join(w),
    }
    insults = "trash worthless idiot loser disgusting scum clown moron stupid pathetic".split()
    for name, form in forms.items():
        texts = ["so then " + form(w, r.randint(1, len(w) - 1)) + " and more" for w in insults for _ in range(12)]
        hits = m.probability(m.document_margins(texts)) >= 0.5
        assert hits.mean() >= 0.9, name
    assert m.probability(m.document_margins(["so then and more", ""])).max() < 0.5


def test_long_words_and_texts_are_learnt_from(spark):
    """Toxic words stand only in texts above any piece's size, one of them as part of a very long word."""
    r = random.Random(3)
    fill = ["".join(r.choices("abcdefghilmnoprstu", k=5)) for _ in range(400)]
    rows = []
    for i in range(300):
        words = r.choices(fill, k=4000)
        if i % 2:
            words[r.randrange(4000)] = "zwqxyk" if i % 4 == 1 else "x" * 40 + "zwqxykzwqxyk" + "y" * 40
        rows.append((i, " ".join(words), i % 2))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    y = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = [x for x in toxicity.toxicity(d, y).collect() if x["held_out"]]
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in got) >= 0.9 * len(got)


def test_excerpts_span_the_text(spark):
    from sentimill.llm.labelled import excerpt

    long = "".join(f"{i:06d} " for i in range(9000))
    got = spark.createDataFrame([("short",), (long,)], "t string").select(excerpt(F.col("t"))).collect()
    pieces = got[1][0].split("\n")
    assert got[0][0] == "short" and len(pieces) == 12 and pieces[0] == long[:1000] and pieces[-1] == long[-1000:] and all(x in long for x in pieces)


def test_marginals_by_brute_force():
    from itertools import product

    import numpy as np

    r = np.random.default_rng(1)
    unary, couple, sizes = r.normal(size=9), r.normal(size=(2, 2)), np.array([4, 1, 4])
    starts = np.cumsum(sizes) - sizes
    good, pair, z = line_quality.marginals(unary, couple, starts, sizes)
    for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        weights = {y: np.exp(sum(unary[s + i] * y[i] for i in range(n)) + sum(couple[y[i], y[i + 1]] for i in range(n - 1))) for y in product((0, 1), repeat=int(n))}
        total = sum(weights.values())
        assert z[k] == pytest.approx(np.log(total))
        for i in range(n):
            assert good[s + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        if n > 1:
            assert pair[s, 1, 0] == pytest.approx(sum(w for y, w in weights.items() if y[0] == 1 and y[1] == 0) / total)


def test_language_held_out(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.language_id(d).collect()
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    hits = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and sum(hits) / len(hits) > 0.95


@pytest.mark.parametrize("operator", [line_quality.quality, toxicity.toxicity])
def test_classifiers_on_odd_input(spark, labels, operator):
    none = labels.limit(0)
    got = operator(odd_docs(spark), none).collect()
    assert len(got) == len(ODD) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in got)
    assert operator(empty_docs(spark), labels).count() == 0


def test_language_on_odd_input(spark):
    got = language_id.language_id(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 4
    assert [r["lang_pred"] for r in got[:4]] == ["und"] * 4 and got[5]["lang_pred"] == "en"
    assert language_id.language_id(empty_docs(spark)).count() == 0


# -- I-Match -----------------------------------------------------------------------------------


def test_imatch_edited_texts(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    got = as_dict(imatch.fingerprints(docs))
    for i, r in enumerate(rows):
        k = len(r["text"]) // 4
        edited = r["text"][: len(r["text"]) - k] + rows[(i + 1) % len(rows)]["text"][:k]
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    near = [r["near_edited"] for r in got.values()]
    far = [r["near_next"] for r in got.values()]
    assert sum(near) / len(near) > 0.2 > 10 * sum(far) / len(far)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(got[r["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_imatch_groups_join_up(spark, monkeypatch):
    monkeypatch.setattr(imatch, "GROUP_ROWS", 3)
    ids = [1, 2, 3, 50, 51, 1000, 1001, 1002, 10**12, 10**12 + 5, 7, 7]
    d = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["next_text"]) for r in imatch.with_next(d, "doc_id", ["text"], "text").collect())
    want = [r["text"] for r in d.coalesce(1).orderBy("doc_id", F.xxhash64("text")).collect()]
    assert {g[1]: g[2] for g in got} == dict(zip(want, want[1:] + want[:1], strict=True))


def test_imatch_by_brute_force(spark, docs):
    """Lexicon, levels, subsets, fingerprints and likeness worked out in Python (hashes by Spark)."""
    import math
    import re

    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    words = {r["doc_id"]: {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", r["text"].lower()) if w} for r in rows}
    vocabulary = sorted(set().union(*words.values()))
    code = dict(zip(vocabulary, (x[0] for x in spark.createDataFrame([(w,) for w in vocabulary], "w string").coalesce(1).select(F.xxhash64("w")).collect()), strict=True))
    df = {}
    for ws in words.values():
        for w in ws:
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    lexicon = {code[w] for w, c in df.items() if max(2, 0.001 * n) <= c <= max(2, 0.5 * n)}
    assert sorted(lexicon) == imatch.lexicon(docs)
    got = as_dict(imatch.fingerprints(docs))
    kept = {i: sorted(code[w] for w in ws if code[w] in lexicon) for i, ws in words.items()}
    coins = dict(spark.createDataFrame([(t,) for t in sorted(lexicon)], "t long").select("t", F.xxhash64("t")).collect())
    wanted, lists = {}, set()
    for i, ts in kept.items():
        if ts:
            level = 0 if len(ts) < 3 else int(math.log2(len(ts) / 1.5))
            wanted[i] = level, [tuple(t for t in ts if ((coins[t] % (1 << 64)) >> (5 * k)) & ((1 << lv) - 1) == 0) for lv in (level, level + 1) for k in range(imatch.SUBSETS)]
            lists |= set(wanted[i][1])
    order = sorted(lists)
    hashes = dict(zip(order, (x[0] for x in spark.createDataFrame([([(x, coins[x]) for x in z],) for z in order], "z array<struct<t:bigint,v:bigint>>").coalesce(1).select(F.xxhash64("z")).collect()), strict=True))
    assert len(wanted) > 0.9 * n
    prints = {}
    for i, (level, subsets) in wanted.items():
        prints[i] = level, [hashes[z] if z else 0 for z in subsets]
        assert got[i]["fingerprint"] == f"{level:02x}" + "".join(f"{h % (1 << 64):016x}" for h in prints[i][1])

    def like(f, g):
        if f == g:
            return 1.0
        s, (a, x), (b, y) = imatch.SUBSETS, f, g
        pairs = list(zip(x, y, strict=True)) if a == b else list(zip(x[s:], y[:s], strict=True)) if a + 1 == b else list(zip(x[:s], y[s:], strict=True)) if a == b + 1 else []
        pairs = [z for z in pairs if z != (0, 0)]
        return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0

    for k, r in enumerate(rows):
        i, j = r["doc_id"], rows[(k + 1) % n]["doc_id"]
        if i in prints and j in prints:
            assert got[i]["near_next"] == pytest.approx(like(prints[i], prints[j]))


@pytest.mark.parametrize("kind, ids", [
    ("bigint", [2**63 - 1, -(2**63), 0, 5, 2**63 - 2, None, None]),
    ("string", ["doc-a", "doc-b", "doc-aa", "doc-", "doc-é", None, "doc-b"]),
    ("smallint", [3, 1, 2, 2, None, -7, 300]),
    ("date", ["2020-01-01", "1950-01-01", "2020-01-02", None, "2020-01-01", "2021-05-05", "1999-01-01"]),
])
def test_imatch_ids_of_any_kind(spark, monkeypatch, kind, ids):
    monkeypatch.setattr(imatch, "GROUP_ROWS", 2)
    d = spark.createDataFrame([(None if i is None else str(i), f"text {n}") for n, i in enumerate(ids)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    in_order = [r["text"] for r in d.coalesce(1).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    got = {r["text"]: r["next_text"] for r in imatch.with_next(d, "doc_id", ["text"], "text").collect()}
    assert got == dict(zip(in_order, in_order[1:] + in_order[:1], strict=True))
    assert imatch.fingerprints(d).count() == len(ids)


def test_imatch_hot_ids_are_parted(spark, monkeypatch):
    monkeypatch.setattr(imatch, "GROUP_ROWS", 5)
    rows = [(7, f"hot {k}") for k in range(100)] + [(k, f"other {k}") for k in range(60) if k != 7] + [(None, f"none {k}") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    in_order = [r["text"] for r in d.coalesce(1).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    got = {r["text"]: r["next_text"] for r in imatch.with_next(d, "doc_id", ["text"], "text").collect()}
    assert got == dict(zip(in_order, in_order[1:] + in_order[:1], strict=True))


def test_imatch_likeness_of_equal_texts(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "中文没有空格"), (4, "中文没有空格"), (5, "另外一个句子")], "doc_id long, text string")
    got = as_dict(imatch.fingerprints(d))
    assert got[1]["near_next"] == got[1]["near_edited"] == got[2]["near_edited"] == got[3]["near_next"] == 1.0
    assert got[3]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"] and got[4]["near_next"] < 1


def test_imatch_on_odd_input(spark):
    got = imatch.fingerprints(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 4 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert imatch.fingerprints(empty_docs(spark)).count() == 0
    plan = imatch.fingerprints(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- licences ----------------------------------------------------------------------------------


def test_licences_by_brute_force(spark):
    """Against all stretches of all templates' lengths, which hold those that are laid by an anchor."""
    import math
    from collections import Counter

    xs, idf, rare = licenses.templates()

    def slow(text):
        found, best = licenses.terms(text or ""), None
        for x in xs:
            n = len(x.terms)
            stretches = [found[i : i + n] for i in range(max(1, len(found)))] + ([found] if x.kind == "file" and len(found) <= 4 * n else [])
            for tf in map(Counter, stretches):
                norm = math.sqrt(sum(((1 + math.log(c)) * idf.get(t, rare)) ** 2 for t, c in tf.items()))
                c = round(sum((1 + math.log(c)) * idf.get(t, rare) * x.weight.get(t, 0.0) for t, c in tf.items()) / norm, 6) if norm else 0
                if c >= licenses.LEAST_COSINE and all(need & set(tf) for need in x.needs):
                    best = max(best or (0,), (c, n, x.licence))
        return best

    scanner = licenses.Scanner()
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect() if len(r["text"]) < 2500]
    texts += ["# Licensed under the Apache license version 2.0 by us", "SPDX-License-Identifier: MIT", "permission is hereby granted, free of charge, to any person", None, "mit dem Hund, mit der Katze und mit mir"]
    texts += licenses.FILES["ISC"] + licenses.OPENINGS["GPL-2.0"]
    found = 0
    for t in texts:
        got, want = scanner.text(t), slow(t)
        assert (got is None) == (want is None) and (got is None or (got[0], got[1]) == (want[2], want[0]))
        found += got is not None
    assert found > 5


GPL2 = """#!/usr/bin/perl
# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
"""


def test_licences_of_real_headers_and_files():
    s = licenses.Scanner()
    filler = " code words of some program that goes on" * 60
    assert s.text(GPL2 + filler)[0] == "GPL-2.0" and s.text(GPL2.replace("version 2", "version 3") + filler)[0] == "GPL-3.0"
    assert s.text(GPL2.replace("General", "Lesser General").replace("version 2", "version 2.1") + filler)[0] == "LGPL-2.1"
    assert s.text("we are all, I think, licensed under the MIT license these days" + filler)[0] == "MIT" and not s.text("we are licensed under the MIT license" + filler)[4]
    for lic, t in licenses.FILES.items():
        whole = s.text("Copyright (c) 2019 Some Body and others\nAll rights reserved.\n\n" + t[0])
        assert whole[0] == lic and whole[4]
        inside = s.text("/* " + t[0] + " */" + filler * 5)
        assert inside[0] == lic and not inside[4]
    for lic, t in licenses.OPENINGS.items():
        assert s.text(t[0] + filler * 20)[0] == lic and s.text(t[0] + filler * 20)[4]


def test_licence_files_in_nested_folders(spark):
    code = "def f(): return 1"
    files = [("r/LICENSE", licenses.FILES["MIT"][0]), ("r/src/a.py", code), ("r/src/deep/er/b.py", None), ("r/vendor/COPYING", licenses.OPENINGS["GPL-3.0"][0] + " and so on" * 500), ("r/vendor/x/c.c", code)]
    files += [("r/src/gpl.c", GPL2 + code * 50), (None, "Released under the MIT License"), (None, code), ("r/src/twice.py", code), ("r/src/twice.py", "Licensed under CC BY 4.0 " + code * 30)]
    rows = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
    got = {r["path"]: (r["licence"], r["origin"], r["origin_dir"]) for r in rows if r["path"]}
    assert len(rows) == len(files) and got["r/src/a.py"] == got["r/src/deep/er/b.py"] == ("MIT", "directory", "r") and got["r/vendor/x/c.c"] == ("GPL-3.0", "directory", "r/vendor")
    assert got["r/src/gpl.c"][:2] == ("GPL-2.0", "file")
    assert sorted((r["licence"] or "", r["origin"]) for r in rows if r["path"] is None) == [("", "none"), ("MIT", "file")]
    assert sorted((r["licence"], r["origin"]) for r in rows if r["path"] == "r/src/twice.py") == [("CC-BY-4.0", "file"), ("MIT", "directory")]


def test_licence_inheritance(spark):
    files = [
        ("a/LICENSE", "The MIT License (MIT)"), ("a/b/x.py", "code"), ("a/b/LICENSE", "Apache License Version 2.0, January 2004"), ("a/b/c/y.py", ""), ("top.txt", None),
        (None, "Released under the MIT License"), ("z/q.py", "Licensed under CC BY 4.0\n" + "code " * 30), ("z/r.py", "hello"), ("a/s.py", "Licensed under CC BY 4.0\n" + "code " * 30),
    ]
    got = {r["path"]: (r["licence"], r["origin"], r["origin_dir"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/b/x.py"] == ("Apache-2.0", "directory", "a/b") and got["a/b/c/y.py"] == ("Apache-2.0", "directory", "a/b")
    assert got["a/s.py"] == ("CC-BY-4.0", "file", None) and got["z/r.py"] == (None, "none", None) and got["top.txt"][0] is None and got[None][0] == "MIT"


def test_licences_on_odd_input(spark):
    assert licenses.document_licenses(odd_docs(spark)).count() == len(ODD) + 4
    assert licenses.document_licenses(empty_docs(spark)).count() == 0


# -- decontamination ---------------------------------------------------------------------------


def test_exact_leaks_by_brute_force(spark, docs):
    benchmark = table(spark, SF, "benchmark")
    items = {r["item_id"]: decontaminate.normal(r["text"].encode()) for r in benchmark.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in decontaminate.normal(r["text"].encode())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).where("distance = 0").collect()}
    assert got == want and want


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return min(row)


def test_altered_leaks(spark):
    import numpy as np

    r, q = np.random.default_rng(4), random.Random(4)
    items = [(i, decontaminate.normal(x["text"].encode())) for i, x in enumerate(table(spark, SF, "benchmark").collect())]
    filler = [x["text"].encode() for x in table(spark, SF, "documents").select("text").collect()]
    block = decontaminate.Block(items)
    texts, want = [], []
    for k in range(160):
        i, t = items[k % len(items)]
        words = decontaminate.normal(filler[k % len(filler)][:2000]).split()
        at = q.randint(0, len(words))
        texts.append(b" ".join([*words[:at], decontaminate._alter(t, int(len(t) * decontaminate.ERROR_SHARE), r), *words[at:]]))
        want.append((k, k % len(items)))
    got = block.search(texts)
    assert sum(w in got for w in want) >= 0.95 * len(want)
    for (k, j), (d, _) in list(got.items())[:25]:
        assert d == slow_distance(items[j][1], texts[k]) <= block.budget(len(items[j][1]))
    assert not block.search([decontaminate.normal(b"nothing of the sort stands here " * 40)])


def test_decontamination_on_odd_input(spark):
    benchmark = spark.createDataFrame([(1, "Some Short passage"), (2, None), (None, "x"), (3, ""), (1, "Some Short passage"), (4, "tiny")], "item_id long, text string")
    d = odd_docs(spark).unionByName(odd_docs(spark).limit(1).withColumns({"doc_id": F.lit(500).cast("long"), "text": F.lit("before\n some  SHORT\tpassage after")}))
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, benchmark).collect()]
    assert got == [(500, 1)]
    assert decontaminate.leaks(d, benchmark.limit(0)).count() == 0 == decontaminate.leaks(empty_docs(spark), benchmark).count()
    flags = decontaminate.flagged(d, benchmark, "n_leaks").collect()
    assert len(flags) == d.count() and sum(r["n_leaks"] for r in flags) == 1


def test_altered_leaks_of_long_items():
    import numpy as np

    r, q = np.random.default_rng(6), random.Random(6)
    vocabulary = ["".join(q.choices("etaoinshrdlucm", k=q.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(q.choices(vocabulary, k=n // 5)).encode()[:n].strip()
    items = [(i, prose(n)) for i, n in enumerate([350, 700, 1500, 1500, 1600, 5000, 5000, 5200])]
    block = decontaminate.Block(items)
    assert all(c["direct"] or c["recall"] >= decontaminate.TARGET_RECALL for c in block.classes)
    texts = [prose(300) + b" " + decontaminate._alter(items[k % 8][1], block.budget(len(items[k % 8][1])), r) + b" " + prose(300) for k in range(80)]
    got = block.search(texts)
    assert sum((k, k % 8) in got for k in range(80)) >= 78
    assert all(d <= block.budget(len(items[j][1])) and k % 8 == j for (k, j), (d, _) in got.items())


def test_leaks_without_blanks():
    import numpy as np

    r, q = np.random.default_rng(7), random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    han = lambda n: "".join(q.choices(letters, k=n)).encode()
    items = [(i, han(90)) for i in range(20)] + [(20, b"plain words that stand glued to other signs in this one")]
    block = decontaminate.Block(items)
    exact = [han(200) + t + han(200) for _, t in items[:20]] + [b"so it says:xy" + items[20][1] + b"zz and on"]
    got = block.search(exact)
    assert all(got.get((k, k), (1,)) == (0, exact[k].find(items[k][1]) + len(items[k][1])) for k in range(21))
    altered = []
    for _, t in items[:20]:
        x = t.decode()
        for _ in range(6):
            at = q.randrange(len(x))
            x = x[:at] + q.choice(letters) + x[at + 1 :]
        altered.append(han(200) + x.encode() + han(200))
    got = block.search(altered)
    assert sum((k, k) in got for k in range(20)) >= 19


def test_language_beyond_sixty(spark):
    r = random.Random(12)
    rows = []
    for k in range(75):
        vocabulary = ["".join(r.choices([chr(0x400 + 3 * k + i) for i in range(6)], k=r.randint(2, 7))) for _ in range(40)]
        for _ in range(14 if k < 60 else 10):  # the last fifteen are the rarest
            rows.append((len(rows), " ".join(r.choices(vocabulary, k=120)), f"x{k:02}"))
    truth = {i: lang for i, _, lang in rows}
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    rare = [x["lang_pred"] == truth[x["doc_id"]] for x in got if truth[x["doc_id"]] >= "x60"]
    assert len(rare) > 20 and sum(rare) > 0.9 * len(rare)
