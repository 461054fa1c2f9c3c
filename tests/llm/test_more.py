"""Broken pages, doubles of matchers and of the risk, many templates and items, cells of embeddings, odd columns in the pipeline."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from axonframe.llm import covertree, decontaminate, html, licenses, quality, toxicity, urls

from .test_operators import brute_links

TREE = html.train()
LONG = "<p>" + "word " * 40 + "</p>"
WORDS = "word " * 39 + "word"


# 6: HTML


def test_the_tree_uses_the_links_of_neighbours():
    assert (TREE(np.array(html.LABELLED)[:, :-1]) >= 0.5).tolist() == [bool(r[-1]) for r in html.LABELLED]
    assert any("links_before" in x or "links_after" in x for x in html.splits(TREE)) and any(x.strip().startswith("words ") for x in html.splits(TREE))
    teaser = "<p>" + "some words of a teaser that stands here " * 2 + "</p>"
    menu = "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"
    # nothing is marked: the same words are dropped between links and kept among text
    assert html.main_text(f"<body>{menu}{teaser}{menu}{LONG}{LONG}", TREE) == f"{WORDS}\n{WORDS}"
    assert "teaser" in html.main_text(f"<body>{menu}{LONG}{teaser}{LONG}", TREE)


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>t</title><body><article><p>x y z</p></article>", "x y z"),
    (f"<form id=f>{LONG}{LONG}</form>", f"{WORDS}\n{WORDS}"),
    (f'<div class="content with-sidebar">{LONG}<div class="sidebar"><p>{"side " * 20}</p></div></div>', WORDS),
    ("<article><p>kept words</p><p class='advert'>buy this</p><p>end</p></article>", "kept words\nend"),
    ("<article><p>kept words</p><h2 class=promo>buy</h2><p>end</p></article>", "kept words\nend"),
    ("<article><p>a <span class=ad>buy</span> b</p></article>", "a b"),
    ("<article><header><h1>Title</h1></header><p>text</p><footer>by</footer></article>", "Title\ntext"),
    ("<header><h1>Site</h1></header><article><p>text</p></article>", "text"),
    ('<article><p>see <a href="x>link</a> only</p></article>', "see link only"),
    ('<article><p>a <a href="x>link</a> and <a href="y">more</a></p></article>', "a link and more"),
    ('<article><p title="a > b" data-x=\'<i>\'>x</p></article>', "x"),
    ("<article><p>short</p><div class=comments><p>" + "so nice " * 30 + "</p></div></article>", "short"),
    ("<div class='has-comments'><article><p>short</p></article><div id=comments><article><p>" + "so nice " * 3 + "</p></article></div></div>", "short"),
    ("<div class=related><article><p>other</p></article></div><article><p>" + "main words " * 5 + "</p></article>", ("main words " * 5).strip()),
    ("<p hidden>no</p><article><div style='display:none'>no</div><p>yes</p></article>", "yes"),
])
def test_broken_and_wrapped_pages(page, text):
    assert html.main_text(page, TREE) == text


@pytest.mark.parametrize("piece", ["<div ", "<div \"'", "<a href='x", "<option>", "<button>", "<!--", "<div><p class='x", "<", "</div", "<a b=", "<p class= id= ", "<select><option>", "<div></p>"])
def test_time_grows_with_the_page(piece):
    def took(n):
        page = piece * (n // len(piece)) + "</option></button></div>\"'"
        began = time.process_time()
        html.main_text(page, TREE)
        return time.process_time() - began

    assert took(1_000_000) < 2 + 16 * took(125_000)


# 1: toxicity


def plain_matches(lexicon, text):
    """Starts of terms in folded text and their weights, by looking at every place."""
    folded = " " + toxicity.fold(text)
    spans = [(i, i + len(p) + 1) for p in (" " + " ".join(toxicity.fold(e).split()) for e in lexicon.exceptions) for i in range(len(folded)) if folded.startswith(p, i) for p in [p[1:]]]
    out = {}
    for i, c in enumerate(folded[:-1]):
        if c == " ":
            hits = [t for t in lexicon.terms if folded.startswith(t, i + 1)]
            if hits:
                t = max(hits, key=len)
                if not any(a <= i and i + 1 + len(t) <= b for a, b in spans):
                    out[i + 1] = lexicon.terms[t]
    return out, max(1, len(folded.split()))


def test_matcher_against_brute_force():
    r = np.random.default_rng(3)
    lexicon = toxicity.Lexicon({toxicity.fold(k): v for k, v in (toxicity.SEED_TERMS | {"idioti": 1.5, "stu": 0.5, "very long term of words": 2.0}).items()})
    vocabulary = ["idiot", "idiotic", "stupid", "stump", "trash", "can", "bin", "the", "not", "an", "clown", "fish", "loser", "a", "l0ser", "“moron”", "ídiot", "𝐢𝐝𝐢𝐨𝐭", "you—idiot", "very", "long", "term", "of", "words", "ok"]
    for _ in range(300):
        text = " ".join(r.choice(vocabulary, r.integers(0, 30)))
        hits, words = plain_matches(lexicon, text)
        a, b, n = lexicon.measure(text)
        total = sum(hits.values())
        assert n == len(hits) and a == pytest.approx(math.log1p(total / math.log(10 + words))) and b == pytest.approx(math.log1p(100 * total / words)), text


def test_styled_letters_and_exceptions_in_long_texts():
    lexicon = toxicity.Lexicon({toxicity.fold(k): v for k, v in toxicity.SEED_TERMS.items()})
    assert all(lexicon.measure(t)[2] == 1 for t in ("ídiot", "𝐢𝐝𝐢𝐨𝐭", "𝐈𝐃𝐈𝐎𝐓", "you<idiot>", "ｉｄｉｏｔ", "ídiot"))
    text = "a trash can and trash " * 20_000
    began = time.process_time()
    assert lexicon.measure(text)[2] == 20_000 and time.process_time() - began < 3
    # more of the same weight keeps counting, however long the text is
    assert lexicon.measure("idiot " * 5000)[0] > lexicon.measure("idiot " * 500)[0]


def test_long_words_are_terms_and_odd_labels_do_not_count(spark):
    rows = [(i, f"text n{i} antidisestablishmentarian{'ism' if i % 4 == 0 else 'ist'} here", int(i % 4 == 0)) for i in range(200)] + [(900, "x", 7), (901, "y", -1), (902, "z", None), (903, "both", 0), (903, "both", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(i, f"other text {k}") for i in range(200, 230) for k in range(20)], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert lexicon.measure("antidisestablishmentarianism")[2] == 1 and lexicon.measure("antidisestablishmentarianist")[2] == 0


# 9: quality


def test_risk_and_gradient_against_brute_force():
    r = np.random.default_rng(5)
    pos, unl = r.normal(1, 1, (30, 4)), r.normal(0, 1, (50, 4))
    x = np.concatenate([pos, unl])
    signs = set()
    for prior in (0.1, 0.5, 0.9, 0.99):
        net = quality.Net(4, 3, 1) if prior < 0.6 else quality._train(pos, unl, None, 1, 60, 3)

        def parts():
            fp, fu = net(pos), net(unl)
            loss = lambda f, y: sum(math.log1p(math.exp(-y * v)) for v in f) / len(f)
            return prior * loss(fp, 1), loss(fu, -1) - prior * loss(fp, -1)

        first, rest = parts()
        assert quality.risk_parts(net(pos), net(unl), prior) == pytest.approx((first, rest))
        signs.add(rest >= 0)
        goal = lambda: sum(parts()) if rest >= 0 else -parts()[1]
        for g, p in zip(net.gradient(x, quality.descent(net(pos), net(unl), prior)), net.p):
            for at in np.ndindex(p.shape):
                keep = p[at]
                p[at] = keep + 1e-6
                up = goal()
                p[at] = keep - 1e-6
                down = goal()
                p[at] = keep
                assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    assert signs == {True, False}


# 10: decontamination


def test_sketches_reach_the_stated_chance():
    for size in (1, 2, 3, 4, 5, 9, 10, 25, 60, 400):
        lacking, k = size - math.ceil(0.8 * size - 1e-9), decontaminate.sketch_size(size)
        missed = math.comb(lacking, k) / math.comb(size, k)
        assert k <= lacking + 1 and missed <= decontaminate.MISS


def test_items_scattered_over_a_document(spark):
    r = np.random.default_rng(8)
    items = [(i, " ".join(f"w{x}" for x in r.integers(0, 400, r.integers(1, 60)))) for i in range(120)]
    docs = []
    for d in range(40):
        text = []
        for i in r.integers(0, 120, 12):
            w = items[i][1].split()
            cut = r.integers(0, len(w))
            text += w[cut:] + [f"x{d}"] + w[: cut + 4]
        docs.append((d, " ".join(text)))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = {}
    for d, t in docs:
        for i, x in items:
            n = min(5, len(x.split()))
            own = grams(x.split(), n)
            share = len(own & grams(t.split(), n)) / len(own)
            if share >= 0.8:
                want[d, i] = share
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.containment for x in found.collect()} == pytest.approx(want) and len(want) > 40


def test_many_tiny_items_stay_small():
    index = decontaminate._index([(i, f"word{i}".encode()) for i in range(200_000)], 0.8)
    assert sum(x.nbytes for x in (index.flat, index.sizes, index.starts, index.keys, index.items, index.filter)) < 16 << 20
    assert sorted(i for i, _ in index.search([b"word7", b"other", b"word199999"])) == [7, 199_999]
    assert len(list(index.search([f"word{i}".encode() for i in range(5_000)]))) == 5_000


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 20)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(10)]
    docs = spark.createDataFrame([(1, items[3][1]), (2, items[9][1] + " " + items[0][1]), (3, "none")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(1, 3), (2, 0), (2, 9)]


# 8: licences


def test_many_long_templates(spark):
    r = np.random.default_rng(9)
    texts = {f"L{i}": [f"v{x}" for x in r.integers(0, 3000, 200 + i)] for i in range(300)}
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "license string, text string")
    rows, want = [], set()
    for d in range(30):
        own = [f"o{x}" for x in r.integers(0, 3000, 300)]
        name = f"L{(d * 7) % 300}"
        part = texts[name] if d % 3 else texts[name][: len(texts[name]) // 2]
        rows.append((d, " ".join(own[:150] + part + own[150:])))
        if d % 3:
            want.add((d, name))
    rows += [(100, None), (101, ""), (102, "v1 v2")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), table)
    assert len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 60
    assert {(x.doc_id, x.license) for x in found.collect()} == want


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    bits = licenses.bits_of(keys)
    assert keys.where(licenses.may_hold(keys["key"], bits)).count() == 5000
    others = spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS key")
    assert others.where(licenses.may_hold(others["key"], bits)).count() < 10


# 3: embeddings


def test_cells_skip_each_other(spark):
    r = np.random.default_rng(4)
    centers = r.normal(size=(40, 16))
    rows = [(i, (centers[i % 40] + 0.12 * r.normal(size=16)).tolist(), 1) for i in range(2400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = frame.selectExpr("label", "embedding", "vec_id AS node", "1L AS copies", "xxhash64(embedding) AS code")
    dealt = covertree.spread(classes, block=50)
    cells = dealt.select("cell").distinct().count()
    assert cells > 40 and dealt.count() < 2400 * cells / 8
    got = {x.vec_id: x for x in covertree.near_duplicates(frame, block=50).collect()}
    x = np.array([e for _, e, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert [got[i].n_links for i in range(2400)] == links.tolist()


def test_embeddings_odd(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [2.0, 0.001], 1), (7, [1e200, 1e190], 1), (8, [1e-310, 0.0], 1), (9, [0.0, 1.0], 1), (3, [0.0, -1.0], 1)]
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node string, cell int, code long")
    got = sorted(((x.vec_id is None, x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in covertree.near_duplicates(frame).collect()))
    assert got == [(False, 3, 0, 3, True), (False, 5, 4, 5, True), (False, 5, 4, 5, True), (False, 7, 4, 5, False), (False, 8, 4, 5, False), (False, 9, 0, 9, True), (True, 0, 4, 5, False)]
    assert brute_links([(1, [1.0, 0.0], 1), (2, [2.0, 0.001], 1)])[0].tolist() == [1, 1]


# 5: URLs


def test_very_long_url(spark):
    rows = [(1, "http://a.casino-x.net/" + "p" * 200_000), (2, "h" * 200_000), (3, "http://" + "h." * 50_000 + "org/x")]
    table = urls.rule_table(spark, [urls.site_rule("allow", "org", "/"), urls.pattern_rule("block", *urls.PATTERNS[0])])
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), table).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: ("org/", "allow")}


# pipeline


ODD = "doc_id long, text string, lang string, source string, n_chars int, text_hash string, rk1 string, row int, quality_score double, n_removed string, extra int, id string, hash int, _ int"


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_keep_clashing_columns(spark, tmp_path, odd_rows, name):
    stage = dict(P.STAGES)[name]
    rows = [(i, t, None, "s", 3, "clash", "clash", 7, 0.25, "clash", 8, "clash", 9, 4) for i, t in odd_rows]
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no id here at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part in (rows, []):
        docs = spark.createDataFrame(part, ODD)
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "best_fit_packing":
            assert sum(r.piece == 0 for r in got) == len(part)
            continue
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert all((r.text_hash, r.rk1, r.row, r.quality_score, r.n_removed, r.extra, r.id, r.hash, r["_"]) == ("clash", "clash", 7, 0.25, "clash", 8, "clash", 9, 4) for r in got)
        if part:
            kept = {"quality_classifier": 11, "simhash_near_dedup": 7, "substring_dedup": 11, "benchmark_decontamination": 10}
            assert len(got) == kept[name]


def test_stage_without_n_chars(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    assert P.substring_dedup(spark, docs, "").columns == ["doc_id", "text"]


def test_arrow_kinds_of_words():
    """Joined encoding gives what encoding one by one gives."""
    from axonframe.llm import packing

    words = pa.array([*"the quick brown été naïve zzzqqqxxx a".split(), "x" * 3000], pa.large_string())
    parts = packing.Parts(packing.default_tokenizer())
    flat, lengths = parts._words(words)
    other, n = parts._one_by_one(words.to_pylist())
    assert flat.tolist() == other.tolist() and lengths.tolist() == n.tolist()


def test_parts_kept_are_bounded():
    from axonframe.llm import packing

    parts = packing.Parts(packing.default_tokenizer(), most_bytes=3000)
    for k in range(20):
        words = pa.array([f"w{'abcdefghij'[i % 10]}{'abcdefghijklmnopqrst'[k]}" for i in range(40)] + ["."], pa.large_string())
        flat, lengths = parts.encode(words, np.array([True] * 40 + [False]))
        want = [parts.tokenizer.encode(w, add_special_tokens=False).ids for w in words.to_pylist()]
        assert flat.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))
        assert parts.known.nbytes + parts.flat.nbytes + parts.lengths.nbytes <= 3000
