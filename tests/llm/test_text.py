"""HTML extraction, decontamination, quality rules, language ID against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import decontaminate, html_extract, language_id, quality, queries
from tests.llm import cases

ARTICLE = "<h1>A  title &amp; more</h1><p>one two three\nfour <b>five</b> six &lt;tag&gt; seven<p>eight nine ten eleven twelve <a href='x'>thirteen</a> fourteen<ul><li>fifteen sixteen seventeen</li></ul>"
WANT = "A title & more\n\none two three four five six <tag> seven\n\neight nine ten eleven twelve thirteen fourteen\n\nfifteen sixteen seventeen"
BEFORE = "<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a='</p>';</script></head><body><header><a href='/'>Site</a> motto</header><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- <p>gone</p> -->"
AFTER = "<aside><p>side words that go on and on for a while</p></aside><section id='comments'><p>what a good read that was, thank you very much</p></section><form>mail <input><button>send it</button></form><footer>&copy; all rights reserved</footer>"
SHELLS = ["<article>{}</article>", "<main><div>{}</div></main>", "<div id='content'>{}</div>", "<div class='layout with-sidebar'><div class='post-header'></div>{}</div>", "<div>{}</div>", "{}"]


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("ends", ["</body></html>", ""])
def test_main_text(shell, ends):
    inside = ARTICLE.replace("<ul>", "<div class='advert'>buy now buy now</div><div class=\"cookie-notice\"><p>we use cookies on this site of ours</p></div><ul>")
    assert html_extract.extract(BEFORE + shell.format(inside) + AFTER + ends) == WANT


def test_odd_pages():
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>no end") == html_extract.extract("<!-- no end") == ""
    assert html_extract.extract("plain words only") == "plain words only"
    assert html_extract.extract("<p>3 < 4 and 5 > 2 in every case") == "3 < 4 and 5 > 2 in every case"


def test_region_has_the_largest_sum():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0, 4.0]) for _ in range(rng.randint(0, 25))]
        a, b = html_extract.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_html_query(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", BEFORE + ARTICLE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", BEFORE + ARTICLE, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.html_extract(pages).collect())
    assert got == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert html_extract.html_extract(pages.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def hits(text, items, size=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        ws = WORD.findall((t or "").translate(LOWER))
        m = min(size, len(ws))
        windows = {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)} if m else set()
        for k in range(len(words) - m + 1 if m else 0):
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontaminate(spark, block):
    rng = random.Random(2)
    abc = ["a", "b", "c", "É", "d1"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(abc) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([1, 2, 3, 9, 10, 11, 30, 30, 14, 12])] + [(3, say(12)), (None, "q r s"), (50, None), (51, ""), (52, "!?")]
    items[0] = (0, "zzz")
    docs = [(k, say(rng.randint(0, 60))) for k in range(40)] + [(100, "x " + items[6][1].upper() + " y"), (101, "zzz"), (102, "Q-R-S Q-R-S")] + cases.ROWS[:9]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(cases.frame(spark, docs), bench, block_chars=block)
    got = sorted(repr(tuple(r)) for r in out.collect())
    assert got == sorted(repr((i, *hits(t, items))) for i, t in docs)
    assert {r.n_hit for r in decontaminate.decontaminate(cases.frame(spark), bench.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(cases.empty(spark), bench).count() == 0


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def base_figures(text):
    words = SPLIT.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    cover = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)]


def test_base_figures():
    rng = random.Random(4)
    rows = [t for _, t in cases.ROWS] + ["".join(rng.choices(["a ", "b ", "c#", "\n", "a b c ", "é<", "\t", "\x85", "\r\n"], k=rng.randint(0, 60))) for _ in range(200)]
    for text in rows:
        assert quality.describe(text)[0] == base_figures(text)


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    y[rng.random(800) < 0.03] = 0
    forest = quality.fit(x, y, [-1, 0, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.93
    grid = np.tile(rng.random((50, 3)), (20, 1))
    grid[:, 0] = np.repeat(np.linspace(0, 1, 20), 50)
    steps = np.diff(forest.score(grid).reshape(20, 50), axis=0)
    assert (steps <= 1e-12).all()

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if row[forest.feature[at]] <= forest.cut[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:40]), [walk(r) for r in x[:40]])


def test_quality(spark, sf_dir):
    docs, labels = (queries.table(spark, sf_dir, t) for t in ("documents", "labels"))
    forest = quality.fit_forest(docs, labels)
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.quality_verdicts(docs, forest).collect()}
    good = [kept[r.doc_id] for r in labels.filter("quality = 1").collect()]
    bad = [kept[r.doc_id] for r in labels.filter("quality = 0").collect()]
    assert sum(k for k, f in good if not f) >= 0.97 * sum(not f for _, f in good)
    assert sum(k for k, _ in bad) <= 0.35 * len(bad)
    rows = quality.quality_verdicts(cases.frame(spark), forest).collect()
    assert len(rows) == len(cases.ROWS) and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    none = quality.fit_forest(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality.quality_verdicts(docs, none).collect())
    assert quality.quality_verdicts(cases.empty(spark), forest).count() == 0


def all_ways(model, word, j):
    """The sum over all segmentations, one by one."""
    s = language_id._START + word
    if not s:
        return 1.0

    def go(at):
        if at == len(s):
            return 1.0
        return sum(go(e) * (model.pieces[s[at:e]][j] if s[at:e] in model.pieces else language_id.FLOOR) for e in range(at + 1, len(s) + 1) if s[at:e] in model.pieces or e == at + 1)

    return go(0)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language_id.fit_model(queries.table(spark, sf_dir, "documents"))


def test_forward_sums_all_segmentations(model):
    for word in ("the", "der", "éteint", "anthe", "ñqx"):
        for j, got in enumerate(model.word(word)):
            assert np.isclose(np.exp(got), all_ways(model, word, j), rtol=1e-9)
    many = ["the", "a", "éteint", "x" * 27, "ñ" * 28, "the" * 10, "ñqxß", "日本", "donaudampfschifffahrt"]
    assert np.allclose(model.words(many), [model.word(w) for w in many], rtol=1e-9)
    long = model.word("the" * 400)
    assert np.isfinite(long).all()
    assert np.allclose(np.asarray(list(zip(*model.pieces.values(), strict=True))).sum(1), 1)


def test_held_out_accuracy(spark, sf_dir, model):
    docs = queries.table(spark, sf_dir, "documents")
    found = {r.doc_id: r for r in language_id.language_id(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = {i: r for i, r in found.items() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in found.items() if r.held_out} == set(out)
    assert np.mean([r.lang_pred == truth[i] for i, r in out.items()]) > 0.9
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_edges(spark, model):
    rows = {r.doc_id: r for r in language_id.language_id(cases.frame(spark, [(1, None), (2, ""), (3, "12 34 !?"), (4, "the of and"), (5, "der die und nicht")]), model).collect()}
    assert [rows[k].lang_pred for k in range(1, 6)] == ["und", "und", "und", "en", "de"]
    assert rows[1].score == 0
    assert language_id.language_id(cases.frame(spark), model).count() == len(cases.ROWS)
    blank = language_id.fit_model(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    assert language_id.language_id(cases.frame(spark, [(4, "the")]), blank).first().lang_pred == "und"


def test_expected_counts_over_all_segmentations():
    """The E step against every segmentation one by one."""
    from math import prod

    pieces = sorted({"▁", "▁a", "a", "b", "ab", "ba", "aab", "é", "bé", "▁b"})
    p = np.random.default_rng(3).random(len(pieces)) / 4
    words = {"aab": 3, "abab": 2, "bébé": 1, "axb": 4, "b": 2, "aaaaab": 1}
    lattice = language_id.Lattice(list(words), language_id.Trie([x.encode() for x in pieces]), {x for x in pieces if len(x) == 1}, len(pieces))
    got = lattice.expected(np.log(np.append(p, language_id.FLOOR)), np.asarray(list(words.values()), float))
    want = np.zeros(len(pieces) + 1)
    for word, times in words.items():
        s = "▁" + word

        def ways(at, s=s):
            if at == len(s):
                yield []
            for e in range(at + 1, len(s) + 1):
                k = pieces.index(s[at:e]) if s[at:e] in pieces else len(pieces) if e == at + 1 else None
                if k is not None:
                    yield from ([k, *rest] for rest in ways(e))

        chances = [(w, prod(np.append(p, language_id.FLOOR)[k] for k in w)) for w in ways(0)]
        total = sum(c for _, c in chances)
        for w, c in chances:
            for k in w:
                want[k] += times * c / total
    assert np.allclose(got, want, rtol=1e-9)


def test_a_repeated_id_or_text_crowds_out_nothing(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    flood = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("flood of words "), "id").alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(3000).select((F.col("id") + 10**7).alias("doc_id"), F.lit("the same text over and over").alias("text"), F.lit("de").alias("lang"))
    dirty = spark.range(4000).select((F.col("id") + 10**8).alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    clean = language_id.fit_model(docs)
    model = language_id.fit_model(docs.unionByName(flood).unionByName(copies).unionByName(dirty), fit_languages=12)
    assert set(clean.languages) < set(model.languages) and len(model.languages) == 12
    rows = docs.filter(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    found = language_id.language_id(rows, model).join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in found if r.lang_pred != "und"]) > 0.9


def test_long_words_are_learnt(spark):
    rows = [(k, "donaudampfschifffahrt" * 40 + " und", "de") for k in range(20)] + [(k + 100, "the cat of " + "x" * 3000, "en") for k in range(20)]
    model = language_id.fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = language_id.Scorer(model)
    assert scorer(["donaudampfschifffahrt " * 3, "x" * 50_000, "", None])[0] == ["de", "en", "und", "und"]


SAY = "This is a sentence of many words that goes on for a while. "


def test_pages_read_as_browsers_do():
    ex = html_extract.extract
    two = ex(f'<article><p class="x"">MIDDLE {SAY * 3}</p><p class="y">SECOND {SAY * 3}</p></article>')
    assert two.startswith("MIDDLE This") and "\n\nSECOND This" in two and '">' not in two
    assert ex(f"<article><p>A {SAY * 3}</p><!--><p>B {SAY * 3}</p><!---><p>C {SAY}</p><!-- x --!><p>D {SAY}</p></article>").count("\n\n") == 3
    assert ex(f"<article><p>{SAY * 3}</p><script/>var x;</script><p>END {SAY}</p></article>").endswith(f"END {SAY.strip()}")
    assert ex(f"<article><p>{SAY * 3}</p><svg/><p>END {SAY}</p></article>").count("\n\n") == 1
    assert ex(f"<article><p a=b'c d=\"e>f\">{SAY * 3}</p></article>") == (SAY * 3).strip()


def test_names_do_not_overrule_content():
    ex = html_extract.extract
    assert ex(f'<main><p>{SAY * 6}</p></main><aside class="sidebar"><article><p>CARD {SAY * 3}</p></article></aside>') == (SAY * 6).strip()
    assert ex(f"<main class='legal-page'><div class='legal-text'><p>{SAY * 3}</p></div></main>") == (SAY * 3).strip()
    assert ex(f"<div class='legal'><p>{SAY * 3}</p></div>") == (SAY * 3).strip()
    inside = f'<ul class="tags-explained"><li>{SAY}</li><li>{SAY}</li></ul><div class="story-menu"><p>{SAY}</p></div>'
    assert ex(f"<article><p>{SAY * 4}</p>{inside}<p>{SAY * 4}</p></article>").count("\n\n") == 4
    for zone in ("comments", "cookie-bar-wrap", "ad-slot", "site-footer", "sidebar-left"):
        assert ex(f'<div class="{zone}"><p>{SAY * 2}</p></div><article><p>{SAY * 6}</p></article><div class="{zone}"><p>{SAY * 2}</p></div>') == (SAY * 6).strip()
    links = "<li><a href=x>Home page</a></li>" * 8
    assert ex(f'<div class="main-nav-x"><ul>{links}</ul></div><div><p>{SAY * 6}</p></div><ul class="share-it">{links}</ul>') == (SAY * 6).strip()
    assert ex(f'<nav><a href=x>a</a></nav><div class="comments"><p>{SAY * 3}</p></div>') == ""


def test_any_nesting_takes_linear_time():
    import time

    began = time.process_time()
    for page in ("<div>" * 40_000 + "</span>" * 40_000, '<div class="a">' * 40_000 + "words " + "</div>" * 40_000, '<p a="' * 20_000, "<!--" * 50_000, "<" * 100_000, "<p" + " a" * 100_000, "<p a='x\"" * 20_000):
        html_extract.extract(page + f"<p>{SAY}</p>")
    assert time.process_time() - began < 10


def test_extraction_against_brute_force():
    """Random pages: of all ranges of tokens the best one, widened to whole blocks, without blocks that sum below zero."""
    rng = random.Random(17)
    bits = ["<p>", "</p>", "<div>", "</div>", "<div class='ad'>", "<ul class='x-menu'>", "</ul>", "<li>", "<a href='/'>", "</a>", "<b>", "</b>", "<br>", "<nav>", "</nav>", "<article>", "</article>", "<aside>", "</aside>", "<footer>", "some words here ", "one ", f"{SAY}", " &amp; ", "\n", "<!-- c -->", "<h2>", "</h2>"]
    w = html_extract.weights()
    for _ in range(300):
        page = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        want = ""
        for words in (True, False):
            found = list(html_extract.tokens(page, words))
            own, scores, spent = [], [], 0.0
            for kind, features, text in found:
                s = w.get(f"tag {features[0]}", -0.6) if kind == 0 else 0.0 if features is None else html_extract._score(features, w) * len(text.split())
                own.append(s if kind else 0.0)
                if features and features[1 - kind] and s < 0:
                    s = max(s, html_extract.ZONE_FLOOR - spent)
                    spent += s
                elif kind == 1 and features and not features[0]:
                    spent = 0.0
                scores.append(s)
            sums = [(round(sum(scores[i:j]), 9), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
            if not sums or max(sums)[0] <= 0:
                continue
            _, i, j = max(sums)
            i, j = -i, -j
            edges = [-1, *[k for k, (_, _, text) in enumerate(found) if text is None], len(found)]
            blocks = []
            for a, b in zip(edges, edges[1:], strict=False):
                inside = range(a + 1, b)
                if any(i <= k < j for k in inside) and sum(own[k] for k in inside) >= 0:
                    blocks.append(" ".join("".join(found[k][2] for k in inside).replace("&amp;", "&").split()))
            want = "\n\n".join(x for x in blocks if x)
            if want:
                break
        assert html_extract.extract(page) == want, page
