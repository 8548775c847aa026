"""Classifiers and extraction: held-out accuracy, exact round trips, and defined results for awkward rows."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import sorted_rows
from wordloom.llm import html_text, toxicity, warc
from wordloom.llm.language_id import identify, train
from wordloom.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.1"


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n)).capitalize() + "."


def test_language(make):
    rng = random.Random(1)
    kinds = {"xx": "abcdeaab", "yy": "vwxyzéév", "zz": "opqrsttñ"}
    rows = [(i, prose(rng, kinds[k], 40), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(150))]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "1234 ### 5678", "zz"), (1003, prose(rng, kinds["yy"], 4000), None), (None, prose(rng, kinds["zz"], 30), "zz")]
    got = {r["doc_id"]: r for r in identify(make(rows)).collect()}
    assert all(got[i]["lang_pred"] == k for i, t, k in rows[:150])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [(got[i]["lang_pred"], got[i]["rejected"]) for i in (1000, 1001, 1002)] == [("und", True)] * 3
    assert got[1003]["lang_pred"] == "yy"
    assert got[None]["lang_pred"] == "zz"
    assert not any(got[i]["rejected"] for i, *_ in rows[:150])
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)


def test_language_edges(make):
    assert identify(make([])).count() == 0
    assert [(r["lang_pred"], r["score"]) for r in identify(make([(1, "text", None)])).collect()] == [("und", 0.0)]


def test_language_model_is_a_distribution():
    """Over all symbols that may follow a context, probabilities sum to one at most, and nearly to one."""
    from wordloom.llm import language_id as L

    text = "the theory of the other thing then"
    model = train({"en": [text]})
    symbols = sorted(set(L.symbols(text).tolist()))
    for context in ("the", "th", "zz", "her"):
        total = 0.0
        for s in symbols:
            own = np.array([*(ord(c) for c in context), s], np.uint64)
            total += float(np.exp(L._log_probs(model, own, np.array([0, len(own)]))[-1, 0]))
        assert 0.9 < total <= 1.0001


def plain_probability(text, languages, order=4):
    """P(symbol | context) of one language's text by the textbook recursion over dictionaries."""
    from wordloom.llm import language_id as L

    own = L.symbols(text).tolist()
    vocabulary = len({s for t in languages for s in L.symbols(t).tolist()}) + 1
    counts = {order: {}}
    for i in range(len(own) - order + 1):
        gram = tuple(own[i : i + order])
        counts[order][gram] = counts[order].get(gram, 0) + 1
    for n in range(order - 1, 0, -1):
        above = {tuple(own[i : i + n + 1]) for i in range(len(own) - n)}
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        counts[n] = {g: sum(a[1:] == g for a in above) or 1 for g in grams}

    def discount(n):
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    def probability(symbol, context):
        n = len(context) + 1
        lower = probability(symbol, context[1:]) if context else 1 / vocabulary
        seen = [c for g, c in counts[n].items() if g[:-1] == context]
        if not seen:
            return lower
        d, total = discount(n), sum(seen)
        return max(counts[n].get((*context, symbol), 0) - d, 0) / total + d * len(seen) / total * lower

    return probability


def test_language_model_is_the_textbook_one():
    from wordloom.llm import language_id as L

    texts = {"aa": "the theory of the other thing then", "bb": "der dieb und die diebin die der"}
    model = train({k: [t] for k, t in texts.items()})
    probe = L.symbols("other die thx und 5 zq")
    logs = L._log_probs(model, probe, np.array([0, len(probe)]))
    for column, name in enumerate(model.languages):
        probability = plain_probability(texts[name], texts.values())
        expected = [np.log(probability(int(s), tuple(probe[max(0, i - 3) : i].tolist()))) for i, s in enumerate(probe.tolist())]
        assert logs[:, column] == pytest.approx(expected, abs=1e-4)


def test_every_language_is_learned(make):
    """1,200 languages: each has its sample, smaller than that of a few."""
    from wordloom.llm import language_id as L

    rows = [(i, f"word{i % 1200} of language {i % 1200} and more", f"l{i % 1200}") for i in range(36_000)]
    texts, hold = L.training_texts(make(rows))
    assert len(set(texts) | set(hold)) == 1200
    assert L.sample_chars(1200) < L.sample_chars(40) < L.sample_chars(4) == L.TRAIN_CHARS
    assert all(sum(map(len, t)) <= L.sample_chars(1200) * 2 for t in texts.values())


def test_short_texts_may_be_rejected(make):
    """No length exempts from rejection: foreign symbols go, short pieces of a language stay."""
    rng = random.Random(8)
    rows = [(i, prose(rng, "abcdefgh", 60), "xx") for i in range(90)]
    probes = {1000: "bad cafe", 1001: "жщцчэю", 1002: "a", 1003: "жщцчэю " * 50}
    got = {r["doc_id"]: r["rejected"] for r in identify(make(rows + [(i, t, None) for i, t in probes.items()])).collect()}
    assert [got[i] for i in probes] == [False, True, False, True]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").select("lang", "lang_pred", "rejected").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99
    assert got.rejected.mean() < 0.01


def test_pooling_against_plain_loops():
    from wordloom.llm import toxicity as X

    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 3, 7, 0, 1, 30]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    steps = rng.normal(size=(bounds[-1], int(X._OFFSETS[-1]))).astype(np.float32)
    best, places = X._pooled(steps, bounds, True)
    for text, (a, b) in enumerate(zip(bounds, bounds[1:])):
        for i, width in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                sums = [sum(steps[at + j, X._OFFSETS[i] + j * X.FILTERS + f] for j in range(width)) for at in range(a, b - width + 1)]
                column = i * X.FILTERS + f
                assert best[text, column] == pytest.approx(max(sums, default=-np.inf), abs=1e-5)
                if sums:
                    assert places[text, column] == a + int(np.argmax(sums))


def test_scores_against_plain_convolution():
    """The folded table gives what embeddings, filters, pooling and the output layer give one after the other."""
    from wordloom.llm import toxicity as X

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1 << X.BITS, X.DIMENSIONS))
    filters = rng.normal(size=(X.DIMENSIONS, int(X._OFFSETS[-1])))
    bias, out = rng.normal(size=len(X.WIDTHS) * X.FILTERS), rng.normal(size=len(X.WIDTHS) * X.FILTERS)
    model = X.Classifier((vectors @ filters).astype(np.float32), bias, out, 0.3, np.zeros((1 << X.LANGUAGE_BITS, 1)), np.zeros(1), np.zeros(1))
    own = rng.integers(0, 1 << X.BITS, size=(12, 3))
    embedded = vectors[own].sum(axis=1)
    hidden = []
    for i, width in enumerate(X.WIDTHS):
        for f in range(X.FILTERS):
            sums = [sum(embedded[at + j] @ filters[:, X._OFFSETS[i] + j * X.FILTERS + f] for j in range(width)) for at in range(12 - width + 1)]
            hidden.append(max(0, max(sums) + bias[i * X.FILTERS + f]))
    assert X.logits(model, own, np.array([0, 12]))[0] == pytest.approx(float(np.array(hidden) @ out + 0.3), abs=1e-3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).toPandas().merge(labels.select("doc_id", "toxic").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    hits = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hits / (held.toxic == 1).sum() > 0.6
    assert hits / (held.predicted == 1).sum() > 0.75
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_toxicity_edges(spark, make):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert score_toxicity(make([]), labels([])).count() == 0
    assert [r["score"] for r in score_toxicity(make([(1, "a")]), labels([(1, 1, None)])).collect()] == [0.0]
    rng = random.Random(3)
    rows = [(i, prose(rng, "abcdefgh", 30) + (" vile scum" if i % 3 == 0 else " kind"), "en") for i in range(240)]
    rows += [(900, None, None), (901, "", "en"), (902, "scum " * 5000, "en"), (None, "nice", "en")]
    got = score_toxicity(make(rows), labels([(i, 1, int(i % 3 == 0)) for i in range(240)])).toPandas()
    known = got[got.doc_id < 240]
    assert (known.predicted == (known.doc_id % 3 == 0)).mean() > 0.95
    assert len(got) == len(rows)
    assert got.score.between(0, 1).all()


PAGE = """<html><head><title>x</title></head><body><header>Site <b>name</b></header><div class="cookie-notice">We use cookies, ok.</div>
<div id=wrap><div class="sidebar">side, bar. text</div><div class="content"><h2>Head &amp; more</h2><p>First para, with  <i>ital</i>ic
 words; and so on. More text here, really.<p>Second &lt;para&gt; &#233;t&eacute;<br>line two.<ul><li>one<li>two</ul></div>
<div class="comments"><p>Nice article, thanks. I like it, so much, yes.</p></div></div><form><label>Email</label></form><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Head & more First para, with italic words; and so on. More text here, really. Second <para> été line two. one two"),
        ("<nav>menu</nav><article><h1>T</h1><p>a<aside>no</aside>b</p><script>x<y</script><section class='comments'>c</section></article>", "T a b"),
        ("<article>unclosed <b>bold <p>x", "unclosed bold x"),
        ("<article><p>a&nbsp;&nbsp;b\n c</p><!-- no --><p> </p></article>", "a b c"),
        ("plain, only.", "plain, only."),
        ("", ""),
        (None, ""),
        ("<p", ""),
        ("<nav>only a menu</nav>", ""),
        ("<article><div class=ad>buy</div><p>1 < 2 &amp; 3</p></article>", "1 < 2 & 3"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark):
    pages = spark.createDataFrame([(1, None, "<article>é</article>", "x"), (None, "u", None, "y"), (1, None, "<article>é</article>", "z")], "page_id long, url string, html string, text string")
    assert sorted_rows(html_text.extract(pages)) == sorted([(1, None, "é", 1), (None, "u", "", 0), (1, None, "é", 1)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0
    long = "<article>" + "<p>word, more.</p>" * 50_000 + "</article>"
    assert html_text.main_text(long).count("word") == 50_000


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    big, other = "é" * 500, "x" * 1000
    rows = [(1, "http://b.org/x y", big), (7, "http://a.org:80/é?q", big), (3, None, big), (4, "http://a.org/", other), (5, "", "short"), (6, "bad://[", "short"), (8, "http://a.org/\r\nX: y", None), (None, "http://b.org/", other), (9, "http://b.org/", "WARC/1.1\r\n\r\n" * 200), (4, "http://a.org/", other)]
    got = warc.archive_pages(pages(spark, rows)).toPandas()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = [(i, len((t or "").encode()), sha(t), "revisit" if (t == big and i != 7) or (t == other and i is None) else "response", 7 if t == big and i != 7 else 4 if t == other and i is None else None) for i, _, t in rows]
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) else v
    found = [tuple(plain(v) for v in r) for r in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].astype(object).itertuples(index=False)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert list(got.url_key) == sorted(got.url_key)
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_warc_many_runs_and_ranges(spark, monkeypatch):
    """Many archives, short runs, short ranges and a payload dealt over parts: the same records in one global order."""
    for name, value in (("ARCHIVE_BYTES", 3000), ("RUN_ROWS", 7), ("RANGE_ROWS", 40), ("SALT_ROWS", 10)):
        monkeypatch.setattr(warc, name, value)
    rows = [(i, f"http://h{i % 11}.org/{i % 5}", "z" * 1000 if i % 3 == 0 else f"text {i}" * (i % 40)) for i in range(300)]
    got = warc.archive_pages(pages(spark, rows)).toPandas()
    assert got.archive.nunique() > 1
    assert sorted(got.page_id) == list(range(300))
    keys = list(zip(got.url_key, got.captured, got.page_id))
    assert keys == sorted(keys)
    assert set(got[got.page_id % 3 == 0].refers_to.dropna()) == {297}


def test_index_merges_without_sorting():
    """Parts of runs in their own order give the merged order; the merge holds no sort."""
    import inspect

    assert "sort" not in inspect.getsource(warc._merge) + inspect.getsource(warc.loser_tree).split('"""')[2]


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_damaged_record_is_found():
    raw = warc.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None)
    assert warc.parse(raw)["payload_bytes"] == 7
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"payload", b"pAyload", 1).replace(b"\r\n\r\npayload", b"\r\n\r\npAyload"))


PARAGRAPH = "Long prose of the article, with a clause; and another one, so that it weighs. " * 5
TEASER = "<article><h3>Other story</h3><p>Short teaser.</p></article>"


def test_ratios_choose_the_content_though_articles_are_elsewhere():
    """Teasers in article elements do not stand for the page, and an article element is not needed."""
    body = "<h1>Title</h1>" + f"<p>{PARAGRAPH}</p>" * 6
    text = " ".join(["Title", *[PARAGRAPH.strip()] * 6])
    assert html_text.main_text(f"<html><body><div id=content>{body}</div><div class=cards>{TEASER * 3}</div></body></html>") == text
    assert html_text.main_text(f"<html><body><article>{body}</article><div class=cards>{TEASER * 3}</div></body></html>") == text
    assert html_text.main_text(f"<html><body><div class=cards>{TEASER * 3}</div><div><div>{body}</div></div></body></html>") == text


def test_short_blocks_beside_chosen_paths_stay():
    """A content div directly in the body keeps its headings, lists and short blocks."""
    inner = "<h1>Title</h1>" + f"<p>{PARAGRAPH}</p>" * 9 + "<h2>Part</h2><ul><li>one<li>two<li>three<li>four</ul><div class=quote>Short.</div>"
    text = " ".join(["Title", *[PARAGRAPH.strip()] * 9, "Part one two three four Short."])
    for opened, closed in (("<div class=content>", "</div>"), ("<div><div class=content>", "</div></div>"), ("", "")):
        assert html_text.main_text(f"<html><body><nav>Menu</nav>{opened}{inner}{closed}<footer>(c)</footer></body></html>") == text
    split = f"<div class=content><h1>Title</h1><div id=part1><p>{PARAGRAPH * 4}</p></div><div id=part2><p>Short end.</p></div></div>"
    assert html_text.main_text(f"<body>{split}</body>") == f"Title {(PARAGRAPH * 4).strip()} Short end."


def test_article_keeps_its_header_and_classed_blocks():
    body = f"<p>{PARAGRAPH}</p>" * 4
    page = f"<body><header>Site</header><article><header><h1>Title</h1></header><p class=notice>Mind this.</p>{body}<div class=share>Share</div><footer>(c)</footer></article></body>"
    assert html_text.main_text(page) == " ".join(["Title Mind this.", *[PARAGRAPH.strip()] * 4])
    beside = f"<body><article><h1>One</h1>{body}</article><section class=body2><h2>Two</h2>{body}</section><nav>Menu</nav></body>"
    assert html_text.main_text(beside).count(PARAGRAPH.strip()) == 8


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<select>", "</i>", "<p><b>", "<li>", "<div><b>x", "<table><td>", "<!--", "<a href='"])
def test_time_grows_with_the_page(piece):
    """Unclosed and misplaced tags take time and memory in proportion to the page."""
    import time
    import tracemalloc

    def cost(n):
        page = "<article>word, more." + piece * n + "end.</article>"
        tracemalloc.start()
        began = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - began, tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    small, large = cost(4000), cost(32_000)
    assert large[1] < 16 * small[1] + (8 << 20)
    assert large[0] < 32 * small[0] + 1


def plain_paths(page):
    """The chosen texts by the formula itself: means over each path of smoothed ratios, those that reach the deviation."""
    found = [n for n in html_text.nodes(page)[0] if not n.out and n.text.strip()]
    of = {}
    for n in found:
        of.setdefault(n.path, []).append(n)
    ratio = lambda size: [sum(size(m) for m in of[n.path]) / len(of[n.path]) for n in found]
    smooth = lambda x: [0.25 * x[max(0, i - 1)] + 0.5 * x[i] + 0.25 * x[min(len(x) - 1, i + 1)] for i in range(len(x))]
    texts, marks = smooth(ratio(lambda m: len(m.text.strip()))), smooth(ratio(lambda m: sum(c in ".,;:!?…、。，！？" for c in m.text)))
    fused = [t * (1 + k) * (2 if n.content else 1) for t, k, n in zip(texts, marks, found)]
    mean = sum(fused) / len(fused)
    deviation = (sum((f - mean) ** 2 for f in fused) / len(fused)) ** 0.5
    weight = {p: sum(f for f, n in zip(fused, found) if n.path == p) / len(of[p]) for p in of}
    level = min(max(weight.values()), deviation)
    return [n.text for n in found if weight[n.path] >= level - 1e-9]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_ratios_on_real_pages(spark):
    """On every page the formula chooses the paths, and with the article element renamed to div the text is the same."""
    rows = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(300).collect() if r["html"]]
    for page in rows:
        found = [n for n in html_text.nodes(page)[0] if not n.out and n.text.strip()]
        if found:
            assert [n.text for n in html_text._path_nodes(found)] == plain_paths(page)
        assert html_text.main_text(page) == html_text.main_text(page.replace("<article", "<div").replace("</article", "</div"))


def test_toxicity_learns_all_labelled_rows(spark, monkeypatch):
    """Rows beyond the bounds of the start, in number and length, are learned, and those of the held-out fold are not."""
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 5)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 100)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    words = ["you are awful trash", "a quiet walk by the river"]
    docs = spark.createDataFrame([(i, (words[i % 2] + " ") * (40 if i % 3 else 1), "en" if i % 5 else None) for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    sums, plain = [], toxicity._summed
    monkeypatch.setattr(toxicity, "_summed", lambda parts: sums.append(plain(parts)) or sums[-1])
    rows = toxicity.labelled(docs, labels)
    assert rows.count() == docs.where(~toxicity.held_out(5, 0)).count() and rows.agg({"text": "max"}).first()[0]
    seen = rows.where(rows["turn"] >= toxicity.CALIBRATION)
    assert toxicity.train(docs, labels) is not None
    assert len(sums) == toxicity.PASSES and all(s["n"][0] == s["texts"].sum() == seen.count() for s in sums)
    assert sums[0]["words"].sum() == sum(len(r["text"].split()) for r in seen.collect())
