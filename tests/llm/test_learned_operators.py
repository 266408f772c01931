"""Toxicity, quality, nearest neighbours and page text: held-out accuracy, recall and odd rows."""

import random
import time

import numpy as np
import pytest

from glyphflow.llm import ann, html_text, quality, toxicity

from .labelled_pages import PAGES

ODD = "doc_id long, text string, score double"


def _labelled(spark, make, n=240):
    draw = random.Random(4)
    rows = [(i, make(draw, i % 3 == 0), i % 3 == 0) for i in range(n)]
    return spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], ODD), rows


def test_toxicity_learns_planted_words(spark):
    def make(draw, bad):
        words = ["".join(draw.choice(("on", "the", "er", "an", "ti")) for _ in range(draw.randint(1, 4))) for _ in range(60)]
        return " ".join(words[:30] + ["wretchling", "gruumsh"] * (2 * bad) + words[30:])

    docs, rows = _labelled(spark, make)
    labels = spark.createDataFrame([(i, int(bad)) for i, _, bad in rows if i < 180], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    assert np.mean([got[i]["predicted"] == bad for i, _, bad in rows if i >= 180]) >= 0.95
    odd = spark.createDataFrame([(1, None, 0.0), (1, "", 0.0), (None, "x" * 100_000, 0.0)], ODD)
    assert {(r["score"], r["predicted"]) for r in toxicity.scores(odd, model).collect()} == {(0.0, 0)}
    assert toxicity.scores(odd.limit(0), model).count() == 0
    assert toxicity.scores(docs, toxicity.train(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0


def test_toxicity_learns_behind_a_header(spark):
    def make(draw, bad):
        words = ["".join(draw.choice(("on", "the", "er", "an", "ti")) for _ in range(draw.randint(1, 4))) for _ in range(60)]
        return " ".join(["all", "documents", "share", "this", "one", "header", *words[:30], *["wretchling", "gruumsh"] * (2 * bad), *words[30:]])

    docs, rows = _labelled(spark, make)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(bad)) for i, _, bad in rows if i < 180], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, model).collect()}
    assert np.mean([got[i] == bad for i, _, bad in rows if i >= 180]) >= 0.95


def test_toxicity_reads_long_runs_whole(spark):
    words = [f"plain{i}" for i in range(40)]
    texts = {True: [*words[:20], "wretchling", "gruumsh", *words[20:]], False: words}
    docs = spark.createDataFrame([(i, f"d{i} " + " ".join(texts[i % 3 == 0]), 0.0) for i in range(240)], ODD)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int"))
    runs = ["_".join(words + ["wretchling", "gruumsh"]), "x" * 5000 + "wretchlinggruumsh" + "x" * 40, "_".join(words), "x" * 5000]
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(runs)], ODD), model).collect()}
    assert [got[i] > 0 for i in range(4)] == [True, True, False, False]
    assert all(len(w) <= 64 for t in runs for w in toxicity.windows(t))


def test_quality_ranks_repetition_last(spark):
    def make(draw, bad):
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(50)]
        return " ".join(words[:4] * 12 if bad else words) + "."

    docs, rows = _labelled(spark, make)
    labels = spark.createDataFrame([(i, int(not bad)) for i, _, bad in rows if i < 180], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.scores(docs, model).collect()}
    assert np.mean([got[i]["predicted"] != bad for i, _, bad in rows if i >= 180]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, 0.0), (1, "", 0.0), (None, "é " * 50_000, 0.0)], ODD)
    assert quality.scores(odd, model).count() == 3
    assert quality.scores(docs, quality.train(docs, labels.limit(0))).where("predicted = 0").count() == 0


def test_kept_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "some words here", 7.0, "x")], "doc_id long, text string, Score double, predicted string")
    for made in (toxicity.scores(docs, toxicity.Model(b"", b""), tuple(docs.columns)), quality.scores(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")), tuple(docs.columns))):
        assert made.columns == ["doc_id", "text", "score", "predicted"]
        assert made.first()["text"] == "some words here" and 0 <= made.first()["score"] <= 1

    import corpus_pipeline

    rows = docs.withColumn("row", docs["doc_id"])
    assert corpus_pipeline._kept(rows, lambda r: toxicity.scores(r, toxicity.Model(b"", b""), ("row",)), 0).collect() == rows.collect()


def test_repeated_documents_count_once_in_training(spark):
    docs = spark.createDataFrame([(1, "b", 0.0)] * 50 + [(1, None, 0.0), (2, "good words stand here.", 0.0)], ODD)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert len(model.weights) == quality.WIDTH
    assert {r["predicted"] for r in quality.scores(docs, model).where("doc_id = 2").collect()} == {1}
    assert toxicity.scores(docs, toxicity.train(docs, labels)).count() == 52


def test_quality_pairs_are_ranked():
    draw = np.random.default_rng(1)
    good = draw.random(400) < 0.6
    values = draw.normal(0, 1, (400, 3)) + good[:, None] * np.array([3.0, 0, 0])
    model = quality.fit(values, good)
    score = (values - np.array(model.centre)) / np.array(model.scale) @ np.array(model.weights)
    assert (((score >= model.threshold) == good).mean()) > 0.9


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("n", [7, 900])
def test_nearest(spark, n):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 1, (12, 16))
    x = (centres[draw.integers(0, 12, n)] + draw.normal(0, 0.3, (n, 16))).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    bad = [(n, None, 1), (n + 20, [0.0] * 16, 1), (n + 40, [float("nan")] * 16, 1), (n + 60, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    table = _vectors(spark, rows + bad)
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), k=10).collect()
    recalls = []
    for q in range(0, n, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, min(10, n - 1) + 1))
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in mine)
        recalls.append(len({v for _, v, _ in mine} & set(order)) / len(order))
    assert {r["query_id"] for r in got} == set(range(0, n, 20))
    assert np.mean(recalls) >= 0.9


def test_routing_searches_few_parts_of_clustered_vectors():
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (60, 24))
    make = lambda n: centres[draw.integers(0, 60, n)] + draw.normal(0, 0.25, (n, 24))
    router = ann.fit(make(4000), 10)
    assert router.parts == 32 and router.probes <= router.parts // 4 and router.recall >= ann.RECALL
    rows, queries = make(8000), make(200)
    near = np.argsort(-(queries @ rows.T), axis=1)[:, :10]
    searched = np.argsort(-router.logits(queries), axis=1)[:, : router.probes]
    found = (router.logits(rows).argmax(1)[near][:, :, None] == searched[:, None, :]).any(2)
    assert found.mean() >= 0.9
    assert ann.fit(draw.normal(size=(8_000, 4)), 5).parts > 32


def test_nearest_ties_and_empty(spark):
    same = _vectors(spark, [(i, [1.0, 2.0], 0) for i in range(45)])
    got = ann.nearest(same, same.where("vec_id % 20 = 0"), k=5).collect()
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 0) == [1, 2, 3, 4, 5]
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 40) == [0, 1, 2, 3, 4]
    assert ann.nearest(same.limit(0), same.limit(0)).count() == 0


def test_balanced_parts():
    x = np.random.default_rng(3).normal(size=(400, 8))
    sizes = np.bincount(ann.balanced_parts(x, ann.neighbour_graph(x, 6), 4), minlength=4)
    assert sizes.max() <= 106


def test_blocks_of_untidy_html():
    assert [b.words for b in html_text.blocks("<head><title>t</title><p>text after an unclosed head")] == ["text after an unclosed head"]
    assert [b.words for b in html_text.blocks("<body><p>one&amp;two<p>three <b>b</b>\n four<br>five<script>a<b</script><li>x")] == ["one&two", "three b four five", "x"]
    assert html_text.blocks(None) == html_text.blocks("") == []


def test_deep_pages_take_time_in_proportion():
    took = []
    for depth in (4_000, 16_000):
        began = time.process_time()
        found = html_text.blocks("<div class='a b'>word " * depth + "</p>" * depth)
        html_text.vectors(found)
        took.append(time.process_time() - began)
        assert len(found) == depth and found[-1].depth == depth
    assert took[0] < 2 and took[1] < 12 * took[0]
    page = html_text.blocks("<div class=x><main><section><article><h1>t</h1><p>u")
    steps = [html_text._step(s) for s in ("div x", "main", "section", "article", "h1")]
    assert page[0].heading and (page[0].path == np.minimum(sum(steps[:2]) / 2 + sum(steps[2:]), 2)).all()


def test_labeller_gradient():
    model, draw = html_text.Labeller.fresh(), np.random.default_rng(1)
    x, keep, y = draw.normal(size=(2, 4, html_text.WIDTH)), np.array([[1.0, 1, 1, 1], [1, 1, 0, 0]]), np.array([[1.0, 0, 1, 0], [0, 1, 0, 0]])

    def loss():
        p = model.probabilities(x, keep)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * keep).sum() / keep.sum()

    grad = model.gradients(x, keep, y)
    for name, at in (("fx", (3, 5)), ("fh", (2, 30)), ("bh", (1, 70)), ("bc", (4,)), ("o", (7,))):
        model.w[name][at] += 1e-5
        high = loss()
        model.w[name][at] -= 2e-5
        low = loss()
        model.w[name][at] += 1e-5
        assert grad[name][at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-7)


def test_main_texts(spark):
    page = "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Big news</h1><p>First  line.</p><p>Second &amp; last.</p></article><footer>&copy; me &middot; All rights.</footer></body></html>"
    long = "<article>" + "<p>Some words stand here.</p>" * 5000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", long, 1)], "page_id long, url string, html string, text int")
    got = html_text.main_texts(pages).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Big news First line. Second & last."] * 2
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert [r["n_chars"] for r in got if r["page_id"] is None] == [5000 * len("Some words stand here. ") - 1]
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_hand_labelled_page():
    page = """<!doctype html><html lang=en><head><title>Harbour news</title><style>p{margin:0}</style></head><body>
    <header class=masthead><p>The Harbour Post</p></header>
    <nav class="topnav"><ul><li><a href=/>Front page</a><li><a href=/sport>Sport</a><li><a href=/weather>Weather</a></ul></nav>
    <div class="cookie-notice notice">We use cookies. <a href=#>More</a></div>
    <main id=content><article><h1>Ferry returns to service</h1>
    <p>The ferry <em>Northern Star</em> sailed again on Tuesday after three months of repairs, the operator said &mdash; a week early.</p>
    <p>Passengers had been taken by bus around the fjord. The trip took two hours longer than the crossing.</p>
    <h2>What was mended</h2><p>Both engines were taken out, cleaned and put back. The hull was painted as well.</p>
    <script>track("x")</script></article></main>
    <aside class=sidebar><h3>Most read</h3><p>Storm closes bridge</p></aside>
    <section class=comments><h3>Comments</h3><div class=comment><p>Finally!</p></div></section>
    <footer>&copy; Harbour Post. All rights reserved.</footer></body></html>"""
    found = html_text.blocks(page)
    kept = html_text.label_pages(html_text.trained(), [found])[0]
    assert [b.words for b, k in zip(found, kept, strict=True) if k] == [
        "Ferry returns to service", "The ferry Northern Star sailed again on Tuesday after three months of repairs, the operator said — a week early.",
        "Passengers had been taken by bus around the fjord. The trip took two hours longer than the crossing.", "What was mended",
        "Both engines were taken out, cleaned and put back. The hull was painted as well.",
    ]


def test_held_out_layouts():
    model, draw, right, total = html_text.trained(), random.Random(77), 0, 0
    for _ in range(80):
        html, main = html_text.training_page(draw)
        found = html_text.blocks(html)
        right += int((html_text.label_pages(model, [found])[0] == np.array(main)).sum())
        total += len(main)
    assert right / total > 0.98


def test_long_pages_are_labelled_as_a_whole(monkeypatch):
    model, draw = html_text.trained(), random.Random(5)
    page = [b for _ in range(60) for b in html_text.blocks(html_text.training_page(draw)[0])]
    whole = model.probabilities(*html_text._padded([html_text.vectors(page)]))[0]
    monkeypatch.setattr(html_text, "STRETCH", 70)
    monkeypatch.setattr(html_text, "OVERLAP", 10, raising=False)
    assert len(page) > 300
    assert (html_text.label_pages(model, [page, page[:20]])[0] == (whole > 0.5)).all()
    assert np.abs(model.long_page(page) - whole).max() < 1e-9
    words = [f"w{i}" for i in range(100)]
    a, b = (html_text.blocks("<p>" + " ".join(words[:80] + tail) + "</p>") for tail in (["red"], ["blue"]))
    assert (html_text.vectors(a) != html_text.vectors(b)).any()


def test_labeller_keeps_articles_of_other_layouts():
    model, right, total, lost = html_text.trained(), 0, 0, {}
    for name, page in PAGES.items():
        want = [b.words.startswith("!") for b in html_text.blocks(page)]
        got = html_text.label_pages(model, [html_text.blocks(page.replace("!", ""))])[0].tolist()
        right, total = right + sum(a == b for a, b in zip(want, got, strict=True)), total + len(want)
        lost[name] = sum(a and not b for a, b in zip(want, got, strict=True))
    assert len(PAGES) >= 10 and right / total >= 0.95
    assert max(lost.values()) <= 2


@pytest.mark.parametrize("unit", ["<a ", "<!-- ", '<div a="', "<div a='b\" ", "<", "</", "<script>", "<p>x", "&amp", '<a b="c" d=\'e"', "</div>", "<a ="])
def test_malformed_markup_is_read_in_linear_time(unit):
    began = time.process_time()
    html_text.blocks(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 6


def test_markup_that_does_not_end():
    words = lambda html: [b.words for b in html_text.blocks(html)]
    assert words("<p>one<p>two <!-- three <p>four") == ["one", "two"] and words("<p>one<div class='x>two<p ") == ["one", "two"]
    assert words("<p>a < b <3 c</p>d<!doctype x>e<?php f?>g</ h>i") == ["a < b <3 c", "degi"]
    assert words("<p title='a>b' class=x/y>c<p title=it's>d<script>var x = '<p>';</SCRIPT >e<style><p></style>f") == ["c", "d", "e", "f"]
    assert words('<P CLASS="q">a<BR/>b<Div/>c') == ["a b", "c"]
