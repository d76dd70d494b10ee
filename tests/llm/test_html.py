from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import htmlmain, htmltrain
from matchloom.llm.queries import queries


def texts(html):
    return [leaf.text for leaf in htmlmain.leaves(html)]


def test_blocks():
    assert texts("<p>a<b>b</b>c &lt;d&gt; &copy;&nbsp; x<p>y<br>z</p><div>w<p>v</div>u") == ["abc <d> © x", "y z", "w", "v", "u"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("<p>1 < 2 & 3 > 2</p>") == ["1 < 2 & 3 > 2"]
    assert texts("<a href='>'>q</a><!-- a > b --><!DOCTYPE x>r") == ["qr"]


def test_what_is_not_text():
    assert texts('<script>var t="</p>";</script><style>p{}</style><title>t</title><textarea><p>x</textarea><p>a') == ["a"]
    assert texts("<p>a<script>never ended <p>b") == ["a"] and texts("<p>a<!-- never ended <p>b") == ["a"]
    assert texts("") == texts(None) == texts("<") == texts("<div") == texts("<p></p> <p> </p>")[:0] + texts("") or texts("<") == ["<"]


def test_paths_and_links():
    page = htmlmain.leaves("<div class='a b-c' id=d><nav><a href=x>home</a> y</nav><p>t</div><p>u")
    assert [leaf.path for leaf in page] == [("div", "nav"), ("div", "p"), ("p",)]
    assert page[0].names == ("a", "b", "c", "d") and page[0].linked == 4 and page[1].linked == 0


def test_long_pages():
    assert len(texts("<p>" + "x<p>" * 50_000)) == 50_000
    assert len(texts("<div>" * 5000 + "x")) == 1
    assert texts("<p>" + "a" * 1_000_000)[0] == "a" * 1_000_000
    assert htmlmain.main_texts(["<article>" + "<p>Some words of text here.</p>" * 3000 + "</article>"])[0].count("\n") == 2999


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    model = htmlmain.Labeller(rng.standard_normal((2, htmlmain.SIZE + htmlmain.HIDDEN + 1, 4 * htmlmain.HIDDEN)) * 0.2, rng.standard_normal(2 * htmlmain.HIDDEN + 1))
    batch = [(rng.random((n, htmlmain.SIZE)).astype(np.float32), (rng.random(n) > 0.5).astype(np.float32)) for n in (3, 5)]
    _, dw, dv = htmltrain.gradient(model, batch)
    model.w, model.v = model.w.astype(np.float64), model.v.astype(np.float64)
    for place in ((0, 3, 5), (1, htmlmain.SIZE + 2, 30), (0, -1, 50), (1, 7, 80)):
        old = model.w[place]
        loss = []
        for step in (1e-3, -1e-3):
            model.w[place] = old + step
            loss.append(htmltrain.gradient(model, batch)[0])
        model.w[place] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - dw[place]) < 1e-3
    assert dv.shape == model.v.shape


def test_training_learns():
    model = htmltrain.train(pages=600, epochs=5, seed=1)
    assert htmltrain.accuracy(model, 60, 2) > 0.9


def test_pages_not_trained_on():
    assert htmltrain.accuracy(htmlmain.Labeller.trained(), 150, 99) > 0.98


@pytest.mark.parametrize("layout", htmltrain.LAYOUTS)
def test_precision_and_recall_of_each_layout(layout):
    precision, recall = htmltrain.precision_and_recall(htmlmain.Labeller.trained(), layout, 150, 98)
    assert precision > 0.97 and recall > 0.97


def test_sentences_keep_their_formulas_and_the_labeller_decides_on_the_rest():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["so x=2 holds"]
    assert texts('<p>an <svg><g><path d="M0"/><title>t</title></g></svg>icon') == ["an icon"]
    assert texts("<p>a <noscript><img src=x></noscript>b <button>c</button> d</p><noscript>e<p>f</noscript>g") == ["a b c d", "e", "f", "g"]
    prose = "<p>This is a long paragraph, with commas, and a full stop at its end.</p><p>Another paragraph follows it. It has two sentences.</p>"
    lines = prose[3:-4].split("</p><p>")
    menu = "<nav><a href=/>Home</a> <a href=/b>Blog</a></nav>"
    foot = "<footer>&copy; us, all rights reserved</footer>"
    for inner, want in (
        (f"<header><h1>A title of the article</h1></header>{prose}", ["A title of the article", *lines]),
        (f"<h1>A title</h1>{prose}<noscript><p>A paragraph of the article that is in here, as some pages have it.</p></noscript>", ["A title", *lines, "A paragraph of the article that is in here, as some pages have it."]),
        (f"<h1>A title</h1>{prose}<object><p>A paragraph of the article that is in an object, as some pages have it.</p></object>", ["A title", *lines, "A paragraph of the article that is in an object, as some pages have it."]),
        (f"<h1>A title</h1>{prose}<button>Share this</button>", ["A title", *lines]),
    ):
        page = f"<html><body><noscript>Please enable JavaScript to view this page.</noscript><header><h1>My site</h1></header>{menu}<article>{inner}</article>{foot}</body></html>"
        assert htmlmain.main_texts([page]) == ["\n".join(want)]


def test_batches_do_not_matter():
    maker = htmltrain.Maker(7)
    pages = [maker.page().replace(htmltrain.MARK, "") for _ in range(40)]
    assert htmlmain.main_texts(pages) == [htmlmain.main_texts([p])[0] for p in pages]


def article(html):
    """Text of the article element, by cutting at its block tags."""
    body = html[html.index("<article>") + 9 :]
    body = body[: body.index("</article>")] if "</article>" in body else body
    cut = [" ".join(unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)[^>]*>", body)]
    return "\n".join(t for t in cut if t)


def test_pages_table(spark):
    rows = queries()["op9_html_text"](spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_other_layouts():
    prose = "<h2>A heading here</h2><p>This is a long paragraph, with commas, and a full stop at its end.</p><p>Another paragraph follows it. It has two sentences.</p>"
    menu = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li><li><a href="/c">Contact</a></li></ul>'
    talk = '<section id="comments"><h3>Comments</h3><div class="comment"><p>Anna says</p><p>I do not agree with this at all.</p></div></section>'
    page = f'<html><body><header><h1>My site</h1></header><nav>{menu}</nav><div class="cookie-notice"><p>We use cookies, accept.</p></div><div class="content">{prose}</div>{talk}<aside><p>Related things.</p></aside><form><label>Name</label><p>Subscribe now</p></form><footer>&copy; us, all rights reserved</footer></body></html>'
    want = "A heading here\nThis is a long paragraph, with commas, and a full stop at its end.\nAnother paragraph follows it. It has two sentences."
    assert htmlmain.main_texts([page, None, ""]) == [want, "", ""]


def test_empty_table_and_clashes(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<article><p>One two three four.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["url"], r["text"], r["n_chars"]) for r in htmlmain.extract(pages).collect()}
    assert got == {(None, "", 0), ("u", "One two three four.", 19)} and htmlmain.extract(pages.limit(0)).isEmpty()
