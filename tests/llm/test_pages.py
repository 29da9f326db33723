"""Main text of pages: the field's sums and paths, the parser, and labelled pages."""

from __future__ import annotations

import itertools
import os
import random
import re

import pytest

from dossier.llm import extraction
from dossier.llm.htmlblocks import blocks
from dossier.llm.labelledpages import labelled_pages
from dossier.llm.memo import Memo


@pytest.fixture(scope="module")
def model():
    return extraction.trained(300)


def extract(model, page):
    return extraction.main_text(model, page, Memo(model.path), Memo(model.text))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a<b>b</b>c<p>d<br>e &amp; f&nbsp; g<ul><li>x<li>y</ul>z") == ["abc", "d e & f g", "x", "y", "z"]
    assert texts("<script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes</p><![CDATA[x]]>") == ["yes"]
    assert texts("1 < 2 & 3 &lt;b&gt;") == ["1 < 2 & 3 <b>"]
    assert texts(None) == texts("") == texts("<p> \n </p>") == texts("<script>never closed") == texts("<!-- open") == []
    assert texts("<table><tr><td>a<td>b<tr><td>c</table></div></span>") == ["a", "b", "c"]
    found = blocks('<div class="siteHeader main-nav"><a href=x>link</a> text</div>')[0]
    assert found.path[-1] == ("div", ("site", "header", "main", "nav")) and found.linked == 4


def test_viterbi_finds_the_best_path():
    r = random.Random(5)
    for _ in range(50):
        first, last = [r.gauss(0, 1) for _ in range(2)], [r.gauss(0, 1) for _ in range(2)]
        moves = [[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        scores = [r.gauss(0, 2) for _ in range(r.randint(1, 7))]

        def total(path):
            value = first[path[0]] + last[path[-1]] + sum(moves[a][b] for a, b in itertools.pairwise(path))
            return value + sum(s for s, label in zip(scores, path) if label)

        best = max(itertools.product((0, 1), repeat=len(scores)), key=total)
        assert tuple(extraction.Model({}, first, moves, last).decode(scores)) == best
    assert extraction.Model({}, first, moves, last).decode([]) == []


def test_unseen_labelled_pages(model):
    right = total = 0
    paths, looks = Memo(model.path), Memo(model.text)
    for page, labels in labelled_pages(150, seed=9):
        found = blocks(page)
        got = model.decode([paths[b.path] + looks[extraction.text_features(b.text, b.linked)] for b in found])
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_a_page_with_everything(model):
    page = """<html><head><title>T</title><script>x</script></head><body><header><h2>Site name</h2></header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
    <article><h1>A long&nbsp;headline here</h1><p>First paragraph,   with <i>style</i> &amp; more words to read.</p><div class=ad>Buy now!</div>
    <p>Second paragraph of the story goes on and on.</p></article>
    <section id="comments"><div class="comment"><p>I liked this story a lot, thank you for writing it all down.</p></div></section>
    <form><label>Mail</label><input></form><aside><p>Related stories you may like to read.</p></aside><footer>(c) 2024 Us</footer></body></html>"""
    assert extract(model, page) == (
        "A long headline here\n\nFirst paragraph, with style & more words to read.\n\nSecond paragraph of the story goes on and on."
    )
    assert extract(model, "<nav><a href=/>Home</a></nav><footer>x</footer>") == ""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_given_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)
        assert extract(model, r["html"]) == "\n\n".join(texts(article.group(1)))


def test_table(spark, model):
    long = "<article>" + "<p>Words of a long paragraph, again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some words, a sentence.</p></article>"), (3, "u", long), (3, "u", long)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extraction.extract_text(pages, model).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [r[:2] for r in rows]
    assert got[0]["text"] == got[1]["text"] == "" and got[2]["text"] == "Some words, a sentence."
    assert got[3]["n_chars"] == len(got[3]["text"]) == 20_000 * 35 - 2
    assert extraction.extract_text(pages.limit(0), model).collect() == []


def test_embedded_elements_hide_nothing(model):
    assert texts("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds") == ["where x=1 holds"]
    assert texts("<p>a <svg><style>p{}</style><text>b</text></svg> c") == ["a b c"]
    assert texts("<p>a <audio src=x></audio> b<object data=x>c<object data=y>d</object>e</object> f") == ["a b", "c", "d", "e", "f"]
    assert texts("<p>a<template><p>hidden<template>x</template>y</template><p>b") == ["a", "b"]
    for tag in ("video", "object", "audio", "canvas", "svg", "math"):
        assert texts(f"<div><p>a</p><{tag} id=x><p>b</p></div><p>c</p>") == ["a", "b", "c"]
        page = f"<article><h1>A long headline here</h1><{tag} src=x><p>First paragraph, with more words to read.</p></article>"
        assert extract(model, page) == "A long headline here\n\nFirst paragraph, with more words to read."
