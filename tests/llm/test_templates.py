"""Template deduction against explicit occurrence vectors; pages whose class names mislead."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tabwright.llm import html_text

LONG = " ".join(f"Sentence number {i} of the text." for i in range(20))


def random_host(draw, pages):
    menu = "".join(f"<li>Menu {draw.randint(0, 99)}" for _ in range(draw.randint(0, 4)))
    out = []
    for i in range(pages):
        page = f"<body><div class=top{draw.randint(0, 1)}><ul>{menu}</ul></div><div class=box>" if draw.random() < 0.8 else "<body><table><tr><td>"
        page += "".join(f"<p>Own {i} {draw.randint(0, 5)}</p>" for _ in range(draw.randint(0, 5)))
        page += "<section><p>Shared</p></section>" * draw.randint(0, 2) + "<footer>Legal</footer>"
        out.append(page)
    return out


def test_classes_are_those_of_the_vectors(spark):
    draw = random.Random(12)
    hosts = {f"h{k}": random_host(draw, draw.randint(1, 9)) for k in range(25)}
    rows = [(1000 * k + i, h, p) for k, (h, pages) in enumerate(hosts.items()) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "_row long, _host string, _html string").repartition(6)
    got = {r.host: set(r.template.split("\n")) for r in html_text.templates(html_text.token_sums(df)).collect()}
    expected = {}
    for host, pages in hosts.items():
        counts = [html_text.page_tokens(p)[0] for p in pages]
        classes = {}
        for token in set().union(*counts):
            classes.setdefault(tuple(c[token] for c in counts), set()).add(token)
        valid = [tokens for vector, tokens in classes.items() if len(tokens) > 1 and (on := sum(n > 0 for n in vector)) >= 3 and 2 * on >= len(pages)]
        if valid:
            expected[host] = set().union(*valid)
    assert got == expected and len(got) > 10


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<main><div class="elementor-widget elementor-widget-text-editor"><p>{LONG}</p></div></main>', LONG),
        (f'<main><h1>Title</h1><div class="widget-text"><p>{LONG}</p></div></main>', f"Title\n{LONG}"),
        (f'<article><h1>T</h1><section class="notice"><p>{LONG}</p></section></article>', f"T\n{LONG}"),
        (f'<main>{f"<div class=widget><p>{LONG}</p></div>" * 4}</main>', "\n".join([LONG] * 4)),
        (f'<article><p>Own</p><section class="comments"><p>{LONG}</p></section></article>', "Own"),
        (f'<article><p>{LONG}</p><div class="widget share">Share this</div></article>', LONG),
        (f'<article><p>{LONG}</p><p hidden>gone</p><p>stays</p><div style="display:none">gone</div></article>', f"{LONG}\nstays"),
        ('<div class="box">a</div><div class="box share">b</div><div class="box">c and more of it</div>', "a\nc and more of it"),
    ],
)
def test_words_need_a_small_share(page, text):
    assert html_text.main_text(page) == text


def test_values_differ_behind_their_sixtieth_letter():
    label = lambda value: html_text._label("div", f'class="{value}"')[0]
    assert label("a" * 60 + "b") != label("a" * 60 + "c") and label("a" * 60 + "1") == label("a" * 60 + "2")


def test_time_grows_with_the_page():
    page = "<article>" + "".join(f'<div class="c{i:05d}"><p>text {i}</div>'.replace(str(i), "".join(chr(97 + int(d)) for d in str(i))) for i in range(30_000))
    page += "<div>" * 20_000 + "</span></section>" * 5_000
    start = time.time()
    assert html_text.main_text(page).count("\n") == 29_999
    html_text.page_tokens(page)
    assert time.time() - start < 20


def test_a_host_of_any_size_treats_texts_alike(spark):
    page = "<body><article><p>Story {i} begins and goes on for some time, longer than what all share</p><p>Shared words</p></article></body>"
    for n in (3, 9, 10, 12):
        rows = [(i, f"//h.example/{i}", page.format(i=i)) for i in range(n)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("container", F.lit(1))
        got = {r.page_id: r.text for r in html_text.extract(df).collect()}
        assert got == {i: f"Story {i} begins and goes on for some time, longer than what all share" for i in range(n)}
