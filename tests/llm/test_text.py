"""BPE, personal data, languages and web pages."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm import bpe, html_text, language_id, pii

ODD_TEXTS = ["", None, " ", "  a", "a  ", "a \n b", "\n\n", "don't WE'LL", "naïve café 中文 1234", "<|endoftext|>x <|endoftext|>", "é" * 3000,
             "aaaaaaaaaaaaaaaa", "tab\there", "x" * 20000, "\u0085   \x1c", "é ½²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_librarys(spark, library):
    rows = [(i, t, "own") for i, t in enumerate(ODD_TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_decode(df, outputs="ids")
    for r in out.collect():
        expected = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == expected and r.n_tokens == len(expected) and r.decoded_equal
    digests = bpe.encode_decode(df)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    assert sorted((r.doc_id, r.decoded_sha256) for r in digests.collect()) == sorted(map(tuple, expected.collect()))
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_bpe_on_random_text(library):
    draw = np.random.default_rng(5)
    alphabet = np.array(list(" \n\t  ab'sre1é²中\r .,-aa"))
    texts = ["".join(draw.choice(alphabet, draw.integers(0, 40))) for _ in range(4000)]
    own = bpe.Bpe(bpe.default_path())
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), list(BASE).index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_base_spans_are_the_patterns():
    draw = np.random.default_rng(2)
    for alphabet in ("a@.1 2-+.@", "0123456789 -", "+1() .-23", "12.3.255.0"):
        letters = np.array(list(alphabet))
        for _ in range(4000):
            text = "".join(draw.choice(letters, draw.integers(0, 40)))
            assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("x 4111 1111 1111 1111 y") == [(2, 21, "card")]
    assert pii.base_spans("٣@x.y") == [] and pii.base_spans("1" * 200_000) == []


def test_disclosing_terms(spark):
    filler = ["the sun was out and we went home", "nothing of note took place this week", "our agent wrote from the office on day five till the end"]
    rows = [(i, filler[i % 3] + f" v{i} v{i + 1}") for i in range(200)]
    rows += [(1000 + i, f"our agent Zebrafinch wrote v{i} from spy@corp.example.com on day {i} the end") for i in range(6)]
    rows += [(2000, None), (2001, ""), (2002, "spy@corp.example.com"), (1000, "same id again")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    out = pii.find_personal_data(df).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: r for r in out if r.doc_id != 1000}
    text = rows[201][1]
    at = text.index("Zebrafinch")
    email = text.index("spy@")
    spans = found[1001].spans.split(",")
    assert f"term:{at}:{at + 10}" in spans and f"email:{email}:{email + 20}" in spans
    starts = [int(s.split(":")[1]) for s in spans]
    assert starts == sorted(starts) and found[1001].n_email == 1
    assert not any(s == f"term:{text.index('the end')}:{text.index('the end') + 3}" for s in spans)
    assert found[5].spans == "" and found[2000].spans == "" and found[2002].spans == "email:0:20"
    clean = pii.sanitise(text, found[1001].spans, found[1001].removed)
    assert "Zebrafinch" not in clean and "spy@" not in clean and "[EMAIL]" in clean and clean.endswith("the end")
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_language_model(spark):
    english = "the house of the king was on the hill and they went there with all their friends "
    german = "das haus des königs stand auf dem hügel und sie gingen mit ihren freunden dorthin "
    greek = "το σπίτι του βασιλιά ήταν στον λόφο και πήγαν εκεί με όλους τους φίλους τους "
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (greek, "el")] * 20)]
    rows += [(100, None, "en"), (101, "12 34 !!", None), (102, english + german, None), (103, "", "de"), (105, "\u0301\u0308 1", None), (104, "привет мир", None), (None, greek, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.fit(df.filter("doc_id < 60"))
    assert model.languages == ["de", "el", "en"]
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    for i, _, lang in rows[:60]:
        assert got[i].lang_pred == lang and got[i].score > 0.9
    assert [got[i].lang_pred for i in (100, 101, 103, 105)] == ["und"] * 4
    assert got[104].lang_pred == "de" and got[104].score == 0 and got[None].lang_pred == "el"
    spans = [s.split(":")[0] for s in got[102].lang_spans.split(",")]
    assert spans == ["en", "de"] and 0.3 < got[102].score < 0.8
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(60), 102, None}
    assert language_id.predict(df.limit(0), model).count() == 0
    nobody = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, nobody).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(4)
    scores = draw.normal(0, 2, (30, 3)).astype(np.float32)
    lengths = np.array([5, 0, 1, 7, 3])
    flat = draw.integers(0, 30, lengths.sum())
    labels = language_id.viterbi(flat, lengths, scores, 2.5)

    def worth(words, path):
        return sum(float(scores[w, p]) for w, p in zip(words, path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))

    start = 0
    for n in lengths:
        words = flat[start : start + n]
        best = max((worth(words, p) for p in np.ndindex(*[3] * n)), default=0)
        assert abs(worth(words, labels[start : start + n].tolist()) - best) < 1e-4
        start += n


def test_held_out_accuracy(spark, folder):
    docs = language_id.held_out(spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet"))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    out = language_id.predict(docs.filter("held_out AND lang IS NOT NULL"), model)
    share = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
    row = docs.filter("doc_id = 7").first()
    assert row.held_out == (zlib.crc32(b"7") % 4 == 2)


PAGE = """<!doctype html><html><head><title>T{i}</title><style>p>a{{}}</style><script>var x = "<p>no</p>";</script></head>
<body class="blog"><div id="cookie-notice">We use cookies {i}</div><header><h1>Site</h1></header><nav><ul><li>Home<li>News {i}</ul></nav>
<div class="wrap"><aside class="left">Side {i}</aside><{open}><header><h2>Head &amp; line {i}</h2></header>
<p>First   <b>bold</b>&nbsp;text<br>next {i}<p>Second &lt;para&gt; &#233;<div class="ad">Buy {i}</div><form>Mail <input></form>
<table><tr><td>cell {i}<td>other</table><section id="comments"><p>Reader {i}</p></section></{close}></div>
<footer>&copy; {i}</footer><!-- <p>hidden</p> --></body></html>"""
EXPECTED = "Head & line {i}\nFirst bold text next {i}\nSecond <para> é\ncell {i}\nother"


@pytest.mark.parametrize("tags", [("article", "article"), ('div class="post-content"', "div"), ('div role="main"', "div"), ("main", "main")])
def test_main_text_of_one_page(tags):
    page = PAGE.format(i=1, open=tags[0], close=tags[1])
    assert html_text.main_text(page) == EXPECTED.format(i=1)


def test_extract(spark):
    rows = [(i, f"https://User@Host.example:80/{i}", PAGE.format(i=i, open="article", close="article")) for i in range(6)]
    plain = "<html><body><div class=box>Same banner text</div><div class=inner><p>Own words number {i} of a plain page that go on for a while</div><div class=foot>All rights</div></body></html>"
    rows += [(10 + i, f"//plain.example/{i}", plain.format(i=i)) for i in range(5)]
    rows += [(20, None, None), (21, "", ""), (22, "x", "no markup &amp; all"), (23, "x", "<p>cut <b"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    texts = {i: t for i, _, t, _ in got}
    for i in range(6):
        assert texts[i] == EXPECTED.format(i=i)
    for i in range(5):
        assert texts[10 + i] == f"Own words number {i} of a plain page that go on for a while"
    assert texts[20] == texts[21] == "" and texts[22] == "no markup & all" and texts[23] == "cut"
    assert html_text.extract(df.limit(0)).count() == 0


def test_equal_vectors_make_a_class(spark):
    pages = [(i, f"//h/{i}", f"<body><nav>N{i}</nav><article><p>a{i}</p>{'<p>more</p>' * (i % 2)}</article></body>") for i in range(8)]
    df = spark.createDataFrame(pages, "_row long, _host string, _html string").withColumn("_host", F.lit("h"))
    sums = html_text.token_sums(df.repartition(3)).collect()
    vectors = {r.token: (r.pages, r.total, r.vector) for r in sums}
    assert vectors["body>nav+"] == vectors["body>article+*"] == vectors["body-"]
    assert vectors["body>article>p"] != vectors["body>nav+"]
    found = html_text.templates(html_text.token_sums(df)).collect()
    assert [(r.host, r.container) for r in found] == [("h", "body>article")]


def test_template_texts_inside_the_article(spark):
    page = "<body><article><p>Story {i} begins</p><p>Shared <b>word</b> for word on every page</p><p>{long} {i}</p></article><p>Legal line after the article</p></body>"
    rows = [(i, f"//h.example/{i}", page.format(i=i, long="and goes on" * 40)) for i in range(12)]
    # a second kind of page, whose container no word marks
    other = "<body><ul><li>Menu words of this kind of page</ul><div class=box><p>{i} of the other kind is text that differs from page to page</div></body>"
    rows += [(100 + i, f"//h.example/o{i}", other.format(i=i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for i in range(12):
        assert got[i].text == f"Story {i} begins\n{'and goes on' * 40} {i}"
    for i in range(4):
        assert got[100 + i].text == f"{i} of the other kind is text that differs from page to page"
        assert got[100 + i].container == "body>div.box"
    # the template knows texts after the article, and long ones
    counts, _, _ = html_text.page_tokens(rows[0][2])
    assert html_text.text_token(("body",), "Legal line after the article") in counts
    assert html_text.text_token(("body", "article"), f"{'and goes on' * 40} 0") in counts


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><article><p>{t}</article></body>',
        '<body><div id="page" class="no-sidebar"><article><p>{t}</article></div></body>',
        '<body><article class="post ad-free"><p>{t}</article></body>',
        '<body><main><p>x</p><article class="post ad-free"><p>{t}</article></main></body>',
        '<html class="js login"><body><div class="search-page"><p>{t}</div></body></html>',
    ],
)
def test_a_word_does_not_close_the_article(spark, page):
    text = "words of the article that are the most of this page by far"
    assert html_text.main_text(page.format(t=text)).endswith(text)
    rows = [(i, f"//h.example/{i}", page.format(t=f"{text} {i}")) for i in range(5)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith(f"{text} {i}") for i in range(5))


def test_a_word_still_closes_boilerplate():
    page = '<body class="has-sidebar"><article class="post"><p>Own text<div class="related"><article class="card"><p>Other text that is longer</article></div></article><div class="comments"><p>{}</div></body>'
    assert html_text.main_text(page.format("reader " * 50)) == "Own text"


def test_disclosing_terms_are_marked_everywhere(spark):
    filler = "the sun was out and we went home and nothing of note took place in this week "
    # one signature block, word for word the same, under different texts; far from the address, and without it
    block = "kind regards Zebrafinch Holdings office spy@corp.example.com and so on as always in this house "
    rows = [(i, f"v{i} {filler}v{i + 1} kind regards office and so on as always in this house holdings") for i in range(300)]
    rows += [(1000 + i, f"{filler} w{i} {block}" + f"{filler}" * 8 + "Zebrafinch again") for i in range(5)]
    rows += [(2000, f"{filler} Zebrafinch came"), (2001, "zebrafinch")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[300:]:
        places = [m.span() for m in re.finditer("zebrafinch", text, re.I)]
        assert places and all(f"term:{a}:{b}" in out[i].spans.split(",") for a, b in places)
    assert all(out[i].spans == "" for i in range(300))
    assert pii._clear([(2, 5, "ip"), (4, 9, "card")])(9, 12) and not pii._clear([(2, 5, "ip"), (4, 9, "card")])(8, 12)
