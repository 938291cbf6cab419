"""Disclosing terms against a plain version of the scores, level by level."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from tabwright.llm import pii


def plain_names(value, kind):
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        local, domain = value.lower().split("@")
        return {"value:email:" + value.lower(): 0, "local:" + local: 1, "domain:" + domain: 2, "kind:email": 6}
    if kind == "ip":
        a, b, c, _ = value.split(".")
        return {"value:ip:" + value: 0, f"network:{a}.{b}": 3, f"network:{a}.{b}.{c}": 3, "kind:ip": 6}
    if kind == "card":
        return {"value:card:" + digits: 0, "issuer:" + digits[:6]: 4, "kind:card": 6}
    return {"value:phone:" + digits: 0, "area:" + digits[:3]: 5, "area:" + digits[:6]: 5, "kind:phone": 6}


def plain_terms(texts):
    """{term: (level, share)} of the disclosing terms."""
    n_entity, n_term, both, levels = {}, {}, {}, {}
    for text in texts:
        spans = pii.base_spans(text)
        every = {m.group().casefold() for m in pii._TERM.finditer(text)}
        free = {m.group().casefold() for m in pii._TERM.finditer(text) if all(m.end() <= a or m.start() >= b for a, b, _ in spans)}
        own = {}
        for a, b, kind in spans:
            own.update(plain_names(text[a:b], kind))
        levels.update(own)
        for t in every:
            n_term[t] = n_term.get(t, 0) + 1
        for e in own:
            n_entity[e] = n_entity.get(e, 0) + 1
            for t in free:
                both.setdefault((e, t), []).append(text)
    near = {}
    for (_, t), _texts in both.items():
        near[t] = 0
    for text in texts:
        spans = pii.base_spans(text)
        if spans:
            for t in {m.group().casefold() for m in pii._TERM.finditer(text) if all(m.end() <= a or m.start() >= b for a, b, _ in spans)}:
                near[t] += 1
    pairs = {(e, t): x for (e, t), x in both.items() if n_entity[e] >= 3 and near[t] >= 3}
    tested = sum(n >= 3 for n in n_entity.values()) * sum(n >= 3 for n in near.values())
    out = {}
    for (e, t), found in pairs.items():
        pmi = math.log(len(found) * len(texts) / (n_entity[e] * n_term[t]))
        content = math.log(len(texts) / n_entity[e])
        share = pmi / content if content > 0 else 0
        alone = len(set(found))
        if share >= 0.8 and alone >= 3 and alone * pmi >= math.log(tested) + 3:
            out[t] = max(out.get(t, (-9, 0)), (-levels[e], share))
    return {t: (-level, share) for t, (level, share) in out.items()}


def corpus():
    draw = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(draw.choices(words, k=draw.randint(5, 60))) for _ in range(400)]
    texts += [f"{' '.join(draw.choices(words, k=9))} Heronbridge p{i}@heron.example.org" for i in range(9)]  # one domain, other people
    texts += [f"{' '.join(draw.choices(words, k=9))} lighthouse 10.20.{i}.{i} {i}" for i in range(8)]  # one network
    texts += [f"{' '.join(draw.choices(words, k=9))} plastic 4111 1111 1111 1111" for _ in range(7)]  # one value
    texts += [f"{' '.join(draw.choices(words, k=9))} ringing +{49 + i} 1{i} 55{i} 123{i}" for i in range(10)]  # a kind only
    texts += ["copied Sameword a@b.example.net and so on"] * 12  # copies are one text
    texts += ["", "Heronbridge alone", "x@y.example.org"]
    return texts


def test_levels_and_scores(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    scanned = pii.scan(df, "doc_id", "text")
    got = {r.term: (r.level, round(r.share, 9)) for r in pii.revealing_terms(scanned, len(texts)).collect()}
    expected = {t: (level, round(share, 9)) for t, (level, share) in plain_terms(texts).items()}
    assert got == expected
    level = pii.LEVELS.index
    assert (got["heronbridge"][0], got["lighthouse"][0], got["plastic"][0]) == (level("domain"), level("network"), level("value"))
    assert got["ringing"][0] == level("kind") and "sameword" not in got
    marked = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for i, text in enumerate(texts):
        base = pii.base_spans(text)
        places = [(m.start(), m.end(), "term") for m in pii._TERM.finditer(text) if m.group().casefold() in expected]
        places = [(a, b, k) for a, b, k in places if all(b <= x or a >= y for x, y, _ in base)]
        order = sorted(base + places, key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert marked[i] == ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def test_many_spans_in_one_text(spark):
    text = " ".join(f"name{i} n{i}@d{i % 7}.example.com" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    start = time.time()
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert rows[1].n_email == 20_000 and rows[2].spans == "" and time.time() - start < 60


def test_sanitised_rows_of_one_id(spark):
    rows = [(1, "to a@b.example.com now", "x"), (1, "nothing", "y"), (None, None, "z"), (1, "to a@b.example.com now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.sanitised_texts(df)
    assert out.columns == ["doc_id", "text", "spans", "sanitised"]
    assert sorted(map(str, out.select("spans", "sanitised").collect())) == sorted(
        f"Row(spans={s!r}, sanitised={t!r})" for s, t in [("x", "to [EMAIL] now"), ("y", "nothing"), ("z", ""), ("x", "to [EMAIL] now")]
    )
    assert pii.sanitised_texts(df.filter(F.lit(False))).collect() == []
