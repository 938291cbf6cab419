"""Exact and near copies against brute force, with nulls, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from tabwright.llm import exact_dedup, ngram_join

SCHEMA = "doc_id long, text string, kept int, n_shingles string, _copies string, size string"
ROWS = [
    (1, "a b c d e f g h"),
    (2, "a b c d e f g h"),
    (2, "a b c d e f g h"),
    (None, "a b c d e f g h"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "A B c d E f G h"),
    (7, "one two"),
    (8, "One  two"),
    (9, "x" * 5000 + " y z"),
    (None, "only null ids here do stand"),
    (10, "a b c d e f g h "),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "n", "c", "s") for i, t in ROWS], SCHEMA)


def sets_of(text, words):
    parts = (text or "").encode().lower().split()
    n = min(words, len(parts))
    return frozenset(zip(*[parts[k:] for k in range(n)])) if parts else frozenset()


def brute_groups(rows, words, percent):
    """(n, smallest id) of each row."""
    sets = [sets_of(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        out.append((len(sets[i]), own if not sets[i] else min(ids, default=None)))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def test_exact_duplicates(docs):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).drop("_row", "_text_hash").collect()]
    expected = []
    for text in {t or "" for _, t in ROWS}:
        ids = [i for i, t in ROWS if (t or "") == text]
        best = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for k, i in enumerate(ids):
            expected.append((i, best, len(ids), i == best and ids.index(best) == k, digest))
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_drop_duplicates_keeps_columns(docs):
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in ROWS})


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_groups_on_odd_rows(docs, words, percent):
    got = [tuple(r) for r in ngram_join.similar_groups(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()]
    expected = [(i, n, c) for (i, _), (n, c) in zip(ROWS, brute_groups(ROWS, words, percent))]
    assert sorted(got, key=key) == sorted(expected, key=key)


def near_copies(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(12):
        text = [draw.choice(vocabulary) for _ in range(draw.choice([3, 20, 60, 150]))]
        if base % 3 == 0:
            text += passage
        for _ in range(draw.choice([1, 2, 25])):
            copy = list(text)
            for _ in range(draw.choice([0, 1, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_groups_of_near_copies(spark, words, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rows = near_copies(words)
    out = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == dict(zip(range(len(rows)), brute_groups(rows, words, percent)))


def test_one_of_each_group(spark):
    rows = near_copies(5)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _kept string")
    out = ngram_join.one_of_each_group(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {c for _, c in brute_groups(rows, 5, 80)}


def test_tile_is_the_brute_force_product():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 10**6, 300)
    sets = []
    for _ in range(40):
        keep = draw.random(300) > draw.choice([0.02, 0.1, 0.3])
        sets.append(np.unique(np.concatenate([base[keep], draw.integers(10**6, 10**7, draw.integers(0, 30))])))
    for sides in (np.full(40, 2), np.arange(40) % 2):
        links = {}
        for i in range(40):
            for j in range(40):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i < j and (sides[i] == 2 or sides[i] != sides[j]) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    links.setdefault(i, set()).add(j), links.setdefault(j, set()).add(i)
        smallest = {}
        for i in sorted(links):
            open_ = [i] if i not in smallest else []
            while open_:
                x = open_.pop()
                if x not in smallest:
                    smallest[x] = i
                    open_ += links[x]
        expected = {(x, r) for x, r in smallest.items() if x != r}
        assert set(ngram_join.tile_forest(np.arange(40), sides, sets, 85)) == expected


def test_linked_sets_share_indexed_columns():
    draw = random.Random(3)
    for _ in range(3000):
        n, percent = draw.randint(1, 400), draw.choice([80, 85])
        a = set(range(n))
        b = {x for x in a if draw.random() > 0.08} | {n + k for k in range(draw.randint(0, n // 10))}
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        order = list(a | b)
        draw.shuffle(order)
        place = {x: i for i, x in enumerate(order)}
        first = [set(sorted(s, key=place.get)[: ngram_join.index_length(len(s), percent)]) for s in (a, b)]
        shared = len(first[0] & first[1])
        assert shared >= max(ngram_join.asked(len(a), percent), 1) or shared >= max(ngram_join.asked(len(b), percent), 1)
        assert shared >= min(max(1, len(a) // ngram_join.SLACK), max(1, len(b) // ngram_join.SLACK))
        assert min(len(a), len(b)) // ngram_join.SLACK >= 0 and shared >= ngram_join.asked(max(len(a), len(b)), percent) or len(a) != len(b)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert ngram_join.similar_groups(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0
