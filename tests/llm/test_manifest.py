"""Merkle manifests, near vectors and repaired conversations against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import conversations, merkle, near_vectors


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def plain_way(levels, index):
    way = []
    for nodes in levels[:-1]:
        other = index ^ 1
        way.append(("none", None) if other >= len(nodes) else ("left" if other < index else "right", nodes[other]))
        index >>= 1
    return way


def plain_fold(leaf, way):
    for side, other in way:
        leaf = sha((other or "") + leaf if side == "left" else leaf + (other or ""))
    return leaf


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 7, 8, 9, 31, 33, 64, 100])
def test_positions_address_the_log(leaves):
    nodes = [sha(str(i)) for i in range(leaves)]
    levels = plain_tree(nodes)
    log = merkle.append_log([n.encode() for n in nodes], merkle.height(leaves))
    assert len(log) == sum(map(len, levels)) and merkle.height(leaves) == len(levels) - 1
    for k, row in enumerate(levels):
        for i, node in enumerate(row):
            assert log[merkle.position(k, i, leaves)].decode() == node


def test_audit(spark, monkeypatch):
    rows = [(i, f"text {i}" if i % 9 else None, ["en", "de", None, ""][min(i % 11, 3)], None if i % 5 == 0 else "s", i % 13 or None) for i in range(700)]
    rows += [(None, "no id", "en", "s", 3), (3, "again", "en", "s", 3), (3, "again", "en", "s", 3), (9000, "é" * 5000, "ßé", "", 0)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string")
    claimed = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.lit("other"), 256))
    got = merkle.audit(df.repartition(5), claimed, outputs="proofs").collect()
    trees = {}
    for i, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (i, source, lang, n, text))))
        trees.setdefault(lang, []).append(((i is not None, i or 0), leaf, i))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {lang: plain_tree([leaf for _, leaf, _ in sorted(trees[lang], key=lambda t: t[:2])]) for lang in order}
    above = plain_tree([built[lang][-1][0] for lang in order])
    expected = []
    for place, lang in enumerate(order):
        for index, (_, leaf, i) in enumerate(sorted(trees[lang], key=lambda t: t[:2])):
            way = plain_way(built[lang], index) + plain_way(above, place)
            folded = plain_fold(sha("other") if i is not None and i % 10 == 0 else leaf, way)
            proof = sha("".join(d or "" for _, d in way))
            expected.append((str(i), leaf, built[lang][-1][0], above[-1][0], proof, folded, folded == above[-1][0], str(way)))
    found = [(str(r[0]), *r[1:7], str([(s.side, s.digest) for s in r.proof])) for r in got]
    assert sorted(found) == sorted(expected)
    assert {r.verified for r in got} == {True, False}


def test_audit_of_little(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.audit(spark.createDataFrame([], schema)).collect() == []
    one = merkle.audit(spark.createDataFrame([(None,) * 5], schema)).collect()
    assert [tuple(r) for r in one] == [(None, sha("-----"), sha("-----"), sha("-----"), sha(""), sha("-----"), True)]


def brute_groups(vectors, cosine=0.9):
    def usable(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = len(vectors)
    linked = [[] for _ in range(n)]
    for a, b in itertools.combinations(range(n), 2):
        (_, x), (_, y) = vectors[a], vectors[b]
        if usable(x) and usable(y) and len(x) == len(y):
            x, y = np.array(x, float), np.array(y, float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                linked[a].append(b)
                linked[b].append(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((vectors[b][0] for b in seen if vectors[b][0] is not None), default=None)
        out.append((vectors[a][0], len(linked[a]), least, vectors[a][0] == least))
    return sorted(map(str, out))


def test_near_groups(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((12, 24))
    vectors = [(i, (centres[i % 12] + draw.standard_normal(24) * (0.05 + 0.04 * (i % 9))).tolist()) for i in range(260)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)]  # equal ones
    vectors += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None, 1.0]), (2004, []), (None, vectors[8][1])]
    vectors += [(2005, [1e200, 1e200]), (2006, [1e-200, 1e-200]), (2006, [1e-200, 1.1e-200]), (None, [1.0, -1.0]), (2007, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, code int").repartition(6)
    expected = brute_groups(vectors)
    assert sorted(str(tuple(r)) for r in near_vectors.near_groups(df).collect()) == expected
    # many cells and tables, and cells of several blocks
    assert sorted(str(tuple(r)) for r in near_vectors.near_groups(df, cell=16, block=8).collect()) == expected
    assert near_vectors.near_groups(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    draw = np.random.default_rng(3)
    lines, tables = near_vectors.layout(200_000, 0.9, 4096)
    x = draw.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = draw.standard_normal((4000, 64))
    y -= (x * y).sum(1)[:, None] * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * y / np.linalg.norm(y, axis=1)[:, None]
    met = (near_vectors.cell_codes(x, lines, tables) == near_vectors.cell_codes(y, lines, tables)).any(1)
    assert met.mean() > 0.99
    found = sum(len(list(near_vectors.near_pairs(np.stack([a, b]), np.array([2, 2]), 0.9))) for a, b in zip(x, y))
    assert found > 0.998 * len(x)


def plain_paths(turns):
    """All edits of (initial, fault) turns with their costs, by exhaustion, as (cost, letters) pairs."""
    pattern = re.compile(r"(s?(ua)+)?")
    best = None

    def go(k, letters, roles, cost):
        nonlocal best
        if cost > (3 * len(turns) if best is None else best[0]):  # deleting all turns is always possible
            return
        if k == len(turns):
            if pattern.fullmatch(roles) and (best is None or (cost, letters) < best):
                best = (cost, letters)
        if letters[-3:] != "III":
            for role in "ua":
                go(k, letters + "I", roles + role, cost + 2)
        if k < len(turns):
            initial, fault = turns[k]
            go(k + 1, letters + "D", roles, cost + 3)
            if fault not in (conversations.BLANK, conversations.DUPLICATE):
                more = fault == conversations.TRUNCATED
                go(k + 1, letters + "K", roles + (initial or "?"), cost + more)
                for role in "ua":
                    go(k + 1, letters + "R", roles + role, cost + 2 + more)

    go(0, "", "", 0)
    return best


def test_cheapest_edits():
    draw = random.Random(2)
    for _ in range(80):
        turns = [(draw.choice("suax"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randint(0, 3))]
        assert conversations.cheapest(turns) == plain_paths(turns), turns


def plain_repair(rows):
    groups = {}
    for conv, turn, role, text in rows:
        live = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        live += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, live in groups.items():
        live.sort()
        known = [t for some, t, *_ in live if some]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        turns, counts = [], [0] * 4
        for k, (_, _, role, text) in enumerate(live):
            kept = text.strip(" \t\n\v\f\r")
            fault = 1 if not kept else 2 if (role, text) in [x[2:] for x in live[:k]] else 3 if kept[-1] not in ".!?" else 0
            counts[fault] += 1
            turns.append((role[:1], fault))
        cost, audit = conversations.cheapest(turns)
        lines = conversations.edited([x[2:] for x in live], audit)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[:1] for x in lines))
        wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, *counts[1:], wrong, cost, audit, sha("\n".join(lines))))
    return sorted(map(str, out))


def test_repair(spark):
    draw = random.Random(4)
    texts = ["A b.", "A b", " \n", "", None, "Why?\v", "Yes!  ", "é. ", "ok.\u0085."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "system", "tool", None, "", "user"])
            rows.append((conv, None if draw.random() < 0.1 else turn + draw.randint(0, 1), role, draw.choice(texts)))
    rows += [(7, 1, "user", "same.")] * 3 + [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(1500)]
    rows += [(501, 1, "user", "x" * 200_000 + ".")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, fault int").repartition(5)
    expected = plain_repair(rows)
    for long in (4096, 5):  # whole conversations, and nearly all of them by segments
        assert sorted(str(tuple(r)) for r in conversations.repair(df, long=long).collect()) == expected
    assert conversations.repair(df.limit(0)).collect() == []


def test_segments_joined(monkeypatch, spark):
    monkeypatch.setattr(conversations, "SEGMENT", 3)
    draw = random.Random(9)
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), draw.choice(["One.", "Two", "", "Three!", f"{t}."])) for c in range(8) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert sorted(str(tuple(r)) for r in conversations.repair(df, long=4).collect()) == plain_repair(rows)
