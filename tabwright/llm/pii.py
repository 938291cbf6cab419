"""Information-theoretic sanitisation of personal data.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each is a protected value, and belongs to
groups that are protected too: an address's local part and domain, a network, a card's issuer, a phone number's area, and its
kind. With n(e) and n(t) the texts that have an entity (a value or a group) and a term, and n(e,t) those that have both,
PMI(e, t) = log(n(e,t) N / (n(e) n(t))) and IC(e) = log(N / n(e)); the share PMI / IC is 1 if the term never occurs without the
entity. A term discloses at the most specific level at which its share is GENERALISE or more, in SUPPORT or more different
texts, and in so many that chance does not explain it: n(e,t) PMI has to exceed the log of the number of pairs looked at by
EVIDENCE. Values that occur once say nothing about terms, but their groups do. Disclosing terms become spans in every text:
they are replaced by their general form, or removed from a share of REMOVE upwards.

Every term of a text that has an entity is a candidate. The first pass finds entities and counts terms; if any term discloses,
a second pass marks where such terms stand.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.bpe import blocks
from tabwright.llm.common import free_name, hot_join, row_id, store

#: Order of the kinds where spans start at the same place; `term` is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
#: Levels of entities, the most specific first.
LEVELS = ("value", "local", "domain", "network", "issuer", "area", "kind")
GENERALISE, REMOVE, SUPPORT, EVIDENCE = 0.8, 0.95, 3, 3.0
#: Bits of the filter that keeps most other terms out of the join with the terms looked for.
FILTER_BITS = 1 << 23
#: Terms a task counts before it hands its counts on.
COUNTED_TERMS = 400_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A failed start inside a run of digits fails from every later digit of the run, so only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from their @, so that a long word without one costs nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points, by start and kind."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                    found.append((*m.span(), "phone"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def entity(text: str, kind: str) -> str:
    """The protected value, whatever its spelling."""
    value = text.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", text)
    return f"{kind}:{value}"


def entities(text: str, kind: str) -> list[tuple[str, int]]:
    """(name, level) of a value and of the groups it belongs to."""
    value = entity(text, kind)
    bare = value[len(kind) + 1 :]
    named = [("value", value), ("kind", kind)]
    if kind == "email":
        local, domain = bare.split("@")
        named += [("local", local), ("domain", domain)]
    elif kind == "ip":
        parts = bare.split(".")
        named += [("network", ".".join(parts[:2])), ("network", ".".join(parts[:3]))]
    elif kind == "card":
        named.append(("issuer", bare[:6]))
    else:
        named += [("area", bare[:3]), ("area", bare[:6])]
    return [(f"{level}:{name}", LEVELS.index(level)) for level, name in named]


def _hash(value: str) -> int:
    digest = hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _clear(spans: list[tuple[int, int, str]]):
    """Whether a place is outside all spans, as a function of its start and end."""
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def clear(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at == 0 or merged[at - 1][1] <= start

    return clear


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def scan(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """One pass over the texts: a row per text with its spans, and its entities and terms if it has any, and rows of
    (term, documents)."""
    source = _texts(docs, id_column, text)
    fields = T._parse_datatype_string(
        "spans array<string>, content bigint, entities array<struct<name:bigint,level:int>>, terms array<string>, term string, documents bigint"
    ).fields
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), *fields])
    named = pa.struct([("name", pa.int64()), ("level", pa.int32())])
    types = [pa.list_(pa.string()), pa.int64(), pa.list_(named), pa.list_(pa.string()), pa.string(), pa.int64()]

    def counted(counts: Counter, ids: pa.DataType):
        n = len(counts)
        columns = [pa.nulls(n, t) for t in (ids, *types[:4])]
        columns += [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        counts: Counter = Counter()
        terms: dict[str, tuple[str, ...]] = {}
        ids = pa.int64()
        for whole in batches:
            for batch in blocks(whole, "_text"):
                ids = batch.column("_id").type
                rows = []
                for value in batch.column("_text").to_pylist():
                    found = base_spans(value)
                    words = set(value.split())
                    for w in words.difference(terms):
                        terms[w] = tuple(m.group().casefold() for m in _TERM.finditer(w))
                    counts.update({t for w in words for t in terms[w]})
                    names: dict[int, int] = {}
                    near: set[str] = set()
                    if found:
                        for a, b, k in found:
                            names.update((_hash(name), level) for name, level in entities(value[a:b], k))
                        clear = _clear(found)
                        near = {m.group().casefold() for m in _TERM.finditer(value) if clear(*m.span())}
                    own = [{"name": n, "level": level} for n, level in names.items()]
                    rows.append(([f"{k}:{a}:{b}" for a, b, k in found], _hash(value), own, list(near), None, None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=schema.names)
                if len(counts) > COUNTED_TERMS or len(terms) > 2 * COUNTED_TERMS:
                    yield counted(counts, ids)
                    counts.clear()
                    terms.clear()
        if counts:
            yield counted(counts, ids)

    return source.mapInArrow(run, schema)


def revealing_terms(scanned: DataFrame, rows: int) -> DataFrame:
    """(term, share, level): the terms that give an entity away, at their most specific level, with the largest share there."""
    some = scanned.filter("size(entities) > 0").select(row_id().alias("_row"), "content", "entities", "terms")
    some = store(some, "pii-some")
    # entities and terms of fewer texts than are needed cannot be part of a pair
    owned = some.select("_row", "content", F.inline("entities"))
    n_entity = owned.groupBy("name").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= SUPPORT)
    owned = hot_join(owned, n_entity, ["name"], "n_entity", owned.count()).filter("n_entity IS NOT NULL")
    told = some.select("_row", F.explode("terms").alias("term"))
    n_near = told.groupBy("term").agg(F.count("*").alias("n_near")).filter(F.col("n_near") >= SUPPORT)
    n_term = scanned.filter("term IS NOT NULL").groupBy("term").agg(F.sum("documents").alias("n_term"))
    near = store(n_near.join(n_term, "term"), "pii-near")
    looked_at = max(1, n_entity.count() * near.count())
    # A pair's texts are at most the entity's, and at most the term's beside any entity. Shares that cannot be reached so are
    # not counted; the rarest entity asks for the least.
    possible = F.col("n_near") >= F.col("n_term") * (SUPPORT / max(rows, SUPPORT)) ** (1 - GENERALISE) * (1 - 1e-9)
    told = hot_join(told, near.filter(possible), ["term"], "n_near", told.count()).filter("n_term IS NOT NULL")
    both = owned.join(store(told, "pii-told"), "_row")
    most = F.least("n_entity", "n_near") * F.lit(float(rows)) / (F.col("n_entity") * F.col("n_term"))
    both = both.filter(F.log(most) >= (GENERALISE - 1e-9) * F.log(F.lit(float(rows)) / F.col("n_entity"))).drop("n_near")
    texts = both.groupBy("name", "level", "n_entity", "term", "n_term", "content").agg(F.count("*").alias("n"))
    pairs = texts.groupBy("name", "level", "n_entity", "term", "n_term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("texts"))
    n = F.lit(float(rows))
    pmi = F.log(F.col("n_pair") * n / (F.col("n_entity") * F.col("n_term")))
    content = F.log(n / F.col("n_entity"))
    pairs = pairs.withColumn("share", F.when(content > 0, pmi / content).otherwise(F.lit(0.0)))
    told_enough = (F.col("texts") >= SUPPORT) & (F.col("texts") * pmi >= math.log(looked_at) + EVIDENCE)
    out = pairs.filter((F.col("share") >= GENERALISE) & told_enough).groupBy("term")
    best = F.max(F.struct((-F.col("level")).alias("specific"), F.col("share"))).alias("best")
    return out.agg(best).select("term", F.col("best.share").alias("share"), (-F.col("best.specific")).alias("level"))


def term_filter(terms: DataFrame) -> bytes:
    """A bit per CRC-32 of a term, modulo FILTER_BITS: of fixed size, however many terms there are."""
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS))
    grouped = terms.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 8).alias("at"))
    bits = bytearray(FILTER_BITS // 8)
    for r in grouped.agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 AS int)))").alias("bits")).toLocalIterator():
        bits[r["at"]] = r["bits"]
    return bytes(bits)


def find_terms(docs: DataFrame, id_column: str, text: str, terms: DataFrame) -> DataFrame:
    """(_id, spans, hits) of each text: its base spans, and where terms of the filter stand outside them."""
    source = _texts(docs, id_column, text)
    fields = T._parse_datatype_string("spans array<string>, hits array<struct<term:string,start:int,end:int>>").fields
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType), *fields])
    arrow = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    sent = docs.sparkSession.sparkContext.broadcast(term_filter(terms))

    def run(batches):
        bits = sent.value
        known: dict[str, bool] = {}

        def wanted(word: str) -> bool:
            for m in _TERM.finditer(word):
                at = zlib.crc32(m.group().casefold().encode("utf-8", "surrogatepass")) % FILTER_BITS
                if bits[at >> 3] >> (at & 7) & 1:
                    return True
            return False

        for whole in batches:
            for batch in blocks(whole, "_text"):
                spans, hits = [], []
                for value in batch.column("_text").to_pylist():
                    found = base_spans(value)
                    spans.append([f"{k}:{a}:{b}" for a, b, k in found])
                    words = value.split()
                    for w in set(words).difference(known):
                        known[w] = wanted(w)
                    own = []
                    if any(known[w] for w in words):
                        clear = _clear(found)
                        at = 0
                        for w in words:
                            at = value.index(w, at)
                            if known[w]:
                                own += [
                                    {"term": m.group().casefold(), "start": at + m.start(), "end": at + m.end()}
                                    for m in _TERM.finditer(w)
                                    if clear(at + m.start(), at + m.end())
                                ]
                            at += len(w)
                    hits.append(own)
                    if len(known) > 2 * COUNTED_TERMS:
                        known.clear()
                columns = [
                    batch.column("_id"),
                    pa.array(spans, pa.list_(pa.string())),
                    pa.array(hits, pa.list_(arrow)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, removed (the terms to remove).

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; null and empty texts
    have none. Rows with the same id are rows of their own. Other columns are not looked at.
    """
    scanned = store(scan(docs, id_column, text), "pii-scan")
    texts = scanned.filter("spans IS NOT NULL")
    revealing = store(revealing_terms(scanned, texts.count()), "pii-terms")
    if revealing.isEmpty():
        hits = F.array().cast("array<struct<term:string,start:int,end:int>>")
        found = texts.select("_id", "spans", hits.alias("hits"), row_id().alias("_row"))
    else:
        found = store(find_terms(docs, id_column, text, revealing.select("term")).withColumn("_row", row_id()), "pii-docs")
    places = found.select("_row", F.inline("hits"))
    counted = places.groupBy("term").agg(F.count("*").alias("n"))
    spans = hot_join(places, revealing.join(counted, "term"), ["term"], "n", places.count()).filter("share IS NOT NULL")
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "share")
    own = spans.groupBy("_row").agg(F.collect_list(span).alias("terms"))
    parts = F.transform(
        "spans",
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(s, ":")[0]).cast("int").alias("kind"),
            F.split(s, ":")[2].cast("int").alias("end"),
        ),
    )
    terms = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,share:double>>")),
        lambda s: F.struct(s["start"].alias("start"), (s["kind"] + 1).alias("kind"), s["end"].alias("end")),
    )
    ordered = F.transform(
        F.array_sort(F.concat(parts, terms)),
        lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"]),
    )
    removed = F.transform(
        F.filter(F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,share:double>>")), lambda s: s["share"] >= REMOVE),
        lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]),
    )
    number = lambda kind: F.size(F.filter("spans", lambda s: s.startswith(kind + ":"))).cast("long")
    return found.join(own, "_row", "left").select(
        F.col("_id").alias(id_column),
        *[number(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.array_join("spans", ","), 256).alias("base_sha256"),
        F.array_join(ordered, ",").alias("spans"),
        F.array_join(F.array_sort(removed), ",").alias("removed"),
    )


def general_form(term: str) -> str:
    """What stands for a term that is generalised: its kind only."""
    if any(c.isdigit() for c in term):
        return "[NUMBER]" if term.isdigit() else "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitise(text: str | None, spans: str, removed: str) -> str:
    """The text with base spans replaced by their kind, and terms generalised or removed. Overlaps are merged first."""
    text = text or ""
    gone = set(removed.split(",")) if removed else set()
    out, free = [], 0
    for part in spans.split(",") if spans else []:
        kind, start, end = part.split(":")
        a, b = int(start), int(end)
        if b <= free:
            continue
        out.append(text[free : max(free, a)])
        if a >= free:
            out.append("" if part in gone else general_form(text[a:b]) if kind == "term" else f"[{kind.upper()}]")
        free = b
    return "".join(out) + text[free:]


def sanitised_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `sanitised`, row by row, ids or not: null texts give empty ones, a column of that name is replaced, and an
    empty table gives no rows."""
    row, own = free_name(docs, "_sanitised_row"), free_name(docs, "_text_of_row")
    docs = store(docs.withColumn(row, row_id()), "pii-rows")
    found = find_personal_data(docs.select(row, F.col(text).alias(own)), row, own)
    spans, removed = free_name(docs, "spans"), free_name(docs, "removed")
    found = found.select(row, F.col("spans").alias(spans), F.col("removed").alias(removed))

    @F.pandas_udf("string")
    def clean(value: pd.Series, spans: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([sanitise(v, p or "", r or "") for v, p, r in zip(value, spans, removed)], dtype=object)

    cleaned = docs.join(found, row).withColumn("sanitised", clean(F.col(text).cast("string"), spans, removed))
    return cleaned.drop(row, spans, removed)
