"""Text profiles: content type, structure, components, vocabulary, blocks, pages.

Everything works on whole texts, inside the row that holds them.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keywords in the order they are tried, and section markers.
CONTENT_TYPES = [
    ("invoice", ["invoice", "bill"]),
    ("report", ["report", "analysis"]),
    ("letter", ["dear", "sincerely"]),
    ("contract", ["contract", "agreement"]),
]
STRUCTURE_MARKERS = ["chapter", "section", "1.", "2.", "introduction", "conclusion"]

# What counts as a component of a text.
COMPONENTS = {
    "currency_amounts": r"\$\s?\d+(?:,\d{3})*(?:\.\d{2})?",
    "percentages": r"\d+(?:\.\d+)?%",
    "numbers_found": r"(?<![\p{L}\p{N}_])\d+(?:,\d{3})*(?:\.\d+)?(?![\p{L}\p{N}_])",
    "emails_found": r"(?:(?<![\p{L}\p{N}_])(?=[A-Za-z0-9_])|(?<=[\p{L}\p{N}_])(?=[.%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}(?![\p{L}\p{N}_])(?<!\|)",
    "urls_found": r"https?://[^\s]+",
    "addresses_found": r"\d+\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)",
    "phone_numbers": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
}
DATES = [
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{4}-\d{2}-\d{2}",
    r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}",
]
NAMES = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![\p{L}\p{N}_])"
SECTIONS = r"(?i)(?:chapter|section|part|appendix)\s+\d+"
BULLET = r"^\s*[•\-\*]\s+"
NUMBERED_ITEM = r"^\s*\d+[\)\.]\s+"
# Makes ^ match after every line feed, and after nothing else.
EVERY_LINE = "(?dm)"
NUMBERED_HEADING = r"^\d+(\.\d+)*\.?\s+"
NUMBERED_TITLE = r"^\d+(\.\d+)*\.?\s+[A-Z]"


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def content_type(text: Column) -> Column:
    lowered = F.lower(text)
    chain = F
    for kind, words in CONTENT_TYPES:
        chain = chain.when(_any_of(lowered, words), kind)
    return chain.otherwise("document")


def has_structure(text: Column) -> Column:
    return _any_of(F.lower(text), STRUCTURE_MARKERS)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_upper(text: Column) -> Column:
    """At least one letter with case, and none of them small."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def structural_elements(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per document: headings by kind, bullets, numbered items, table lines, sections, paragraphs.

    Lines are classified in an array of the row itself: no shuffle, one output row per input row.
    """
    body = F.col(text)
    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("raw"), _strip(x).alias("s")))

    def heading(x):
        s = x["s"]
        return (
            F.when(is_upper(s) & (F.length(s) < 80), "uppercase")
            .when(s.rlike(NUMBERED_HEADING), "numbered")
            .when(s.endswith(":") & (F.length(s) < 100), "colon")
        )

    def total(array, test):
        return F.size(F.filter(array, test)).cast("bigint")

    def is_kind(kind):
        return lambda h: h == kind

    def marks(x, mark):
        return F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))

    rows = docs.select(*keys, body.alias("_t"), lines.alias("_l"))
    rows = rows.withColumn("_h", F.transform("_l", heading))
    paragraphs = F.filter(F.split("_t", "\n\n"), lambda p: F.length(_strip(p)) > 0)
    lengths = F.transform(paragraphs, lambda p: F.size(words(p)).cast("double"))
    rows = rows.withColumn("_p", lengths)
    return rows.select(
        *keys,
        *[total(F.col("_h"), is_kind(k)).alias(f"{k}_headings") for k in ("uppercase", "numbered", "colon")],
        count_matches(F.col("_t"), EVERY_LINE + BULLET).alias("bullet_points"),
        count_matches(F.col("_t"), EVERY_LINE + NUMBERED_ITEM).alias("numbered_items"),
        total(F.col("_l"), lambda x: (marks(x["raw"], "|") > 2) | (marks(x["raw"], "\t") > 2)).alias("table_lines"),
        count_matches(F.col("_t"), SECTIONS).alias("sections"),
        F.size("_p").cast("bigint").alias("paragraphs"),
        F.coalesce(
            F.try_divide(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x), F.size("_p")), F.lit(0.0)
        ).alias("mean_paragraph_length"),
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def content_components(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Counts of dates, amounts, numbers, addresses and the like, per document."""
    body = F.col(text)
    dates = reduce(lambda a, b: a + b, [count_matches(body, p) for p in DATES])
    names = F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(NAMES), F.lit(0)))).cast("bigint")
    return docs.select(
        *keys, dates.alias("dates_found"), *[count_matches(body, p).alias(n) for n, p in COMPONENTS.items()], names.alias("potential_names")
    )


def vocabulary(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Words, distinct words, lexical diversity, mean word length, formatting marks."""
    rows = docs.select(*keys, F.col(text).alias("_t"), words(F.col(text)).alias("_w"))
    total = F.size("_w")
    unique = F.size(F.array_distinct(F.transform("_w", lambda w: F.lower(w))))
    letters = F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    return rows.select(
        *keys,
        total.cast("bigint").alias("total_words"),
        unique.cast("bigint").alias("unique_words"),
        F.coalesce(F.try_divide(unique, total), F.lit(0.0)).alias("lexical_diversity"),
        F.coalesce(F.try_divide(letters, total), F.lit(0.0)).alias("mean_word_length"),
        _any_of(F.col("_t"), ["*", "_", "`"]).alias("has_formatting"),
    )


def line_class(line: Column) -> Column:
    """blank, table, header1, header2, bullet, numbered or text; the first rule that fits."""
    s = _strip(line)
    return (
        F.when(F.length(s) == 0, "blank")
        .when(s.contains("|") | s.contains("\t"), "table")
        .when(is_upper(s) & (F.length(s) < 100), "header1")
        .when(s.rlike(NUMBERED_TITLE), "header2")
        .when(s.endswith(":") & (F.length(s) < 100) & ~s.rlike(r"\d{1,2}:\d{2}"), "header2")
        .when(line.rlike(BULLET), "bullet")
        .when(line.rlike(NUMBERED_ITEM), "numbered")
        .otherwise("text")
    )


#: What the segmentation needs of a line: its class, whether it fits a running table or list, its text, whether it ends a paragraph.
_LINE_FIELDS = ("class", "celled", "bulleted", "counted", "item_bullet", "item_numbered", "stripped", "breaks")


def _line_facts(line: Column, stripped: Column) -> list[Column]:
    bulleted, counted = line.rlike(BULLET), line.rlike(NUMBERED_ITEM)
    facts = (
        line_class(line),
        line.contains("|") | line.contains("\t") | (F.length(stripped) == 0),
        bulleted,
        counted,
        F.when(bulleted, F.regexp_replace(line, BULLET, "")),
        F.when(counted, F.regexp_replace(line, NUMBERED_ITEM, "")),
        stripped,
        stripped.endswith(":") & (F.length(stripped) < 100),
    )
    return [f.alias(f"_{n}") for f, n in zip(facts, _LINE_FIELDS)]


def fold_lines(lines: list[tuple]) -> list[tuple]:
    """(kind, level, lines, content) of the blocks of classified lines, in one pass.

    Once a table or list has begun, every directly following line of its shape belongs to it, whatever else it looks like; a
    table goes on over blank lines. Headers stand alone; blank lines end a block, except inside a table.
    """
    found: list[tuple[str, list[str]]] = []
    table = bullets = numbers = False
    before = solid = None
    for kind, celled, bulleted, counted, item_bullet, item_numbered, stripped, breaks in lines:
        table = celled and (table or kind == "table")
        if table and kind != "blank":
            kind = "table"
        bullets = bulleted and (bullets or kind == "bullet")
        if bullets and kind != "blank":
            kind = "bullet"
        numbers = counted and (numbers or kind == "numbered")
        if numbers and kind != "blank":
            kind = "numbered"
        if kind != "blank":
            joined = kind in ("bullet", "numbered", "text") and before == kind and not (kind == "text" and breaks)
            item = {"bullet": item_bullet, "numbered": item_numbered}.get(kind, stripped)
            item = stripped if item is None else item
            if joined or (kind == "table" and solid == "table"):
                found[-1][1].append(item)
            else:
                found.append((kind, [item]))
            solid = kind
        before = kind
    names = {"bullet": "bullet_list", "numbered": "numbered_list", "text": "paragraph", "table": "table"}
    levels = {"header1": 1, "header2": 2}
    return [(names.get(k, "header"), levels.get(k), len(parts), (" " if k == "text" else "\n").join(parts)) for k, parts in found]


def blocks(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, block, kind, level, lines, content): consecutive lines of one class merged, blocks counted from 1.

    Lines are classified by expressions; a fold over a document's lines, which follow each other in their task, then forms its
    blocks. Nothing is shuffled.
    """
    # numbered before lines are made of them
    numbered = docs.select(*keys, F.monotonically_increasing_id().alias("_document"), F.split(F.col(text), "\n").alias("_lines"))
    rows = numbered.select(*keys, "_document", F.explode("_lines").alias("_line"))
    facts = rows.select(*keys, "_document", *_line_facts(F.col("_line"), _strip(F.col("_line"))))
    made = "block bigint, kind string, level int, lines bigint, content string"
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys] + T._parse_datatype_string(made).fields)
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]

    def fold(batches):
        current, own, lines = None, None, []  # the document at hand: its number, its keys, its lines so far
        for batch in batches:
            names, out = [], []
            numbers = batch.column("_document").to_pylist()
            columns = list(zip(*(batch.column(f"_{n}").to_pylist() for n in _LINE_FIELDS)))
            starts = [i for i, n in enumerate(numbers) if i == 0 or n != numbers[i - 1]]
            for start, stop in zip(starts, [*starts[1:], len(numbers)]):
                if numbers[start] != current:
                    for number, block in enumerate(fold_lines(lines), 1):
                        names.append(own)
                        out.append((number, *block))
                    current, own, lines = numbers[start], batch.slice(start, 1).select(keys), []
                lines += columns[start:stop]
            if out:
                yield results(names, out)
        last = [(number, *block) for number, block in enumerate(fold_lines(lines), 1)]
        if last:
            yield results([own] * len(last), last)

    def results(names, out):
        kept = pa.Table.from_batches(names).combine_chunks()
        arrays = [kept.column(k).chunk(0) if kept.num_rows else kept.column(k).combine_chunks() for k in keys]
        arrays += [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return facts.mapInArrow(fold, schema)


def page_words(pages: DataFrame, document: str, page: str, text: str = "text") -> DataFrame:
    """Per document: pages, mean words per page, and its longest and shortest page (the earliest of equals)."""
    counted = pages.select(document, F.col(page).alias("_p"), F.size(words(F.col(text))).cast("bigint").alias("_n"))
    return counted.groupBy(document).agg(
        F.count("*").alias("pages"),
        F.avg("_n").alias("mean_words"),
        F.max_by("_p", F.struct("_n", -F.col("_p"))).alias("longest_page"),
        F.min_by("_p", F.struct("_n", "_p")).alias("shortest_page"),
    )
