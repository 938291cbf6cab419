"""Profiles of every document and conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import documents as doc
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, table


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


_TYPE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in ws)} THEN '{k}'" for k, ws in doc.CONTENT_TYPES
) + " ELSE 'document' END"


@query(
    "content_types",
    f"SELECT doc_id, {_TYPE} AS content_type, {' OR '.join(f"contains(lower(text), '{m}')" for m in doc.STRUCTURE_MARKERS)} AS has_structure FROM documents",
)
def content_types(spark, folder):
    text = F.col("text")
    return docs(spark, folder).select("doc_id", doc.content_type(text).alias("content_type"), doc.has_structure(text).alias("has_structure"))


_S = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_UP = "(upper(s) = s AND lower(s) <> s)"
_HEAD = rf"CASE WHEN {_UP} AND length(s) < 80 THEN 'uppercase' WHEN regexp_matches(s, '{doc.NUMBERED_HEADING}') THEN 'numbered' WHEN s LIKE '%:' AND length(s) < 100 THEN 'colon' END"


def _count(pattern):
    return f"len(regexp_extract_all(text, '{pattern}'))::BIGINT"


@query(
    "structural_elements",
    rf"""WITH l AS (SELECT doc_id, x, {_S} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
      h AS (SELECT doc_id, count(*) FILTER (WHERE k = 'uppercase') AS uppercase_headings, count(*) FILTER (WHERE k = 'numbered') AS numbered_headings,
          count(*) FILTER (WHERE k = 'colon') AS colon_headings,
          count(*) FILTER (WHERE length(x) - length(replace(x, '|', '')) > 2 OR length(x) - length(replace(x, chr(9), '')) > 2) AS table_lines
        FROM (SELECT *, {_HEAD} AS k FROM l) GROUP BY 1),
      p AS (SELECT doc_id, len(list_filter_p) AS paragraphs, coalesce(list_avg([len([w for w in regexp_split_to_array(q, '\s+') if w <> ''])::DOUBLE for q in list_filter_p]), 0) AS mean_paragraph_length
        FROM (SELECT doc_id, [q for q in string_split(text, chr(10) || chr(10)) if regexp_matches(q, '\S')] AS list_filter_p FROM documents))
      SELECT doc_id, uppercase_headings, numbered_headings, colon_headings, {_count('(?m)' + doc.BULLET)} AS bullet_points, {_count('(?m)' + doc.NUMBERED_ITEM)} AS numbered_items,
        table_lines, {_count(doc.SECTIONS)} AS sections, paragraphs::BIGINT AS paragraphs, round(mean_paragraph_length, 6) AS mean_paragraph_length
      FROM documents JOIN h USING (doc_id) JOIN p USING (doc_id)""",
)
def structural_elements(spark, folder):
    return rounded(doc.structural_elements(docs(spark, folder), ["doc_id"]), mean_paragraph_length=6)


_DATES = " + ".join(_count(p) for p in doc.DATES)
# Word boundaries differ between regular-expression engines on accented letters, so the twin leaves those out.
_PLAIN = [n for n in doc.COMPONENTS if n not in ("numbers_found", "emails_found")]


@query(
    "content_components",
    f"SELECT doc_id, {_DATES} AS dates_found, {', '.join(f'{_count(doc.COMPONENTS[n])} AS {n}' for n in _PLAIN)} FROM documents",
)
def content_components(spark, folder):
    return doc.content_components(docs(spark, folder), ["doc_id"]).select("doc_id", "dates_found", *_PLAIN)


@query("content_components_full")
def content_components_full(spark, folder):
    return doc.content_components(docs(spark, folder), ["doc_id"])


@query(
    "vocabulary",
    r"""SELECT doc_id, len(w)::BIGINT AS total_words, len(list_distinct([lower(x) for x in w]))::BIGINT AS unique_words,
        round(coalesce(len(list_distinct([lower(x) for x in w]))::DOUBLE / nullif(len(w), 0), 0), 6) AS lexical_diversity,
        round(coalesce(list_sum([length(x) for x in w])::DOUBLE / nullif(len(w), 0), 0), 6) AS mean_word_length, f AS has_formatting
        FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] AS w,
          contains(text, '*') OR contains(text, '_') OR contains(text, '`') AS f FROM documents)""",
)
def vocabulary(spark, folder):
    return rounded(doc.vocabulary(docs(spark, folder), ["doc_id"]), lexical_diversity=6, mean_word_length=6)


_CLASS = rf"""CASE WHEN length(s) = 0 THEN 'blank' WHEN contains(s, '|') OR contains(s, chr(9)) THEN 'table' WHEN {_UP} AND length(s) < 100 THEN 'header1'
    WHEN regexp_matches(s, '{doc.NUMBERED_TITLE}') THEN 'header2' WHEN s LIKE '%:' AND length(s) < 100 AND NOT regexp_matches(s, '\d{{1,2}}:\d{{2}}') THEN 'header2'
    WHEN regexp_matches(x, '{doc.BULLET}') THEN 'bullet' WHEN regexp_matches(x, '{doc.NUMBERED_ITEM}') THEN 'numbered' ELSE 'text' END"""


@query(
    "text_blocks",
    rf"""WITH l AS (SELECT doc_id, i, x, {_S} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
      a0 AS (SELECT *, {_CLASS} AS k, (contains(x, '|') OR contains(x, chr(9)) OR length(s) = 0) AS ft FROM l),
      a1 AS (SELECT *, sum((NOT ft)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r0 FROM a0),
      a2 AS (SELECT * REPLACE (CASE WHEN ft AND k <> 'blank' AND bool_or(k = 'table') OVER (PARTITION BY doc_id, r0 ORDER BY i) THEN 'table' ELSE k END AS k) FROM a1),
      a AS (SELECT *, regexp_matches(x, '{doc.BULLET}') AS fb, regexp_matches(x, '{doc.NUMBERED_ITEM}') AS fn FROM a2),
      b1 AS (SELECT *, sum((NOT fb)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM a),
      b AS (SELECT * REPLACE (CASE WHEN fb AND bool_or(k = 'bullet') OVER (PARTITION BY doc_id, r ORDER BY i) THEN 'bullet' ELSE k END AS k) FROM b1),
      c1 AS (SELECT *, sum((NOT fn)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r2 FROM b),
      c AS (SELECT * REPLACE (CASE WHEN fn AND bool_or(k = 'numbered') OVER (PARTITION BY doc_id, r2 ORDER BY i) THEN 'numbered' ELSE k END AS k) FROM c1),
      d AS (SELECT *, lag(k) OVER w AS prev, last_value(CASE WHEN k <> 'blank' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solid
        FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      e AS (SELECT *, sum((k <> 'blank' AND NOT coalesce((k IN ('bullet', 'numbered', 'text') AND prev = k AND NOT (k = 'text' AND s LIKE '%:' AND length(s) < 100))
          OR (k = 'table' AND solid = 'table'), false))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM d)
      SELECT doc_id, block::BIGINT AS block, CASE WHEN k LIKE 'header%' THEN 'header' WHEN k = 'bullet' THEN 'bullet_list' WHEN k = 'numbered' THEN 'numbered_list' WHEN k = 'text' THEN 'paragraph' ELSE 'table' END AS kind,
        CASE k WHEN 'header1' THEN 1 WHEN 'header2' THEN 2 END AS level, count(*) AS lines,
        CASE WHEN k = 'text' THEN string_agg(s, ' ' ORDER BY i) ELSE string_agg(CASE WHEN k = 'bullet' THEN regexp_replace(x, '{doc.BULLET}', '') WHEN k = 'numbered' THEN regexp_replace(x, '{doc.NUMBERED_ITEM}', '') ELSE s END, chr(10) ORDER BY i) END AS content
      FROM e WHERE k <> 'blank' GROUP BY doc_id, block, k""",
)
def text_blocks(spark, folder):
    return doc.blocks(docs(spark, folder), ["doc_id"])


@query(
    "page_words",
    r"""WITH p AS (SELECT conv_id, turn, len([x for x in regexp_split_to_array(text, '\s+') if x <> ''])::BIGINT AS n FROM conversations)
       SELECT conv_id, count(*) AS pages, round(avg(n), 6) AS mean_words, arg_max(turn, (n, -turn)) AS longest_page, arg_min(turn, (n, turn)) AS shortest_page FROM p GROUP BY 1""",
)
def page_words(spark, folder):
    return rounded(doc.page_words(table(spark, folder, "conversations"), "conv_id", "turn"), mean_words=6)
