"""Longer pieces of the SQL twins of this subpackage's queries."""

from __future__ import annotations


def crc32_of(text: str) -> str:
    """CRC-32 of an ASCII text expression, bit by bit: a byte is added, -1 is a shift."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split({text}, ''),
          lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""


def _on(path: str, cost: str, letter: str) -> str:
    """A path of eight digits of cost and the edits so far, continued; null stays null."""
    return f"lpad((substr({path}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({path}, 9) || '{letter}'"


def _inserted(columns: str, source: str) -> str:
    """Insertions after each state: three rounds reach every state."""
    for _ in range(3):
        source = f"""(SELECT {columns}, b, s, least(u, {_on('b', '2', 'I')}, {_on('s', '2', 'I')}, {_on('a', '2', 'I')}) AS u,
            least(a, {_on('u', '2', 'I')}) AS a FROM {source})"""
    return source


def repair_sql() -> str:
    """Paths to the states (b: nothing yet, s, u, a) as sortable strings, turn by turn, then the edits letter by letter."""
    free = "fault NOT IN ('blank', 'duplicate')"
    keep = "(fault = 'truncated')::BIGINT"
    rerole = f"2 + {keep}"
    deleted = {x: _on(x, "3", "D") for x in "bsua"}
    to_user = ", ".join(
        [f"CASE WHEN {free} AND initial = 'u' THEN {_on(x, keep, 'K')} END, CASE WHEN {free} THEN {_on(x, rerole, 'R')} END" for x in "bsa"]
    )
    to_assistant = f"CASE WHEN {free} AND initial = 'a' THEN {_on('u', keep, 'K')} END, CASE WHEN {free} THEN {_on('u', rerole, 'R')} END"
    step = f"""(SELECT conv_id, k, {deleted['b']} AS b,
          least({deleted['s']}, CASE WHEN {free} AND initial = 's' THEN {_on('b', keep, 'K')} END) AS s,
          least({deleted['u']}, {to_user}) AS u, least({deleted['a']}, {to_assistant}) AS a FROM joined)"""
    begin = "(SELECT conv_id, 0::BIGINT AS k, '00000000' AS b, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM c)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
    WITH RECURSIVE c AS (SELECT DISTINCT conv_id FROM conversations
    ), k AS (SELECT key, {crc32_of('key')} % 20 AS kind FROM (SELECT DISTINCT {key} AS key FROM conversations)
    ), m AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM conversations JOIN k ON key = {key} WHERE kind <> 0
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, substr(role, 1, 1) AS initial,
             regexp_matches(text, '[^\x20\x09-\x0D]') AS filled, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS ended
      FROM m
    ), d AS (
      SELECT *, CASE WHEN NOT filled THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                     WHEN NOT ended THEN 'truncated' ELSE 'sound' END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS two
      FROM o
    ), f AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
      FROM d GROUP BY conv_id
    ), p AS (
      SELECT * FROM {_inserted("conv_id, k", begin)}
      UNION ALL
      SELECT * FROM {_inserted("conv_id, k", step.replace("FROM joined", "FROM (SELECT p.conv_id, d.k, p.b, p.s, p.u, p.a, d.initial, d.fault FROM p JOIN d ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND d.k = p.k + 1)"))}
    ), best AS (
      SELECT c.conv_id, gaps, coalesce(n, 0) AS n, blank, duplicate, truncated, illegal, least(b, a) AS path
      FROM c LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
      JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.k = coalesce(n, 0)
    ), e AS (  -- edits one by one: place in the string, turns read, last role's initial, lines so far
      SELECT conv_id, 0 AS place, 0 AS k, '' AS state, []::VARCHAR[] AS lines, path FROM best
      UNION ALL
      SELECT conv_id, place, k, CASE letter WHEN 'D' THEN state WHEN 'K' THEN initial ELSE given[1] END,
             CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                         WHEN 'R' THEN list_append(lines, given || ':' || text) ELSE list_append(lines, given || ':') END, path
      FROM (
        SELECT g.*, CASE WHEN g.state = 'u' THEN 'assistant' ELSE 'user' END AS given, d.role, d.text, d.initial
        FROM (
          SELECT conv_id, place + 1 AS place, k + (substr(path, place + 9, 1) <> 'I')::INTEGER AS k, state, lines, path,
                 substr(path, place + 9, 1) AS letter
          FROM e WHERE length(path) > place + 8
        ) g LEFT JOIN d ON g.conv_id IS NOT DISTINCT FROM d.conv_id AND d.k = g.k
      )
    )
    SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, substr(b.path, 1, 8)::BIGINT AS cost,
           substr(b.path, 9) AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
    FROM best b JOIN e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND e.place + 8 = length(b.path)
    """
