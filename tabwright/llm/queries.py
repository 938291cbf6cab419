"""One query per operator of this subpackage, over its whole table, with a SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import bpe, conversations, exact_dedup, html_text, language_id, merkle, mixing, near_vectors, ngram_join, pii, sharding, topk, warc
from tabwright.llm.common import table
from tabwright.llm.sql import crc32_of, repair_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query(
    "op6_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op6_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).drop("_row", "_text_hash")


@query("op4_feistel_shards")
def op4_feistel_shards(spark, folder):
    return sharding.shard_rows(table(spark, folder, "documents")).drop("permuted")


@query(
    "op10_fair_queue_mix",
    """
    WITH d AS (
      SELECT doc_id, source, md5('42|' || doc_id) AS turn,
             len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size
      FROM documents
    ), s AS (
      SELECT source, source_size, place, [3, 1, 2][place % 3 + 1]::BIGINT AS weight
      FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
            FROM d GROUP BY source)
    ), f AS (  -- sources by how soon they are full; the first k are full
      SELECT *, sum(source_size * 2) OVER w AS spent, (SELECT sum(weight) FROM s) - sum(weight) OVER w AS shared,
             row_number() OVER w AS k
      FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS UNBOUNDED PRECEDING)
    ), g AS (
      SELECT *, coalesce(lag(spent) OVER (ORDER BY k), 0) AS before, coalesce(lag(shared) OVER (ORDER BY k),
             (SELECT sum(weight) FROM s)) AS left_weight, (SELECT sum(source_size) FROM s) AS words
      FROM f
    ), n AS (  -- the first source that is not full decides the level
      SELECT before, left_weight FROM g WHERE weight * (3 * words - 2 * before) <= 4 * source_size * left_weight
      ORDER BY k LIMIT 1
    ), t AS (
      SELECT g.source, g.source_size, g.place,
             CASE WHEN weight * (3 * words - 2 * n.before) > 4 * source_size * n.left_weight THEN (2 * source_size)::DOUBLE
                  ELSE weight::DOUBLE * ((3 * words - 2 * n.before)::DOUBLE / 2) / n.left_weight::DOUBLE END AS target
      FROM g, n
    ), q AS (
      SELECT d.*, t.source_size, t.target, t.place,
             sum(size) OVER (PARTITION BY t.place ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS given
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), c AS (
      SELECT q.*, epoch, CASE WHEN target > 0 THEN (epoch * source_size + given)::DOUBLE / target ELSE 0 END AS finish
      FROM q, (VALUES (0), (1)) e(epoch)
    ), m AS (
      SELECT *, sum(size) OVER (ORDER BY finish, place, epoch, turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent_words
      FROM c
    )
    SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
           sum(CASE WHEN spent_words <= (SELECT sum(target) FROM t) THEN size ELSE 0 END)::BIGINT AS taken
    FROM m GROUP BY doc_id
    """,
)
def op10_fair_queue_mix(spark, folder):
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_byte_bpe")
def op2_byte_bpe(spark, folder):
    return bpe.encode_decode(table(spark, folder, "documents"))


@query(
    "op9_content_addressed_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages)
    SELECT page_id, strlen(html) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)),
               'string_agg', '') AS payload_digest,
           CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to,
           true AS verified
    FROM p WINDOW w AS (PARTITION BY html)
    """,
)
def op9_content_addressed_warc(spark, folder):
    return warc.archived_pages(table(spark, folder, "pages"))


@query("op3_disclosing_terms")
def op3_disclosing_terms(spark, folder):
    return pii.find_personal_data(table(spark, folder, "documents"))


@query("op7_viterbi_language_id")
def op7_viterbi_language_id(spark, folder):
    docs = language_id.held_out(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    out = language_id.predict(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_spans")


@query(
    "op8_segment_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op8_segment_topk(spark, folder):
    return topk.search(table(spark, folder, "embeddings"))


@query("op1_template_text")
def op1_template_text(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query(
    "op5_blocked_ngram_join",
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
      FROM documents
    ), s AS (
      SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g
      FROM d
    ), c AS (SELECT g, min(doc_id) AS u FROM s WHERE len(g) > 0 GROUP BY g
    ), e AS (SELECT u, len(g) AS n, unnest(g) AS x FROM c
    ), p AS (
      SELECT a.u, b.u AS v FROM e a JOIN e b ON a.x = b.x AND a.u < b.u
      GROUP BY a.u, b.u HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
    ), l AS (SELECT u, v FROM p UNION SELECT v, u FROM p
    ), r AS (SELECT u AS node, u AS root FROM c UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node
    ), m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
    SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
    FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON m.node = c.u
    """,
)
def op5_blocked_ngram_join(spark, folder):
    return ngram_join.similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    "op11_postorder_merkle",
    """
    WITH RECURSIVE t AS (
      SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
             || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
             coalesce(strlen(text) || ':' || text, '-') AS tail
      FROM documents
    ), crc AS (
      SELECT doc_id, """ + crc32_of("doc_id::VARCHAR") + """ AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    ), d AS (
      SELECT t.doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
             CASE WHEN c % 7 = 0 AND n_chars IS NOT NULL
                  THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS claimed
      FROM t LEFT JOIN crc ON t.doc_id = crc.doc_id
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d
    ), g AS (
      SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
      FROM (SELECT lang, list(leaf ORDER BY place) AS nodes FROM o GROUP BY lang)
    ), low AS (
      SELECT tree, 0 AS level, nodes FROM g
      UNION ALL
      SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
             lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM low WHERE len(nodes) > 1
    ), sub AS (SELECT tree, level AS height, nodes[1] AS subroot FROM low WHERE len(nodes) = 1
    ), high AS (
      SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM sub
      UNION ALL
      SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2),
             lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM high WHERE len(nodes) > 1
    ), up AS (  -- each level's sibling, marked with its side
      SELECT o.doc_id, o.place, g.tree, low.level, o.place // (1 << low.level) AS i, low.nodes
      FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang JOIN low ON low.tree = g.tree WHERE len(low.nodes) > 1
      UNION ALL
      SELECT o.doc_id, o.place, g.tree, sub.height + high.level, g.tree // (1 << high.level), high.nodes
      FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang JOIN sub ON sub.tree = g.tree, high WHERE len(high.nodes) > 1
    ), way AS (
      SELECT tree, place, list(CASE WHEN i % 2 = 1 THEN 'l' || nodes[i] ELSE 'r' || coalesce(nodes[i + 2], '') END ORDER BY level) AS s
      FROM up GROUP BY tree, place
    ), folded AS (
      SELECT o.doc_id, o.leaf, sub.subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
             sha256(coalesce(array_to_string(list_transform(s, lambda x: x[2:]), ''), '')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(claimed, leaf), coalesce(s, [])), lambda a, x:
               CASE WHEN x[1] = 'l' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root
      FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang JOIN sub ON sub.tree = g.tree
      LEFT JOIN way ON way.tree = g.tree AND way.place = o.place
    )
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def op11_postorder_merkle(spark, folder):
    docs = table(spark, folder, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = merkle.record_digest([*columns, F.col("n_chars") + 1, F.col("text")])
    return merkle.audit(docs, claimed=F.when(chosen & F.col("n_chars").isNotNull(), tampered))


@query("op13_conversation_repair", repair_sql())
def op13_conversation_repair(spark, folder):
    out = conversations.repair(table(spark, folder, "conversations"))
    return out.withColumnRenamed("conv", "conv_id")


@query(
    "op12_collision_counting",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), l AS (
      SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9
    ), r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node
    ), m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node
    ), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON u = vec_id
    """,
)
def op12_collision_counting(spark, folder):
    return near_vectors.near_groups(table(spark, folder, "embeddings"))
