"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, html, langid, lmscore, mixing, mtree, neardup, ngramjoin, sharding, urlfilter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_sharding": sharding.op1_sharding,
        "op2_bpe": bpe.op2_bpe,
        "op3_langid": langid.op3_langid,
        "op4_mixing": mixing.op4_mixing,
        "op5_ngram_join": ngramjoin.op5_ngram_join,
        "op6_html": html.op6_html,
        "op7_embedding_neardup": neardup.op7_embedding_neardup,
        "op8_lm_score": lmscore.op8_lm_score,
        "op9_topk": mtree.op9_topk,
        "op10_url_filter": urlfilter.op10_url_filter,
    }


_COMPONENTS = """r(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.c FROM r JOIN both_ways l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS k FROM both_ways GROUP BY a)"""

_OP5 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id, coalesce(n.k, 0) AS n_links FROM s JOIN m ON s.doc_id = m.id LEFT JOIN n ON s.doc_id = n.id"""

_VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"

_OP7 = f"""WITH RECURSIVE {_VECTORS},
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT vec_id AS id FROM v),
{_COMPONENTS}
SELECT m.id AS vec_id, coalesce(n.k, 0) AS n_links, m.c AS component_id, m.id = m.c AS kept FROM m LEFT JOIN n ON m.id = n.id"""

_OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """The others draw on hashes, merges, models or a tree builder, which SQL can't express; tests hold them against brute force."""
    return {"op5_ngram_join": _OP5, "op7_embedding_neardup": _OP7, "op9_topk": _OP9}
