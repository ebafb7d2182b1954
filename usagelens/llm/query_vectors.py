"""Queries of the operators on whole tables of vectors: 11, 12 and 13."""

from __future__ import annotations

from usagelens.llm.codebooks import compress
from usagelens.llm.pca_tiles import linked_vectors
from usagelens.llm.queries import query, table
from usagelens.llm.whitening import whiten

GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND {GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) JOIN (SELECT id AS vec_id, min(r) AS component_id FROM reach GROUP BY 1) USING (vec_id)"""


@query("op11_pca_tiles", OP11_SQL)
def op11_pca_tiles(spark, d):
    return linked_vectors(table(spark, d, "embeddings"))


def _assign(out: str, entries: str) -> str:
    """SQL for one assignment of all parts to the entries of their codebook."""
    return f"""
{out} AS (SELECT id, p, any_value(s) AS s, min(d * 64 + e)::BIGINT % 64 AS e, min(d)::BIGINT AS d FROM (
  SELECT id, parts.p, s, e, list_dot_product(s, s) - 2 * list_dot_product(s, c) + list_dot_product(c, c) AS d FROM parts JOIN {entries} ON parts.p = {entries}.p) GROUP BY id, p)"""


def _update(out: str, entries: str, assigned: str) -> str:
    """SQL for the entries after their parts' means are taken."""
    return f"""
{out} AS (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM {entries} o LEFT JOIN (SELECT p, e, list(floor(t / n) ORDER BY j) AS c FROM (
  SELECT p, e, j, sum(s[j]) AS t, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, (SELECT max(len(s)) FROM parts) + 1)) AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2) m ON o.p = m.p AND o.e = m.e)"""


OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE {GOOD}),
parts AS (SELECT id, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS s FROM v, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, id - 1 AS e, s AS c FROM parts WHERE id <= 64),{_assign("a0", "c0")},{_update("c1", "c0", "a0")},{_assign("a1", "c1")},{_update("c2", "c1", "a1")},{_assign("a2", "c2")},
h AS (SELECT sha256(string_agg(z, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(list_transform(c, lambda x: x::BIGINT::VARCHAR)) AS z, generate_subscripts(c, 1) AS j FROM c2)),
r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (id), h"""


@query("op12_active_lloyd", OP12_SQL)
def op12_active_lloyd(spark, d):
    return compress(table(spark, d, "embeddings"))


@query("op13_jacobi_davidson")
def op13_jacobi_davidson(spark, d):
    return whiten(table(spark, d, "embeddings"))
