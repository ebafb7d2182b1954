"""Queries of the operators on pairs, passages, vectors and pieces: 3, 4, 6, 7 and 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.llm.bwt import repeated_bytes
from usagelens.llm.gear import chunk_dedup
from usagelens.llm.mtree import top_k
from usagelens.llm.pieces import encode_documents
from usagelens.llm.queries import query, table
from usagelens.llm.token_groups import similar_documents


@query("op3_gear_chunks")
def op3_gear_chunks(spark, d):
    out = chunk_dedup(table(spark, d, "documents"), ends=True)
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op4_mtree_top_k", OP4_SQL)
def op4_mtree_top_k(spark, d):
    vectors = table(spark, d, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0")).drop("computed")


OP6_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM h)),
low AS (SELECT g, min(doc_id) AS d FROM w GROUP BY g),
hit AS (SELECT doc_id, i FROM w JOIN low USING (g) WHERE d < doc_id),
spans AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS e FROM (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY 1, 2),
per AS (SELECT doc_id, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, sum(e - a) AS r, count(*) AS c FROM spans GROUP BY 1)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c IS NULL THEN x ELSE array_to_string(list_transform(range(0, c + 1), lambda k:
    substr(x, CAST(CASE WHEN k = 0 THEN 1 ELSE 2 * e[k] + 1 END AS BIGINT),
      CAST(CASE WHEN k = c THEN len(x) ELSE 2 * a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE 2 * e[k] END AS BIGINT))), '') END)) AS kept_sha256
FROM h LEFT JOIN per USING (doc_id)"""


@query("op6_bwt_merge", OP6_SQL)
def op6_bwt_merge(spark, d):
    return repeated_bytes(table(spark, d, "documents")).drop("kept", "spans")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


@query("op7_token_groups", OP7_SQL)
def op7_token_groups(spark, d):
    return similar_documents(table(spark, d, "documents"))


@query("op10_n_best_pieces")
def op10_n_best_pieces(spark, d):
    return encode_documents(table(spark, d, "documents").select("doc_id", "text")).drop("text")
