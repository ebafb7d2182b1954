"""Queries of the operators that are DataFrame functions throughout: 2, 8 and 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.llm.hilbert import shards_by_curve
from usagelens.llm.queries import query, table
from usagelens.llm.winnow import contamination


@query("op8_hilbert_shards")
def op8_hilbert_shards(spark, d):
    placed = shards_by_curve(table(spark, d, "documents"), ["source", "lang", "n_chars"], 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0),
win AS (SELECT item_id, array_to_string(w[s : s + 12], ' ') AS g, least(len(w), 13) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM places),
hits AS (SELECT doc_id, p, g.n, item_id FROM grams g JOIN win USING (g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op9_winnowing", OP9_SQL)
def op9_winnowing(spark, d):
    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("items")
