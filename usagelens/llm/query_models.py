"""Queries of the operators that learn from labels: 1, 2 and 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.llm import subword, toxicity
from usagelens.llm.queries import query, table
from usagelens.llm.url_rules import judge_urls

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _held_out(key):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


@query("op1_toxicity_chain")
def op1_toxicity_chain(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.train(docs, labels, categories, use=~_held_out("doc_id"))
    return toxicity.score(docs.select("doc_id", "text"), chain, list(categories)).select("doc_id", "p_low_quality", "p_toxic", "toxic")


@query("op2_url_rules")
def op2_url_rules(spark, d):
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return judge_urls(table(spark, d, "pages"), table(spark, d, "labels"), URL_RULES, bad)


@query("op5_subword_quality")
def op5_subword_quality(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = subword.train(docs, labels, F.col("quality"), use=~_held_out("doc_id"))
    scored = subword.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
