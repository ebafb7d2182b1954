"""Verdicts on urls: given rules first, then rules mined from labelled urls."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "=block"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of the (verdict, host, path) that fits, null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The parts of a url as a set of marked tokens; digits of a path part count as one sign."""
    host, path = host_of(url), path_of(url)
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), r"\d+", "0")))
    query = F.transform(F.filter(F.split(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(scheme, labels, parts, query)))


def mine_rules(labelled: DataFrame, items: str, block: str, min_support: float, min_confidence: float) -> DataFrame | None:
    """(tokens, confidence, support, rarest) of rules "these tokens, so block", by FP-growth over the labelled rows.

    ``rarest`` is the token of the rule that the fewest labelled rows have: the rule's place in an
    inverted index.  None if there is no labelled row.
    """
    rows = labelled.filter(F.col(block).isNotNull() & (F.size(items) > 0)).select(F.when(F.col(block), F.array_append(items, BLOCK)).otherwise(F.col(items)).alias("items"))
    if rows.isEmpty():
        return None
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.filter(F.array_contains("consequent", BLOCK)).select(F.col("antecedent").alias("tokens"), "confidence", "support")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    each = rules.select("*", F.explode("tokens").alias("token")).join(single, "token")
    return each.groupBy("tokens", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], block: Column, key: str = "page_id", label_key: str = "doc_id",
    url: str = "url", min_support: float = 0.002, min_confidence: float = 0.5,
) -> DataFrame:
    """(key, host, path, rule, verdict, because, confidence) of every row.

    Rows without a given rule are blocked if a mined rule fits: the one of highest confidence, then of
    most tokens, is named in ``because``.  All labelled rows are mined.  Each distinct url is looked
    up once, so a page that stands a million times costs one look-up; a mined rule is met through its
    rarest token only, and then compared with the url's tokens.

    A null url, or one without ``://``, has an empty host and path, no tokens, and is allowed; rows with a null
    key or repeated rows are judged like others; with no labels or no pages nothing is mined;
    labels of a key that stands twice count as blocked if one of them says so; other columns take no part.
    """
    known = labels.filter(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("_k")).agg(F.max(block).alias("_block"))
    taught = pages.select(F.col(key).alias("_k"), tokens(F.col(url)).alias("_items")).join(known, "_k")
    mined = mine_rules(taught, "_items", "_block", min_support, min_confidence)
    each = pages.select(F.col(key), F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    each = each.withColumn("_given", given_rule(F.col("host"), F.col("path"), rules))
    if mined is None:
        each = each.withColumns({"because": F.lit(None).cast("array<string>"), "confidence": F.lit(None).cast("double")})
    else:
        urls = pages.select(F.col(url).alias("_url")).filter(F.col("_url").isNotNull()).distinct().withColumn("_items", tokens(F.col("_url")))
        met = urls.select("_url", "_items", F.explode("_items").alias("rarest")).join(mined, "rarest")
        met = met.filter(F.forall("tokens", lambda t: F.array_contains("_items", t)))
        best = F.max(F.struct("confidence", F.size("tokens").alias("n"), F.array_sort("tokens").alias("tokens"))).alias("best")
        found = met.groupBy("_url").agg(best).select("_url", F.col("best.tokens").alias("because"), F.col("best.confidence").alias("confidence"))
        each = each.join(found, "_url", "left")
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return each.select(key, "host", "path", F.col("_given.rule").alias("rule"), F.coalesce("_given.verdict", own).alias("verdict"), "because", "confidence")
