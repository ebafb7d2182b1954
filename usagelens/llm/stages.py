"""Stages of the corpus pipeline: each calls one operator and acts on its decisions.

A document's row keeps the columns of ``documents`` through all stages but the last; n_chars follows the text.
Each stage judges all rows that the stage before kept, also rows without an id and several rows of one id: a row is
a document of its own.

Null and empty texts stay, without words, repeats or pieces; very long texts are judged whole; an empty table gives an empty result.
Further columns stay as they are, whatever their names: what a stage adds for itself takes a name that is free.  The tables between
the steps of a stage are removed when its decisions are written; those stay, with a few bytes a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from usagelens.llm import subword
from usagelens.llm.bwt import repeated_bytes
from usagelens.llm.pieces import encode_documents
from usagelens.llm.store import scratch, written
from usagelens.llm.token_groups import similar_documents
from usagelens.llm.winnow import contamination

KEEP = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """The name, or the first with a number behind it that no column has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(2, len(taken) + 3))) if n.lower() not in taken)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows and the column that names each of them, in the order of doc_id.

    That is doc_id itself where it is an integer, never null and never twice, so that the texts stay where they are.  Otherwise rows
    get a number in the order of doc_id, rows without an id last; rows of one id, or without one, follow their place in the
    table, so that they too are spread over tasks.  The numbers are written, as a second sort could cut its ranges elsewhere.
    """
    if docs.schema["doc_id"].dataType in (ByteType(), ShortType(), IntegerType(), LongType()):
        counts = docs.groupBy(F.col("doc_id").alias("k")).count().agg(F.max("count").alias("most"), F.count_if(F.col("k").isNull()).alias("nulls")).first()
        if (counts["most"] or 0) <= 1 and not counts["nulls"]:
            return docs, "doc_id"
    at, row = _free(docs, "_at"), _free(docs, "_row")
    order = [F.col("doc_id").asc_nulls_last(), F.col(at)]
    placed = docs.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.drop(at).withColumn(row, F.monotonically_increasing_id()), "numbered", keep=True), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier scores below 0.3 go; it learns as the query of operator 5 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    use = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = subword.train(docs, labels, F.col("quality"), use=use)
    score = _free(docs, "_score")
    return subword.score(docs, model, out=score).filter(F.col(score) >= KEEP).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays, of several such rows the first."""
    with scratch(spark):
        rows, key = _keyed(docs)
        found = similar_documents(rows, key=key)
        gone = written(found.filter(F.col(key) != F.col("component_id")).select(key), "gone", keep=True)
    return rows.join(gone, key, "left_anti").select(docs.columns)


def _whole_characters(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans, which are widened to the ends of the characters they cut through."""
    raw = text.cast("binary")
    size = F.octet_length(raw)

    def inside(at: Column) -> Column:
        """Whether the byte at this place goes on with a character."""
        return (at > 0) & (at < size) & F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")

    def moved(at: Column, by: int) -> Column:
        """The nearest place where a character begins; it has four bytes at most."""
        return F.coalesce(*[F.when(~inside(at + by * i), at + by * i) for i in range(3)], at + by * 3)

    wide = F.transform(spans, lambda s: F.struct(moved(s["first"].cast("int"), -1).alias("first"), moved(s["end"].cast("int"), 1).alias("end")))
    begins = F.concat(F.array(F.lit(0)), wide["end"])
    stops = F.concat(wide["first"], F.array(size))
    # Two spans that cut through the same character overlap.
    parts = F.zip_with(begins, stops, lambda x, y: F.substring(raw, x + 1, F.greatest(y - x, F.lit(0))).cast("string"))
    return F.array_join(parts, "")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat a document of smaller id, or an earlier row of the same id, go, and whole characters where they are cut through.

    Nothing else of a text changes.  Documents of which nothing is left go.
    """
    with scratch(spark):
        rows, key = _keyed(docs)
        spans = _free(docs, "_spans")
        some = repeated_bytes(rows, key=key).filter("n_removed > 0").select(key, F.col("spans").alias(spans))
        some = written(some, "spans", keep=True)
    kept = _free(docs, "_kept")
    joined = rows.join(some, key, "left").withColumn(kept, F.when(F.col(spans).isNotNull(), _whole_characters(F.col("text"), F.col(spans))))
    text = F.coalesce(kept, "text")
    out = joined.filter(F.col(kept).isNull() | (F.col(kept) != "")).withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return out.withColumn("text", text).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    with scratch(spark):
        rows, key = _keyed(docs)
        found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
        bad = written(found.filter("contaminated").select(key), "contaminated", keep=True)
    return rows.join(bad, key, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation of each text, with the n best; a null text has null ids.

    Columns named as the added ones are replaced.
    """
    # A worker keeps what it remembers beside the memory of other stages.
    return encode_documents(docs, remembered=50_000).drop("text", "n_chars")
