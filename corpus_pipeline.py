"""A corpus, from raw documents to packed sequences: rules, classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, of whatever names and types. In every stage a null
text is an empty one, repeated rows and ids are judged each alike, long texts are read whole, and an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import copies, packing, quality, rules, simhash
from millrace.llm.common import durable, fresh, table

#: Numbers of dropped rows that are broadcast at most (8 bytes each); more of them meet the rows by a shuffle.
BROADCAST_ROWS = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules (as one without words does) or whose content share is too low. The field
    is trained on labelled documents of the whole table."""
    field = rules.fit(*rules.training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", rules.TRAINING_DOCS))
    return rules.keep(docs, field)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be of low quality; without labels of both kinds it drops none or
    all, as the labels say."""
    return quality.keep(docs, quality.trained(spark, sf_dir))


def _firsts(docs: DataFrame, choose) -> DataFrame:
    """The rows of docs that choose(rows with key, rank and text) names by their keys.

    Rows are numbered and stored once, so that a number names a row whatever its columns hold; rows alike differ in it.
    """
    number = fresh(docs, "number")
    rows = durable(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    ranked = rows.select(F.col(number).alias("key"), F.struct("doc_id", F.col(number).alias("number")).alias("rank"), "text")
    heads = choose(ranked).select(F.col("key").alias(number))
    dropped = durable(rows.select(number).join(heads, number, "left_anti"), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, number, "left_anti").drop(number)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies, whose five-word shingles have a Jaccard similarity of 0.8 or more, the
    document with the smallest doc_id (null first), of equal ids one. Documents without words are copies of each other."""
    return _firsts(docs, copies.heads)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same by op7's links of four bits alone, which most near copies at 0.8 lie beyond; no stage of the pipeline."""

    def choose(ranked):
        found = simhash.near_duplicates(ranked, id_col="rank")
        return found.filter(F.col("id") == F.col("component")).select(F.col("id.number").alias("key"))

    return _firsts(docs, choose)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 1024 tokens. A document without a text is its end alone."""
    cut = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(durable(cut, "pieces"), order=("doc_id", "piece", "ids_crc32"))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL can't express the trained models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
