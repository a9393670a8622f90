"""Document pipeline: quality rules, toxicity, near duplicates, packing.

Every stage works on all rows that its predecessor kept and returns the columns of ``documents``; the
last one returns packed pieces. Rows with null or repeated ids pass the filters each by its own text;
near duplicates keep rows with a null id, and one row of each repeated id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from probcast.llm import packing, quality_rules, shingle_join, toxicity
from probcast.llm.common import read_table, stored

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    measured = stored(quality_rules.text_statistics(docs, keep=DOCUMENT_COLUMNS))
    rules = quality_rules.fit_decision_list(quality_rules.labelled_statistics(
        measured.select("doc_id", *quality_rules.STATISTICS), read_table(spark, sf_dir, "labels")))
    return quality_rules.apply_decision_list(measured, rules).filter("kept").select(*DOCUMENT_COLUMNS)


def keep_by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, DOCUMENT_COLUMNS)
    return scored.filter("score < 0.5").select(*DOCUMENT_COLUMNS)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (5 words, similarity 0.8)."""
    found = stored(shingle_join.jaccard_components(docs, options=shingle_join.JoinOptions(words=5, percent=80)))
    kept = found.filter("id = component").select(F.col("id").alias("doc_id")).distinct()
    chosen = docs.join(kept, "doc_id", "left_semi")
    if found.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), "lang", "source", "n_chars")
        chosen = chosen.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")
    return chosen.unionByName(docs.filter("doc_id IS NULL")).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    packed = packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_by_quality_rules),
    ("toxicity", keep_by_toxicity),
    ("n-gram Jaccard join", keep_one_per_group),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # learned rules, string kernels and tokenisers have no SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs)
    return docs
