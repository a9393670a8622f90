"""The registered queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from probcast.llm import bm25_search, fixity, html_text, packing, piece_sampling, quality_model, quality_rules, rans, shingle_join, source_mix, toxicity, tree_search, vector_codes
from probcast.llm.common import held_out, read_table, stored
from probcast.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, base rule and learned verdict of every document."""
    stats = stored(quality_rules.text_statistics(read_table(spark, folder, "documents")))
    rules = quality_rules.fit_decision_list(
        quality_rules.labelled_statistics(stats, read_table(spark, folder, "labels")))
    return quality_rules.apply_decision_list(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read_table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, read_table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_shingle_jaccard_join")
def op7_shingle_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under 4-word shingle similarity of 0.85 or more."""
    found = shingle_join.jaccard_components(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op6_minimum_bin_slack_packing")
def op6_minimum_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 1024 tokens."""
    packed = packing.pack_texts(read_table(spark, folder, "documents"),
                                public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                         "sequence_id", "offset")


@query("op9_rans_token_files")
def op9_rans_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they read back from coded token files."""
    files = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    rans.write_token_files(read_table(spark, folder, "documents"), files,
                           public_tokenizers.path("word_bpe_49k.json"), end=1)
    return rans.read_token_files(spark, files, keep_tokens=False).withColumnRenamed("id", "doc_id")


@query("op4_ngram_quality")
def op4_ngram_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, folder, "documents")
    model = quality_model.fit_quality(docs, read_table(spark, folder, "labels"))
    scored = quality_model.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_html_text")
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(read_table(spark, folder, "pages"))


FILE_PAGES = 512  # pages per WARC file
DAMAGE = {"changed": "00", "missing": "01"}  # first hex digits of a page number's MD5

OP1_SQL = f"""
WITH record AS (
  SELECT page_id, page_id // {FILE_PAGES} AS file,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
           || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
           || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS length
  FROM pages),
placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
  FROM record)
SELECT page_id, file, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
       CASE substr(md5(CAST(page_id AS VARCHAR)), 1, 2) WHEN '00' THEN 'changed' ELSE 'missing' END AS kind
FROM placed WHERE substr(md5(CAST(page_id AS VARCHAR)), 1, 2) IN ('00', '01')
"""


@query("op1_merkle_fixity", OP1_SQL)
def op1_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records against a replica in which known records are changed or missing."""
    pages = read_table(spark, folder, "pages")
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    file = F.floor(F.col("page_id") / FILE_PAGES)
    damaged = F.when((mark == DAMAGE["changed"]) & (F.length("html") > 0),
                     F.overlay("html", F.lit("?"), F.lit(1), F.lit(1))).otherwise(F.col("html"))
    original = stored(fixity.lay_out(pages, file, ["page_id"], fixity.warc_record(F.col("url"), F.col("html"))))
    replica = stored(fixity.lay_out(pages, file, ["page_id"], fixity.warc_record(F.col("url"), damaged))
                     .filter(F.substring(F.md5(F.col("_o0").cast("string")), 1, 2) != DAMAGE["missing"]))
    found = fixity.audit(original, replica)
    return found.join(original.select(F.col("_o0").alias("page_id"), "file", "offset"), ["file", "offset"]).select(
        "page_id", "file", "offset", "length", "kind")


@query("op8_sampled_pieces")
def op8_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One sampled segmentation of every document, with the outcome of decoding it."""
    sampled = piece_sampling.sample_segmentations(
        read_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return sampled.withColumnRenamed("id", "doc_id")


@query("op5_block_max_search")
def op5_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best documents for every document whose id is divisible by 20."""
    found = bm25_search.top_k(read_table(spark, folder, "documents"), F.col("doc_id") % 20 == 0, "doc_id")
    return found.select(F.col("query").alias("query_doc_id"), "rank", F.col("key").alias("doc_id"),
                        F.round("score", 9).alias("score"))


@query("op5_turn_search")
def op5_turn_search(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best turns of all conversations for every turn of the conversations divisible by 20."""
    turns = read_table(spark, folder, "conversations")
    turns = turns.withColumn("key", F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 20, "0"),
                                                F.lpad(F.col("turn").cast("string"), 20, "0")))  # no number is longer
    found = bm25_search.top_k(turns, F.col("conv_id") % 20 == 0, "key")

    def part(name: str, i: int):
        return F.split(name, ":")[i].cast("long")

    return found.select(part("query", 0).alias("query_conv_id"), part("query", 1).alias("query_turn"), "rank",
                        part("key", 0).alias("conv_id"), part("key", 1).alias("turn"), F.round("score", 9).alias("score"))


@query("op11_source_mix", source_mix.mix_sql())
def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix of all sources takes from every document."""
    mix = source_mix.mix_sources(read_table(spark, folder, "documents"))
    return mix.taken().withColumnRenamed("key", "doc_id")


@query("op12_vector_codes", vector_codes.codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes and errors of all vectors."""
    codes = vector_codes.encode_vectors(read_table(spark, folder, "embeddings"))
    return codes.with_label_error().select(F.col("key").alias("vec_id"), "code", "error", "label_error",
                                           F.lit(codes.digest()).alias("codebooks_sha256"))


@query("op13_tree_search", tree_search.search_sql())
def op13_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return tree_search.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
