"""The queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ann, bpe, infill, jaccard, langid, maxent, mips, mixing, suffixes, toxicity, turns, urls, wordpiece
from riskloom.llm.common import table

BPE_FILE, PIECE_FILE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(BPE_FILE)), public_tokenizers.PATTERN)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = langid.held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text", held_out), model).drop("text")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out")), profiles).drop("text")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, wordpiece.read_pieces(public_tokenizers.path(PIECE_FILE))).drop("text")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_inner_products(table(spark, sf_dir, "embeddings"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), result=("kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest()))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


_OPERATORS = (
    op1_byte_bpe, op2_url_filter, op3_toxicity, op4_nearest, op5_language, op6_language_model, op7_token_counts, op8_mix,
    op9_inner_products, op10_jaccard, op11_conversation_repair, op12_fill_in_middle, op13_suffix_dedup,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op12_fill_in_middle": infill.ORACLE, "op13_suffix_dedup": suffixes.ORACLE} | {"op2_url_filter": urls.ORACLE, "op8_mix": mixing.ORACLE, "op9_inner_products": mips.ORACLE, "op10_jaccard": jaccard.ORACLE}
