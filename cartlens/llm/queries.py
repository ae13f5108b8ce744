"""The registered queries: thin wrappers that apply one operator to its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    embedding_join,
    html_text,
    language_id,
    line_dedup,
    packing,
    repeat_index,
    sharding,
    simhash,
    spelling,
    token_shards,
    topk,
    whitening,
)
from .common import table


def tokenizer(name: str) -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, name = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", *[F.col(name)[c].alias(c) for c in (
        "n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned, name = line_dedup.dedup(docs)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return cleaned.select("doc_id", F.col(name)["n_lines"].alias("n_lines"),
                          F.col(name)["n_removed"].alias("n_removed"),
                          F.sha2(text, 256).alias("kept_sha256"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence, read back from the shard files."""
    import public_tokenizers

    path = token_shards.materialise(table(spark, sf_dir, "documents"),
                                    tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_shards.read_slots(spark, path).select(
        "slot", "sequence_id", "shard", "byte_offset", "n_tokens",
        F.crc32("ids").alias("ids_crc32"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"),
                        with_ids=False)


def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.assign(table(spark, sf_dir, "documents"))
            .withColumn("law", F.lit("bytes"))
            .withColumn("grown_shard", F.lit(None).cast("int"))
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judge = language_id.fit(docs)
    marked, name = language_id.identify(docs.select("doc_id", "text"), judge)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % language_id.FOLDS
    c = F.col(name)
    return marked.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
                         c["lang_pred"].alias("lang_pred"), c["score"].alias("score"),
                         c["rejected"].alias("rejected"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, name = repeat_index.remove(docs)
    c = F.col(name)
    return marked.select("doc_id", c["n_bytes"].alias("n_bytes"),
                         c["n_removed"].alias("n_removed"),
                         F.size(c["spans"]).cast("long").alias("n_spans"),
                         F.sha2(c["kept"], 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where a table is so large that it needs more."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_line_dedup, op3_training_order, op4_curve_packing, op5_lpt_sharding,
    op6_embedding_near_dedup, op7_language_id, op8_simhash, op9_html_extraction,
    op10_repeat_removal, op11_spelling_variants, op12_whitening, op13_exact_topk)}
