"""From raw documents to packed training sequences.

Five stages, each one operator of ``cartlens.llm``. A stage takes the session,
the documents its predecessor kept, and the folder of the other tables; all but
the last return documents with the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import decontaminate, language_id, line_dedup, packing, simhash
from cartlens.llm.common import stored, table
from cartlens.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go; a null ``lang`` is filled in.

    Null texts and texts without a letter, empty ones among them, are rejected; a text
    of any length is scored whole. Languages of equal cross-entropy: the first by name.
    Repeated rows are judged alike, each on its own. An empty table stays empty.
    """
    marked, name = language_id.identify(docs, language_id.fit(docs))
    kept = marked.where(~F.col(name)["rejected"])
    return kept.withColumn("lang", F.coalesce("lang", F.col(name)["lang_pred"])).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or close to an earlier one go; documents stay, ``n_chars`` follows
    where lines went (also if it was null), and may be missing.

    Null texts stay null; a text that loses all lines is empty. Documents go in the
    order of their ids, or as stored if ids repeat or are null, so of repeated rows
    the first keeps its lines. Texts and lines may have any length. An empty table
    stays empty.
    """
    cleaned, name = line_dedup.dedup(docs)
    if "n_chars" not in docs.columns:
        return cleaned.select(*docs.columns)
    changed = F.col(name)["n_removed"] > 0
    chars = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars"))
    kind = dict(docs.dtypes)["n_chars"]
    return cleaned.withColumn("n_chars", chars.cast(kind)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest
    id (null last; of repeated rows the first stored).

    Null and empty texts have fingerprint zero and are one group, linked like any
    other. Texts of any length are read whole. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go: at least one word in twenty
    lies in a window of an item.

    Null and empty texts have no words and stay. Repeated rows are judged one by one.
    Texts of any length are read whole. Null items and a benchmark without rows hit
    nothing. An empty table stays empty.
    """
    marked, name = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col(name)["contaminated"]).drop(name)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids.

    Null and empty texts are the end token alone; null ids and repeated rows are
    documents like any other, and equal keys are ordered by id, then by row. Texts
    longer than a sequence are cut. An empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language models nor the tokenizer; the tests hold
#: the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
