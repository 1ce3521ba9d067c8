"""Training-corpus pipeline: documents through quality rules, near-dedup, decontamination, mixing and token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldsmith.llm.common import load, write_table
from foldsmith.llm.decontaminate import drop_contaminated
from foldsmith.llm.mixing import mix_documents
from foldsmith.llm.quality_rules import keep_good
from foldsmith.llm.simhash import keep_one
from foldsmith.llm.token_files import token_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the thresholds of their language and source reject.

    Null and empty texts go; null languages and sources are groups of their own; repeated rows stay or go together.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: three-word shingles, at most two differing bits.

    Of repeated ids with other texts each component keeps one row; rows without doc_id stay.
    """
    return keep_one(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item within the error budget; null and empty texts contain none."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or, in sources below their target weight, more often; a null source is one of its own."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, read back: doc_id, start, n_tokens, ids_crc32, a row for each row that was mixed.

    Rows without doc_id come first; null and empty texts are the end id alone.
    """
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
          ("mixing to target weights", mix), ("token output", tokens)]

# tokenizing and edit distance have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
