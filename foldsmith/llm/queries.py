"""The registered queries of the operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm import sql
from foldsmith.llm.classifier import quality_scores
from foldsmith.llm.common import load
from foldsmith.llm.conversation_repair import damage, digests, repair_conversations
from foldsmith.llm.decontaminate import contamination
from foldsmith.llm.mixing import mixture
from foldsmith.llm.periodic_runs import periodic_runs, repeat_words, strongest
from foldsmith.llm.pseudonyms import pseudonymize
from foldsmith.llm.quality_rules import quality_verdicts
from foldsmith.llm.simhash import near_duplicates
from foldsmith.llm.suffix_dedup import remove_repeats
from foldsmith.llm.token_counts import count_tokens
from foldsmith.llm.token_files import token_digests
from foldsmith.llm.url_filter import judge_urls
from foldsmith.llm.warc import archive_pages

RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS r(host, path, verdict)"
KEY = b"pseudonym key of the registered query"


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {RULES}"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(load(spark, sf_dir, "documents"), KEY)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(load(spark, sf_dir, "documents"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(load(spark, sf_dir, "documents"))


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(load(spark, sf_dir, "pages"))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def suffix_digests(documents: DataFrame) -> DataFrame:
    """Per document its bytes, the removed ones, their runs, and a digest of the rest."""
    found = remove_repeats(documents)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["n_bytes"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(load(spark, sf_dir, "documents"))


def run_digests(documents: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of the runs and of the text without repeats."""
    found = periodic_runs(documents).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def periodic_run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(repeat_words(load(spark, sf_dir, "documents")))


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damage, repair, and a row per original conversation; one that has lost all its rows has zeros and empty results."""
    found = repair_conversations(damage(conversations))
    texts = digests(found.rows).withColumnRenamed("conv_id", "_text_of")
    report = found.report.withColumnRenamed("conv_id", "_found")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (conversations.select("conv_id").distinct().join(report.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_found")), "left")
            .join(texts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_text_of")), "left")
            .select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(load(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter,
    "op2_decontamination": decontamination,
    "op3_pii_pseudonyms": pii_pseudonyms,
    "op4_token_counts": token_counts,
    "op5_simhash": simhash,
    "op6_quality_rules": quality_rules,
    "op7_source_mixing": source_mixing,
    "op8_token_output": token_output,
    "op9_warc_bundles": warc_bundles,
    "op10_quality_classifier": quality_classifier,
    "op11_suffix_dedup": suffix_dedup,
    "op12_periodic_runs": periodic_run_digests,
    "op13_conversation_repair": conversation_repair,
}
ORACLES = {"op1_url_filter": sql.URL_FILTER, "op6_quality_rules": sql.QUALITY_RULES, "op7_source_mixing": sql.MIXTURE,
           "op9_warc_bundles": sql.WARC}
