"""One registered query an operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footbridge.llm import bpe_index, cover_tree, gru_lm, infill, lang_evidence, markov_secrets, mixing, quality_rules, rff_quality, simhash_bk, simple8b, talk_repair, url_trust
from footbridge.llm.registry import query, table
from footbridge.llm.sql import INFILL, MIXING, QUALITY_RULES, RULES, TALK_REPAIR, TOP_K, URL_TRUST


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is on this machine; the same on all of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules", QUALITY_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


@query("op6_mixing", MIXING)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.epochs(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


@query("op8_secret_scans")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = markov_secrets.scan(docs, markov_secrets.train(markov_secrets.samples(docs)))
    n = [markov_secrets.count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(markov_secrets.PATTERNS)]
    base = F.sha2(markov_secrets.listed(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *n, base, markov_secrets.listed(F.col("found")).alias("spans"))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_index.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_bk.group_documents(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_token_ids")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = simple8b.write_and_read(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_top_k", TOP_K)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cover_tree.whole_vector(F.col("embedding")).alias("vec"))
    return cover_tree.top_k(rows, F.col("vec_id") % 50 == 0, 5)


@query("op4_url_filters", URL_TRUST)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_evidence.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_infill", INFILL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transform(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op12_talk_repair", TALK_REPAIR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk_repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_lm_scores")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))
