"""A training corpus in five stages. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's documents. All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from footbridge.llm import bpe_index, markov_secrets, mixing, near_copies, quality_rules
from footbridge.llm.queries import tokenizer
from footbridge.llm.registry import query, table
from footbridge.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None  # fingerprints, trained models and merges are beyond SQL
BATCH = "4m"  # of texts that pass between the JVM and a Python worker at once; several workers share a machine's memory


def in_small_batches(stage: Stage) -> Stage:
    """A stage whose session sends texts in batches of ``BATCH``."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8 or more) the document of least doc_id stays:
    SimHash links confirmed on whole sets of shingles, then an exact join of what they leave apart."""
    return near_copies.keep_first(docs)


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows."""
    return markov_secrets.redact(docs, markov_secrets.train(markov_secrets.samples(docs)))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


@in_small_batches
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's ids, counted and hashed, and the hash of what they decode to."""
    return bpe_index.digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
