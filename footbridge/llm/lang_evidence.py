"""Language of web pages by Bayesian fusion of evidence.

The text likelihood comes from hashed character trigrams, counted per language over a bounded sample of labelled
documents. Each page's text votes once by itself; grouped counts of these votes give how often a declared markup
language or an address suffix goes with a language, and how languages are spread over each host. Host priors are smoothed
towards their registered domain, and domains towards all pages, each as if it had ``WEIGHT`` more votes spread like the
level above. A page's log posterior is the host prior, plus the text likelihood tempered for the dependence of
neighbouring trigrams, plus the likelihoods of its declaration and suffix.

Defined results: a null or empty page has no text evidence; a null url has the empty host. Without any labelled document
no page gets a language. Ties go to the smaller code. Repeated rows vote and are judged each. Empty tables give empty
results. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import pruned
from footbridge.llm.url_trust import domain_of, host_of
from footbridge.session import cut

BUCKETS = 1 << 15
SAMPLE = 2000  # documents of each language that the text model is fitted on, about
WEIGHT = 5.0
TEMPER = 60.0  # trigrams that many neighbours are worth in the long run
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def visible(page: str | None) -> str:
    return html.unescape(_HIDDEN.sub(" ", page)) if page else ""


def trigrams(text: str) -> np.ndarray:
    """The bucket of each character trigram of a text in lower case with single spaces."""
    u = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = u[:-2] * np.uint64(0x9E3779B1) + u[1:-1] * np.uint64(0x85EBCA6B) + u[2:] * np.uint64(0xC2B2AE35)
    return ((h ^ (h >> np.uint64(17))) % np.uint64(BUCKETS)).astype(np.int64)


def text_model(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket) from about ``sample`` labelled documents a language: those of
    the least hashes, by a limit that its size sets, so that no language is gathered in one task."""
    docs = pruned(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = docs.join(cut(sizes), "lang").where(place * F.col("size") < F.lit(sample << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    langs = sorted(rows["lang"].unique())
    n = np.ones((len(langs), BUCKETS))
    n[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
    return langs, np.log(n / n.sum(axis=1, keepdims=True))


def text_evidence(text: str, model: np.ndarray) -> np.ndarray:
    """Tempered log likelihood of each language."""
    at = trigrams(text)
    n = len(at)
    return model[:, at].sum(axis=1) / (1 + n / TEMPER) if n > 1 else np.zeros(len(model))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def best_of(langs: list[str], logs: Column) -> Column:
    """The language of the greatest entry, the first of equals."""
    return F.get(F.array(*map(F.lit, langs)), F.array_position(logs, F.array_max(logs)).cast("int") - 1)


def votes(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, suffix, declared, text (log likelihoods) and text_lang, the text's own vote, null without text."""

    @F.pandas_udf("array<double>")
    def evidence(pages: pd.Series) -> pd.Series:
        return pd.Series([text_evidence(visible(p), model) for p in pages])

    declared = F.lower(F.nullif(F.regexp_extract("html", DECLARED, 1), F.lit("")))
    host = host_of(F.col("url"))
    read = pruned(pages, "page_id", "url", "html").select("page_id", host.alias("host"), suffix_of(host).alias("suffix"), declared.alias("declared"), evidence("html").alias("text"))
    told = F.array_max("text") > F.array_min("text")
    return read.withColumn("text_lang", F.when(told, best_of(langs, F.col("text"))))


def counts(voted: DataFrame, langs: list[str], *keys: str) -> DataFrame:
    """Votes for each language, as an array ``n``, of each group."""
    each = F.array(*[F.sum((F.col("text_lang") == x).cast("double")) for x in langs])
    return voted.where("text_lang is not null").groupBy(*keys).agg(each.alias("n"))


def smoothed(own: Column, above: Column) -> Column:
    """Shares of ``own`` counts with ``WEIGHT`` more votes spread like ``above``."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda n, p: (n + WEIGHT * p) / (total + WEIGHT))


def likelihoods(voted: DataFrame, langs: list[str], key: str) -> DataFrame:
    """(key, seen): log P(value of ``key`` | language) with one pseudo-vote spread over all values."""
    n = cut(counts(voted.where(F.col(key).isNotNull()), langs, key))
    every = n.select(F.count(F.lit(1)).alias("values"), *[F.sum(F.get("n", F.lit(i))).alias(f"s{i}") for i in range(len(langs))]).first()
    sums = [every[f"s{i}"] or 0.0 for i in range(len(langs))]
    share = [F.log((F.get("n", F.lit(i)) + 1.0 / max(1, every["values"])) / (sums[i] + 1.0)) for i in range(len(langs))]
    return cut(n.select(key, F.array(*share).alias(f"{key}_seen")))


def fuse(voted: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, lang, confidence, text_lang and declared of every page of ``votes``."""
    host_n = cut(counts(voted, langs, "host"))
    domain = domain_of(F.col("host"))
    add = F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(len(langs))])
    domain_n = host_n.groupBy(domain.alias("domain")).agg(add.alias("domain_n"))
    total = domain_n.select(*[F.sum(F.get("domain_n", F.lit(i))).alias(f"s{i}") for i in range(len(langs))]).first()
    sums = [total[f"s{i}"] or 0.0 for i in range(len(langs))]
    overall = F.array(*[F.lit((s + 1.0) / (sum(sums) + len(langs))) for s in sums])
    hosts = host_n.withColumn("domain", domain).join(domain_n, "domain")
    prior = F.transform(smoothed(F.col("n"), smoothed(F.col("domain_n"), overall)), lambda p: F.log(p))
    hosts = cut(hosts.select("host", prior.alias("prior")))
    joined = voted.join(hosts, "host", "left").join(likelihoods(voted, langs, "declared"), "declared", "left").join(likelihoods(voted, langs, "suffix"), "suffix", "left")
    nothing = F.array(*[F.lit(0.0)] * len(langs))
    add2 = lambda a, b: F.zip_with(a, F.coalesce(b, nothing), lambda x, y: x + y)
    logs = F.coalesce("prior", F.transform(overall, lambda p: F.log(p)))
    for part in ("text", "declared_seen", "suffix_seen"):
        logs = add2(logs, F.col(part))
    out = joined.select("page_id", logs.alias("logs"), "text_lang", "declared")
    top = F.array_max("logs")
    share = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return out.select("page_id", best_of(langs, F.col("logs")).alias("lang"), share.alias("confidence"), "text_lang", "declared")


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, confidence, text_lang and declared of every page, after training on ``docs`` (doc_id, text, lang)."""
    langs, model = text_model(docs, sample)
    if not langs:
        return pages.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"))])
    return fuse(cut(votes(pages, langs, model)), langs)
