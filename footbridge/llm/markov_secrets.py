"""Secret scans: pattern spans, and spans that a pair of character Markov models finds, with DataFrame functions only.

One model is trained on random strings, one on ordinary identifiers, from labelled samples: transition counts of
character classes, summed by Spark, smoothed, and compared as a log-likelihood ratio per transition in whole millionths.
A candidate is a run of name characters that no pattern span overlaps. Its score is the sum of the ratios over its
transitions; it is a secret if the sum exceeds a limit. The model has at most ``len(ALPHABET) + 1`` squared entries; it
is the only thing that comes to the driver.

Places are code points, ends exclusive. They come from the lengths of what lies between matches.

Defined results: a null text counts as empty and has no spans. Repeated rows are scanned each. Empty tables give empty
results; without samples of a label its model is uniform. Further columns are kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import fresh, pruned

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
ASSIGN = rf"({ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# maximal runs: shorter ones never start or end a longer match, so the least length can stand in the pattern
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
KINDS = [*PATTERNS, "markov"]
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
LIMIT = 12_000_000  # a likelihood ratio of exp(12), in millionths
SAMPLES = 20_000  # strings of each label that training reads at most, on average
SPAN = "struct<start:int,end:int,kind:int,match:string>"


def spans(text: Column, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Array of (start, end, kind, match) of leftmost non-overlapping matches; ``least`` filters the raw matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.lit(0)

    def step(acc: Column, pair: Column) -> Column:
        at = acc["end"] + F.length(pair["gap"])
        stop = at + F.length(pair["match"])
        one = F.struct(at.alias("start"), stop.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("match"))
        return F.struct(stop.alias("end"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    zero = F.struct(start.cast("int").alias("end"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("match"))
    return F.when(F.size(found) > 0, F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), zero, step)["spans"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """The spans of all patterns, by start and then kind."""
    value = lambda s: F.regexp_extract(s["match"], PATTERNS["assign"], 2)
    by_kind = [spans(text, p, i) for i, p in enumerate(PATTERNS.values())]
    by_kind[0] = F.filter(by_kind[0], lambda s: F.length(value(s)) >= 8)
    return F.concat(*by_kind)


def train(samples: DataFrame) -> list[int]:
    """Ratios of (sample string, label boolean: random): log P(next | random) - log P(next | ordinary), in millionths,
    by place of the character and place of the next."""
    at = F.explode(F.sequence(F.lit(1), F.length("sample") - 1)).alias("at")
    pairs = samples.where(F.length("sample") > 1).select("label", "sample", at)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring("sample", i, 1))
    placed = pairs.select("label", place(F.col("at")).alias("a"), place(F.col("at") + 1).alias("b"))
    counts = {(r.label, r.a - 1, r.b - 1): r.n for r in placed.where("a > 0 and b > 0").groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = {(label, a): sum(counts.get((label, a, b), 0) for b in range(SIZE)) for label in (True, False) for a in range(SIZE)}
    log = lambda label, a, b: math.log((counts.get((label, a, b), 0) + 1) / (sums[label, a] + SIZE))
    return [round(1e6 * (log(True, a, b) - log(False, a, b))) for a in range(SIZE) for b in range(SIZE)]


def score(sample: Column, ratios: list[int]) -> Column:
    """Sum of the ratios over all transitions of a string of ``ALPHABET`` characters."""
    table = F.array(*map(F.lit, ratios))
    places = F.transform(F.split(sample, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def step(acc: Column, place: Column) -> Column:
        ratio = F.when(acc["last"] >= 0, F.get(table, acc["last"] * SIZE + place)).otherwise(F.lit(0))
        return F.struct(place.alias("last"), (acc["sum"] + ratio).alias("sum"))

    return F.aggregate(F.filter(places, lambda p: p >= 0), F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum")), step)["sum"]


def all_spans(text: Column, base: Column, ratios: list[int], limit: int = LIMIT) -> Column:
    """``base`` and the candidates that score above ``limit`` and overlap none of it."""
    clear = lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    more = F.filter(spans(text, CANDIDATE, len(PATTERNS)), lambda s: clear(s) & (score(s["match"], ratios) > limit))
    return F.concat(base, more)


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def count_kind(found: Column, kind: int) -> Column:
    """How many spans are of one kind. The condition takes the span alone: a second argument would be its place."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def samples(docs: DataFrame, per_label: int = SAMPLES) -> DataFrame:
    """Labelled samples (sample, label) from the documents themselves.

    Random: values of pattern spans, the same in capitals, and seeded hashes as hex, capital hex and base 64. Ordinary: the documents' words of ten
    letters or more, digits and joined words among them. Each document gives at most twenty words. Documents come from a
    hash range that holds about ``per_label`` of them."""
    text = pruned(docs, "doc_id", "text").where("text is not null")
    part = text.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, text.count() * 2 // per_label))) == 0)
    text = F.col("text")
    value = F.regexp_replace(F.regexp_extract(text, f"{ASSIGN}|({PATTERNS['hex']})|({PATTERNS['access']})", 0), f"^({ANY_CASE})[\"']?\\x20*[:=]\\x20*[\"']?", "")
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    seeded = [F.substring(x, 1, 40) for x in (digest, F.upper(digest), F.base64(F.unhex(digest)))]
    random = part.select(F.explode(F.array(value, F.upper(value), *seeded)).alias("sample")).where(F.length("sample") >= 16)
    words = F.slice(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_/-]{9,}"), F.lit(0)), 1, 20)
    words = F.filter(words, lambda w: ~w.rlike(f"{PATTERNS['hex']}|{PATTERNS['access']}"))
    plain = part.select(F.explode(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w))))).alias("sample"))
    numbers = part.select(F.explode(F.slice(F.regexp_extract_all(text, F.lit("[0-9-]{5,}"), F.lit(0)), 1, 20)).alias("sample"))
    return random.select("sample", F.lit(True).alias("label")).unionByName(plain.unionByName(numbers).select("sample", F.lit(False).alias("label")))


def scan(docs: DataFrame, ratios: list[int], limit: int = LIMIT) -> DataFrame:
    """doc_id, base and found (arrays of spans) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = pruned(docs, "doc_id", "text").select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return based.select("doc_id", "base", all_spans(F.col("text"), F.col("base"), ratios, limit).alias("found"))


def redact(docs: DataFrame, ratios: list[int], limit: int = LIMIT, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; overlapping spans become one. Where there is
    n_chars, it follows the text."""
    base, found = fresh(docs, "base", "found")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(base, base_spans(text)).withColumn(found, all_spans(text, F.col(base), ratios, limit))
    order = F.array_sort(F.transform(F.col(found), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = F.when(F.size(found) > 0, done).otherwise(F.col("text"))
    marked = marked.withColumn("text", clean)
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns])
