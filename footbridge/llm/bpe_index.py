"""BPE encoding and decoding with a pair occurrence index.

A partition's texts are cut at white space; pieces seen before are looked up. The words of all new pieces of a batch are
laid end to end as one chain of symbols, and an index maps every pair that has a merge rank to all its positions in the
chain. Active ranks are taken in ascending order from a heap: one step merges all positions of a pair at once, left to
right, and adds the new neighbours to the lists of their pairs. Stale positions are seen when their turn comes, as the
symbols there have changed. No merge makes a pair of lower rank than its own (checked when the vocabulary is loaded), so
one ascending sweep gives each word what merging it alone would give.

Defined results: a null text encodes as the empty text, to no ids, which decode to the empty text. Strings of special
tokens in a text become their ids. Characters without a symbol are dropped. Whole texts of any length are encoded;
repeated rows each. Unknown ids are left out when decoding. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import pruned

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[^{SPACE}]+")
_CONTROL = re.compile("[\x1c-\x1f]")  # separators to Python's split(), text to the tokenizer
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
CACHED = 200_000  # pieces each of the two generations of the cache holds
SLICE = 1_000_000  # bytes of text encoded at once, at least one text


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        signs = byte_symbols()
        self.inner, self.last = [ids.get(s) for s in signs], [ids.get(s + end) for s in signs]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        made_at = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
            made_at[ids[a + b]] = rank
        if any(made_at.get(x, -1) >= rank for pair, (rank, _) in self.merges.items() for x in pair):
            raise ValueError("a merge uses a symbol that only a later merge makes")
        self.listed = pa.array([self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)], pa.string())
        # two generations of pieces and their ids, as 32-bit integers end to end
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, piece: str) -> list[str | int]:
        """Words of a piece without white space; special tokens as their ids."""
        if self._special and "<|" in piece and self._special.search(piece):
            return [w for part in self._special.split(piece) for w in ([self.special[part]] if part in self.special else self.words(part))]
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return _WORDS.findall(piece.lower())

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        symbol: list[int] = []
        starts = [0]
        for word in words:
            data = word.encode()
            symbol += [s for s in (*(self.inner[b] for b in data[:-1]), self.last[data[-1]]) if s is not None]
            starts.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            if s < n:
                before[s] = -1
            if s:
                after[s - 1] = -1
        # every pair's places, words' borders among them: those have no neighbour and are passed over
        everywhere: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(symbol, symbol[1:], strict=False)):
            if pair in everywhere:
                everywhere[pair].append(i)
            else:
                everywhere[pair] = [i]
        merges = self.merges
        index = {pair: places for pair, places in everywhere.items() if pair in merges}
        pair_of = {merges[pair][0]: pair for pair in index}
        active = list(pair_of)
        heapq.heapify(active)
        while active:
            pair = pair_of.pop(heapq.heappop(active))
            a, b = pair
            new = merges[pair][1]
            places = index.pop(pair)
            for i in sorted(places) if a == b else places:
                j = after[i]
                if j < 0 or symbol[i] != a or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -1
                after[i] = k = after[j]
                p = before[i]
                if k >= 0:
                    before[k] = i
                for at, left, right in ((i, i, k), (p, p, i)):
                    if left < 0 or right < 0:
                        continue
                    made = symbol[left], symbol[right]
                    if made in index:
                        index[made].append(at)
                    elif made in merges:
                        index[made] = [at]
                        rank = merges[made][0]
                        pair_of[rank] = made
                        heapq.heappush(active, rank)
        return [array("i", [s for s in symbol[a:b] if s >= 0]).tobytes() for a, b in zip(starts, starts[1:], strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the younger cache; those in neither generation are merged together."""
        young, old = self.young, self.old
        new = [p for p in pieces if p not in old]
        young.update((p, old[p]) for p in pieces if p in old)
        parts = [self.words(p) for p in new]
        distinct = {w for part in parts for w in part if isinstance(w, str)}
        # a word of small ASCII letters is what the piece of the same letters holds
        ids = {w: young.get(w) or old.get(w) for w in distinct if w.isascii() and w.isalpha()}
        ids = {w: known for w, known in ids.items() if known is not None}
        lacking = [w for w in distinct if w not in ids]
        ids.update(zip(lacking, self.merged(lacking), strict=True))
        for piece, part in zip(new, parts, strict=True):
            young[piece] = b"".join([array("i", [w]).tobytes() if isinstance(w, int) else ids[w] for w in part])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers end to end."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        known = self.young
        cut = [(_SPLIT.findall(t) if _CONTROL.search(t) else t.split()) if t else [] for t in texts]
        ids = [list(map(known.get, pieces)) for pieces in cut]
        lacking = [i for i, found in enumerate(ids) if None in found]
        self.learn({p for i in lacking for p, k in zip(cut[i], ids[i], strict=True) if k is None})
        for i in lacking:
            ids[i] = [known[p] if k is None else k for p, k in zip(cut[i], ids[i], strict=True)]
        return [b"".join(found) for found in ids]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        flat = ids.flatten()
        if len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(self.listed)):
            return pa.array([" ".join([self.tokens[i] for i in x or () if i in self.tokens]) for x in ids.to_pylist()], pa.string())
        starts = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(ids), 0)).cast(pa.int32())])
        return pc.binary_join(pa.ListArray.from_arrays(starts, self.listed.take(flat)), " ")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def slices(lengths: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to ``most`` at most, of at least one row."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def lists(ids: list[bytes]) -> pa.ListArray:
    starts = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def encode(docs: DataFrame, path: str, and_back: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every document; ``and_back`` adds decoded, the text that the ids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(lengths):
                ids = lists(vocab.encode(batch.column(1).slice(a, b - a).to_pylist()))
                columns = {"doc_id": batch.column(0).slice(a, b - a), "ids": ids} | ({"decoded": vocab.decode(ids)} if and_back else {})
                yield pa.RecordBatch.from_pydict(columns)

    slim = pruned(docs, "doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * and_back)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of every row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for a, b in slices([8 * (n or 0) for n in batch.column(1).value_lengths().to_pylist()]):
                ids = batch.column(1).slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "ids": ids, "decoded": vocab.decode(ids)})

    slim = pruned(encoded, "doc_id", "ids")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text that they decode to."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, path, and_back=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
