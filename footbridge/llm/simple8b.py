"""Token-id files in Simple-8b: 64-bit words of a 4-bit selector and 60 payload bits.

Selector s from 1 to 14 packs ``COUNTS[s]`` ids of ``WIDTHS[s]`` bits each, the first lowest. Selector 0 is the escape:
its payload is a number n, and the next n words are ids of over 60 bits in full. Selector 15 is never written and
refused. Packing is greedy: a word takes the selector of most ids that all fit. Ids are cut into blocks of ``BLOCK``; a
block starts a new word, and its last word may hold fewer ids than its selector says.

A file is a Parquet table of chunks, so that Spark writes and reads it anywhere and redoes lost parts. A row holds whole
documents: part and chunk (its place), doc_ids, lengths (ids of each document, end included), words (binary, little
endian) and offsets (first word of each block). Parts ascend by doc_id, chunks within parts, documents within chunks.
Any block can be decoded alone; all words of a chunk are decoded together, selector by selector.

Defined results: a null text is empty; every document ends with the end id, so an empty one has one token. Null doc_ids
come first. Rows of one doc_id stand in order of a hash of their text; equal rows are all written. Ids up to 2^64 - 1
can be packed. An empty table gives an empty file. Further columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footbridge.llm.bpe_index import byte_symbols
from footbridge.llm.columns import pruned
from footbridge.session import cut, scratch_dir

WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
ESCAPE, REFUSED = 0, 15
BLOCK = 4096
END = 0  # the id after each document
CHUNK = 1 << 16  # ids after which a chunk is closed
CACHED = 800_000  # pieces each of the two generations of the tokenizer's cache holds
LONG = 1 << 16  # characters of a text that the tokenizer gets at once, about
LINES = 2000  # new pieces that the tokenizer gets as one text
_GAP = re.compile(r"\s\s")
_SPACE = re.compile(r"\s")
_SIGNS = dict(enumerate(byte_symbols()))
_ENDS = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


_FIT = np.searchsorted(WIDTHS[1:15], np.arange(65)).astype(np.uint8)  # by bit length: how many widths are too narrow

_SMALL = _FIT[np.frexp(np.arange(1 << 16, dtype=np.float64))[1]]


def _narrower(ids: np.ndarray) -> np.ndarray:
    """For each id how many of the 14 widths are too narrow; 14 means that only an escape holds it."""
    if len(ids) and ids.max() < len(_SMALL):
        return _SMALL[ids]
    bits = np.frexp(ids.astype(np.float64))[1]  # exact below 2^53
    wide = bits > 52
    if wide.any():
        bits[wide] = [int(x).bit_length() for x in ids[wide]]
    return _FIT[bits]


def _starts(after: np.ndarray) -> np.ndarray:
    """The first id of each word, where a word from id i ends before id ``after[i]``."""
    n = len(after)
    hops = [np.append(after, np.int32(n))]  # of 1, 2, 4, ... words
    for _ in range(5):
        hops.append(hops[-1].take(hops[-1]))
    far, i, marks = hops[-1].tolist(), 0, []
    while i < n:
        marks.append(i)
        i = far[i]
    reached = np.array(marks, dtype=np.int32)
    for hop in hops[-2::-1]:
        reached = np.concatenate([reached, hop.take(reached)])
    seen = np.zeros(n + 1, dtype=bool)
    seen[reached] = True
    return np.flatnonzero(seen[:n])


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of an array of unsigned ids."""
    n = len(ids)
    ids, need = ids.astype(np.uint64), _narrower(ids)
    # where one selector fits all ids, those of fewer ids need no look
    widest = int(need.max()) + 1 if n and need.max() < 14 else 0
    # a row a block, with room behind it that fits every selector
    rows = -(-n // block)
    wide = np.zeros((rows, block + 64), dtype=np.uint8)
    blocks = np.zeros(rows * block, dtype=np.uint8)
    blocks[:n] = need
    wide[:, :block] = blocks.reshape(rows, block)
    peaks = {1: wide}  # of 1, 2, 4, ... ids side by side the greatest need
    for half in (1, 2, 4, 8, 16):
        peaks[2 * half] = np.maximum(peaks[half][:, :-half], peaks[half][:, half:])
    best = np.full((rows, block), widest, dtype=np.int8)
    for s in range(widest - 1 if widest else 14, 0, -1):  # selectors of more ids come later and win
        count = int(COUNTS[s])
        width = 1 << (count.bit_length() - 1)
        peak = np.maximum(peaks[width][:, :block], peaks[width][:, count - width : count - width + block])
        np.copyto(best, s, where=peak < s)
    best = best.ravel()[:n]
    place = np.arange(n, dtype=np.int32)
    end = np.minimum((place // block + 1) * block, n).astype(np.int32)
    after = np.minimum(place + np.maximum(COUNTS, 1).astype(np.int32).take(best), end)
    starts = _starts(after)
    sel = best[starts].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(64, dtype=np.uint64)])
    for s in np.unique(sel[sel > 0]):
        of = np.flatnonzero(sel == s)
        first, stop = starts[of], after[starts[of]]
        filled = words[of]
        for k in range(COUNTS[s]):
            filled |= padded[first + k] * (first + k < stop) << np.uint64(k * WIDTHS[s])
        words[of] = filled
    offsets = np.searchsorted(starts, np.arange(0, n, block))
    raw = sel == ESCAPE
    if raw.any():  # each run of escapes within a block: a head that counts it, then the ids in full
        words[raw] = ids[starts[raw]]
        opens = np.zeros(len(sel), dtype=bool)
        opens[offsets] = True
        heads = np.flatnonzero(raw & (opens | ~np.r_[False, raw[:-1]]))
        stops = np.flatnonzero(raw & np.r_[opens[1:] | ~raw[1:], True])
        words = np.insert(words, heads, (stops - heads + 1).astype(np.uint64))
        offsets = offsets + np.searchsorted(heads, offsets)
    return words, offsets.astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of words whose blocks begin at ``offsets``."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    full = np.zeros(len(words), dtype=bool)
    heads = np.flatnonzero(sel == ESCAPE)  # heads, or ids in full that look like one
    at = 0
    while (k := int(np.searchsorted(heads, at))) < len(heads):
        head = int(heads[k])
        at = head + 1 + int(words[head] & np.uint64((1 << 60) - 1))
        full[head + 1 : at] = True
    if ((sel == REFUSED) & ~full).any():
        raise ValueError("selector 15 in a file")
    count = np.where(full, 1, COUNTS[sel])
    # only a block's last word may be partly filled: blocks start where the format says, not where slots end
    of_block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    slots = np.r_[0, np.cumsum(count)[:-1]] if len(words) else np.zeros(0, dtype=np.int64)
    begin = slots - slots[offsets][of_block] + of_block * block if len(words) else slots
    count = np.minimum(count, np.minimum((of_block + 1) * block, n) - begin)
    word = np.repeat(np.arange(len(words), dtype=np.int32), count)
    width = np.where(full, 0, WIDTHS[sel]).astype(np.uint8)
    shift = (np.arange(n, dtype=np.int64) - begin[word]).astype(np.uint8) * width[word]
    mask = np.where(full, np.uint64(2**64 - 1), (np.uint64(1) << WIDTHS[sel].astype(np.uint64)) - np.uint64(1))
    return (words[word] >> shift.astype(np.uint64)) & mask[word]


class PieceEncoder:
    """A byte-level tokenizer with a cache of pieces.

    In a text without two adjacent white-space characters, tokens never cross the border before a space or around a line
    feed. Such a text is cut there, and pieces met before are looked up; new ones go to the tokenizer as lines of one
    text. All other texts, and pieces with signs of a special token or further white space, go to it as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task a core
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.line = self.plain.encode("\n", add_special_tokens=False).ids[0]
        self.feed = np.array([self.line], dtype="<u4").tobytes()
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # pieces at the start of a line, and after a space
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def ids(self, text: str) -> np.ndarray:
        (e,) = self.plain.encode_batch_fast([text], add_special_tokens=False)
        return np.array(e.ids, dtype="<u4")

    def whole(self, text: str) -> bytes:
        """A text of any kind, in stretches that end between a letter and a space before a letter."""
        cuts, at = [0], LONG
        while m := _ENDS.search(text, at):
            cuts.append(m.start())
            at = m.start() + LONG
        return b"".join(self.ids(text[a:b]).tobytes() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))

    def word(self, sign: str, word: str) -> bytes:
        """The ids of what the tokenizer takes for one word; ``sign`` stands for a space before it."""
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.plain.model.tokenize(sign + signs)]).tobytes()

    def learn(self, pieces: set[str], after_space: bool) -> None:
        """Put the ids of pieces that aren't in the younger cache there."""
        young, old, lead = self.young[after_space], self.old[after_space], " " if after_space else ""
        lines = []
        sign = "\u0120" if after_space else ""
        for piece in pieces:
            if piece in old:
                young[piece] = old[piece]
                continue
            core = piece.rstrip(",.;:!?#*$%&|()")
            if core.isalpha():  # letters only, with or without a space, are one word of the model, the signs after them another
                ids = young.get(core) or old.get(core) or self.word(sign, core)
                young[piece] = ids if core == piece else ids + self.word("", piece[len(core) :])
            elif not piece or "<|" in piece or _SPACE.search(piece):
                young[piece] = self.whole(lead + piece)
            else:
                lines.append(piece)
        for at in range(0, len(lines), LINES):
            some = lines[at : at + LINES]
            ids = self.ids("\n".join([lead + p for p in some]))
            ends = np.r_[np.flatnonzero(ids == self.line), len(ids)]
            data, a = ids.tobytes(), 0
            for piece, b in zip(some, ends.tolist(), strict=True):
                young[piece] = data[4 * a : 4 * b]
                a = b + 1

    def age(self) -> None:
        for young, old in zip(self.young, self.old, strict=True):
            if len(young) > CACHED:
                old.clear()
                old.update(young)
                young.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.age()
        on = gc.isenabled()
        gc.disable()  # the lists of pieces hold no cycles, and there are too many to walk
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        starts, rests = self.young
        lined, unknown = [], (set(), set())
        for t in texts:
            if not t or _GAP.search(t):
                lined.append(None)
                continue
            lines = [line.split(" ") for line in t.split("\n")]
            # of each line the pieces, and their ids as far as they are known
            lined.append([(pieces, [starts.get(pieces[0]), *map(rests.get, pieces[1:])]) for pieces in lines])
            for pieces, known in lined[-1]:
                if None in known:
                    if known[0] is None:
                        unknown[0].add(pieces[0])
                    unknown[1].update(p for p, k in zip(pieces[1:], known[1:], strict=True) if k is None)
        self.learn(unknown[0], False)
        self.learn(unknown[1], True)
        out = []
        for t, lines in zip(texts, lined, strict=True):
            if lines is None:
                out.append(self.whole(t) if t else b"")
                continue
            for pieces, known in lines:
                if None in known:
                    known[0] = starts[pieces[0]]
                    for i, k in enumerate(known):
                        if k is None:
                            known[i] = rests[pieces[i]]
            out.append(self.feed.join([b"".join(known) for _, known in lines]))
        return out


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """Loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


CHUNKS = "part int, chunk int, doc_ids array<{}>, lengths array<int>, n_ids long, words binary, offsets array<int>"


def write(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode all documents and write their ids in ascending order of doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = pruned(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([END], dtype="<u4").tobytes()
        part, chunk, held_ids, held, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            words, offsets = pack(ids)
            lengths = [len(x) // 4 for x in held]
            row = ([part], [chunk], pa.array([held_ids], pa.list_(id_type)), [lengths], [len(ids)], [words.astype("<u8").tobytes()], pa.array([offsets.tolist()], pa.list_(pa.int32())))
            kinds = [pa.int32(), pa.int32(), None, pa.list_(pa.int32()), pa.int64(), pa.binary(), None]
            arrays = [x if k is None else pa.array(x, k) for x, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "chunk", "doc_ids", "lengths", "n_ids", "words", "offsets"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                for i, data in zip(ids[a : a + 256], enc.encode(texts[a : a + 256]), strict=True):
                    held_ids.append(i)
                    held.append(data + end)
                    size += len(data) // 4 + 1
                    if size >= CHUNK:
                        yield close()
                        chunk, held_ids, held, size = chunk + 1, [], [], 0
        if held:
            yield close()

    ordered.mapInArrow(run, CHUNKS.format(kind)).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, little-endian unsigned 32-bit) from the files."""
    file = spark.read.parquet(path)
    sizes = file.groupBy("part", "chunk").agg(F.sum("n_ids").alias("n"))
    # sums by part first: only one row a part meets in one task
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    chunks = sizes.select("part", "chunk", before(Window.partitionBy("part").orderBy("chunk")).alias("ahead"))
    # written, so that Spark knows its true size and needn't shuffle the words to join it
    starts = cut(chunks.join(parts, "part").select("part", "chunk", (F.col("base") + F.col("ahead")).alias("start")))
    kind = file.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type
            for ids, lengths, n, words, offsets, start in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                data = unpack(np.frombuffer(words, dtype="<u8"), np.array(offsets, dtype=np.int64), n).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                each = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    whole = file.join(starts, ["part", "chunk"]).select("doc_ids", "lengths", "n_ids", "words", "offsets", "start")
    return whole.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """``write`` to ``path``, by default a new folder in the shared one, and ``read`` it back."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, path)
    return read(spark, path)
