"""The words of a text and counts over them, shared by several operators."""

from __future__ import annotations

import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def covered_words(words: list[str], width: int) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    marked = bytearray(len(words))
    mark = b"\x01" * width
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked[i : i + width] = mark
    return sum(marked)


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines), len(lines) - len(set(lines))
