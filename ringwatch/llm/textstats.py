"""Counts over words and lines of a text that the quality operators share."""

from __future__ import annotations

import re

import numpy as np

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
_ROLL = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)
_END = re.compile(r"[.!?:;…。]['\")\]]*$")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the list, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: k for k, w in enumerate(set(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll += mixed[k : k + n] * _ROLL[k]
    order = np.sort(roll)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # equal windows have equal sums; the windows behind equal sums are compared as a whole
    at = np.flatnonzero(np.isin(roll, twice))
    data, size = ids.tobytes(), 8 * window
    keys = [data[8 * p : 8 * p + size] for p in at.tolist()]
    seen: dict[bytes, int] = {}
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    at = at[np.fromiter((seen[k] > 1 for k in keys), bool, len(keys))]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, lines equal to an earlier line, words in repeated windows)."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words)


#: What line_measures gives for a line with a word.
LINE_MEASURES = ("words", "symbols", "upper", "unique", "length", "marks", "digits", "end", "again")


def line_measures(text: str) -> list[tuple[float, ...]]:
    """For each line of the text that holds a word: words; symbols, words in capitals, distinct words, letters,
    exclamation marks and words with a digit, all per word; whether it ends like a sentence and repeats an earlier line."""
    out = []
    seen: set[str] = set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        symbols = sum(map(line.count, SYMBOLS))
        upper = sum(map(str.isupper, words))
        distinct = len(set(words))
        again = line in seen
        seen.add(line)
        digits = 0 if line.isalpha() else sum(1 for w in words if w[0].isdigit())
        out.append((n, symbols / n, upper / n, distinct / n, len(line) / n, line.count("!") / n, digits / n, float(bool(_END.search(line[-8:]))), float(again)))
    return out
