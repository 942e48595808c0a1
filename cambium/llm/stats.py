"""Statistics of whole texts, one pass of bytes operations for each text."""

from __future__ import annotations

from operator import eq

import numpy as np

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_END = b".!?"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character after its first


def count(b: bytes, these: bytes) -> int:
    return len(b) - len(b.translate(None, these))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    if len(number) < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, where, times = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    again = times[where.reshape(-1)] > 1
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def duplicate_lines(b: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    seen, again, n = set(), 0, 0
    for line in b.split(b"\n"):
        if line.strip(_SPACE):
            n += 1
            if line in seen:
                again += 1
            seen.add(line)
    return again, n


def rule_counts(b: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = b.split()
    chars = len(b) - count(b, _SPACE + _INNER)
    again, lines = duplicate_lines(b)
    return len(words), chars, count(b, _SYMBOLS), again, repeated_words(words), lines


RULE_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: What the classifier sees of a text, each made roughly normal by a square root or logarithm.
FEATURES = ["log words", "mean word length", "distinct words", "word equals the one before", "symbols", "bars", "exclamation marks", "capitals", "digits", "other punctuation", "ends of sentences", "repeated lines", "repeated 3-word windows", "longest word"]


def features(b: bytes) -> list[float]:
    words = b.split()
    n, size = len(words), max(1, len(b))
    few = max(1, n)
    chars = len(b) - count(b, _SPACE + _INNER)
    letters = max(1, count(b, _UPPER + _LOWER))
    again, lines = duplicate_lines(b)
    root = lambda x, y: (x / y) ** 0.5
    return [
        float(np.log1p(n)),
        float(np.log1p(chars / few)),
        root(len(set(words)), few),
        root(sum(map(eq, words, words[1:])), few),
        root(count(b, b"#*$%&<>@^~=+_\\{}[]"), size),
        root(b.count(b"|"), size),
        root(b.count(b"!"), size),
        root(count(b, _UPPER), letters),
        root(count(b, _DIGIT), size),
        root(count(b, b",;:'\"()-/"), size),
        root(count(b, _END), few),
        root(again, max(1, lines)),
        root(repeated_words(words), few),
        float(np.log1p(max(map(len, words), default=0))),
    ]
