"""64-bit hashes of words and word n-grams over whole Arrow batches, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed at a time; a longer word is hashed in one piece.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random (the finaliser of SplitMix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, U(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_tables.get(kind, ())) < n:
        _tables[kind] = _powers(_BASE if kind == "up" else _INVERSE, max(n, CHUNK + 1))
    return _tables[kind]


def byte_table(breaks: bytes) -> np.ndarray:
    """Lower-cases A-Z and maps the bytes between words to 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(breaks)] = 0
    return t


#: Words are runs of what is not ASCII white space.
SPACES = byte_table(b"\x00\x20\x09\x0a\x0b\x0c\x0d")
SPACES[0] = 255  # NUL belongs to words; 255 occurs in no UTF-8 text
#: Words are runs of 0-9, a-z and all beyond ASCII.
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

with np.errstate(over="ignore"):
    _RANDOM = mix(np.arange(256, dtype=np.uint64) * U(0x2545F4914F6CDD1D))
_RANDOM[0] = 0


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets at which each begins, with the end."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin among them, with the end."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw, at = buffers(texts)
    b = table[raw]
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = b != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(inside & ~before)
    offsets = np.searchsorted(starts, at)
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        k = 0
        while k < len(starts):
            lo = int(starts[k])
            j = int(np.searchsorted(starts, lo + CHUNK))
            j = max(j, k + 1)
            hi = int(starts[j]) if j < len(starts) else n
            if hi - lo > 2 * CHUNK and j > k + 1:  # the last word of this chunk is long: leave it for the next
                j -= 1
                hi = int(starts[j])
            size = hi - lo
            sums = np.add.reduceat(_RANDOM[b[lo:hi]] * _power("up", size)[:size], starts[k:j] - lo)
            out[k:j] = sums * _power("down", size)[starts[k:j] - lo]
            k = j
        out = mix(out)
    return out, offsets


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, place by place."""
    with np.errstate(over="ignore"):
        out = parts[0]
        for x in parts[1:]:
            out = mix(out * U(0x9FB21C651E98DF25) + x)
        return mix(out)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, over text borders too; empty if there are fewer words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    return combine([hashes[i : i + size] for i in range(n)])


def whole(hashes: np.ndarray) -> int:
    """Hash of one whole sequence of words."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(len(hashes), dtype=np.uint64) + U(len(hashes)) * U(0x1000003))
        return int(mix(np.array([np.bitwise_xor.reduce(mix(hashes + place))], dtype=np.uint64))[0])
