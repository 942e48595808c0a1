"""Token ids by the tokenizers library, with a bounded memory of words that were met before.

Byte-level BPE splits a text by a fixed pattern and then encodes each piece by itself. For texts of ASCII and Latin letters
the pieces are found by Python's re, and each distinct one goes through the library's BPE model once; all other texts, those
that hold an added token's content, and tokenizers of another build, go through the library's encode_batch whole. Both ways
give the same ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from operator import itemgetter

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Words stand before the contractions, which begin with no letter: most pieces are words.
_PIECES = re.compile(rf" ?[{_LETTERS}]++| ?[0-9]++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTERS}0-9]++|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]")
#: Pieces that a worker remembers by default (about 160 bytes each), and the longest one that it does.
MEMORY, LONGEST = 300_000, 64


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Held(dict):
    """Bytes of the ids of pieces that were met; one that is missing is encoded, and held unless it is long."""

    __slots__ = ("letters", "tokenize")

    def __missing__(self, x: str) -> bytes:
        as_letters = "Ġ" + x[1:] if x[0] == " " and x.isascii() and not x.isspace() else x.encode("utf-8").decode("latin-1").translate(self.letters)
        out = array("I", [t.id for t in self.tokenize(as_letters)]).tobytes()
        if len(x) <= LONGEST:
            self[x] = out
        return out


class _Known:
    """Pieces that were met, memory of them at most."""

    def __init__(self, model, memory: int):
        self.memory = memory
        self.tokenize, self.letters = model.tokenize, _byte_letters()
        self.hold({})

    def hold(self, pieces: dict[str, bytes]) -> None:
        self.held = _Held(pieces)
        self.held.tokenize, self.held.letters = self.tokenize, self.letters

    def clear(self) -> None:
        self.held.clear()

    def joined(self, pieces: list[str]) -> bytes:
        """The ids of all pieces of a text, by one look-up for them all."""
        return b"".join(itemgetter(*pieces)(self.held)) if len(pieces) > 1 else b"".join([self.held[x] for x in pieces])

    def shrink(self) -> None:
        """Forgets longer pieces once there are too many, and all where that isn't enough."""
        if len(self.held) > self.memory:
            short = {k: v for k, v in self.held.items() if len(k) <= 8}
            self.hold(short if len(short) <= self.memory // 2 else {})


class Encoder:
    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self.model, memory)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.by_piece = (
            made["model"].get("type") == "BPE" and not made.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not made["model"].get("dropout") and not made["model"].get("ignore_merges") and all(x.get("special") for x in made.get("added_tokens", ()))
        )
        self.added = [x["content"] for x in made.get("added_tokens", ())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if not self.by_piece or _OTHER.search(text) or any(map(text.__contains__, self.added)):
                rest.append(i)
            else:
                out[i] = self.known.joined(_PIECES.findall(text))
        self.known.shrink()
        if rest:
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for i, e in zip(rest, encode([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One for each worker process; path names a file that every machine has."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, memory)
    _encoders[path].known.memory = memory
    return _encoders[path]


def default_path() -> str:
    """The installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
