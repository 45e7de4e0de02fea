"""Vectorised hashing of words, for whole batches of texts at a time.

Words are cut at white space, control characters, punctuation and symbols of any script. In scripts that are written
without spaces every character is a word, so that neighbouring words are n-grams of characters.
"""

from __future__ import annotations

import re
import string
import unicodedata

import numpy as np

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of words: all but white space, control characters and ASCII punctuation.
_IN_WORD = np.ones(256, np.int8)
_IN_WORD[:33] = 0
_IN_WORD[127] = 0
_IN_WORD[[ord(c) for c in string.punctuation]] = 0


#: Han, kana, bopomofo, Thai, Lao, Tibetan, Myanmar, Khmer and others without spaces between words.
_SPACELESS = "\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u1950-\u19df\u1a20-\u1aad\u2e80-\u2fd5\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303b\u3041-\u30fa\u30fc-\u318e\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua48c\ua9e0-\ua9fe\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b2ff\U00020000-\U000323af"


def _class(of) -> str:
    """A character class of all characters beyond ASCII that ``of`` is true for, on the first two planes."""
    out, start = [], None
    for i in range(128, 0x20001):
        ok = i < 0x20000 and of(chr(i))
        if ok and start is None:
            start = i
        if not ok and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(i - 1)) if i - 1 > start else ""))
            start = None
    return "".join(out)


_MARKS = _class(lambda c: unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) in ("Cc", "Cf"))
_CUTS, _SINGLE = re.compile(f"[{_MARKS}]+"), re.compile(f"[{_SPACELESS}]")

#: The bytes of texts without such characters: those that no such character's UTF-8 begins with (of C3, which most European letters begin with, there are two).
_SIGNS = ("×".encode(), "÷".encode())
_USUAL = bytes(i for i in range(256) if i < 0xC0 or i < 0xE0 and (i == 0xC3 or i in (0xC0, 0xC1) or not any(_CUTS.match(chr(c)) or _SINGLE.match(chr(c)) for c in range((i & 31) << 6, (i & 31) + 1 << 6))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _raised(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class _Powers:
    """Powers of an odd base and its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _raised(_BASE, size), _raised(_INVERSE, size)
        return self.up, self.down


_powers = _Powers()


def lowered(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def cut(text: bytes) -> bytes:
    """``text`` in lower case, with spaces for punctuation beyond ASCII and around characters of scripts without spaces."""
    if text.isascii():
        return text.lower()
    low = text.decode("utf-8", "replace").lower()
    if text.translate(None, _USUAL) or any(x in text for x in _SIGNS):
        low = _SINGLE.sub(r" \g<0> ", _CUTS.sub(" ", low))
    return low.encode("utf-8", "surrogatepass")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-case words of ``texts``, and at which of them each text starts (one more than texts)."""
    low = [cut(t) for t in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(low) + b"\n", np.uint8)
    starts = np.cumsum([1, *(len(t) + 1 for t in low)])
    edges = np.flatnonzero(np.diff(_IN_WORD[buffer])) + 1
    first, past = edges[::2], edges[1::2]
    up, down = _powers.get(len(buffer))
    sums = np.cumsum(_VALUE[buffer] * up[: len(buffer)])
    hashes = mix((sums[past - 1] - sums[first - 1]) * down[first])
    return hashes, np.searchsorted(first, starts)
