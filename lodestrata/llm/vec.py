"""Vectorised text primitives: code points, character classes, word spans and 64-bit span hashes with numpy.

A step works on the concatenation of many texts, so cost per text is small. Hashes of spans of up to SHORT characters
come from one prefix sum of a polynomial in an odd base modulo 2**64 (an odd base has an inverse), then a finaliser.
Over long spans such a polynomial has collisions that anyone can build (Thue-Morse words of two letters), so longer
spans are hashed by BLAKE2b, as are whole texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_TOP = 0x30000
_BASE = 0x9E3779B97F4A7C15
#: Characters of a span up to which its hash is the polynomial.
SHORT = 32
# Code points with the Unicode property White_Space.
_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower case, stable, value) by code point below 0x30000, by rule from the Unicode database.

    stable: assigned with the same category in Unicode 3.2 and with a one-to-one lower case, so that every Unicode
    version of a tokenizer library treats it alike.
    """
    old = unicodedata.ucd_3_2_0
    kind, stable = np.zeros(_TOP, np.uint8), np.zeros(_TOP, bool)
    lower = np.arange(_TOP, dtype=np.uint32)
    for i in range(_TOP):
        c = chr(i)
        cat = unicodedata.category(c)
        if cat[0] == "L":
            kind[i] = LETTER
        elif cat[0] == "N":
            kind[i] = NUMBER
        if cat != "Cn" and not 0xD800 <= i < 0xE000:
            stable[i] = cat == old.category(c)
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
        else:
            stable[i] = False
    kind[list(_SPACES)] = SPACE
    stable[0x3A3] = False  # its lower case depends on its place in some libraries
    return kind, lower, stable, mix(np.arange(1, _TOP + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for places 0..n-1."""
    if len(_powers[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0][:n], _powers[1][:n]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together and the place where each text begins (one more at the end)."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return cp, starts


def spans_hash(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [s, e) of code points."""
    n = len(cp)
    up, down = powers(n + 1)
    value = tables()[3]
    term = value[np.minimum(cp, _TOP - 1)] if n else np.zeros(0, np.uint64)
    if n and cp.max() >= _TOP:
        term = term ^ np.where(cp >= _TOP, mix(cp.astype(np.uint64)), np.uint64(0))
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(term * up[:n], out=pre[1:])
    out = mix((pre[e] - pre[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    for i in np.flatnonzero(e - s > SHORT).tolist():
        out[i] = int.from_bytes(digest(cp[s[i] : e[i]], 8), "little")
    return out


def digest(part: np.ndarray, size: int = 16, person: bytes = b"") -> bytes:
    """BLAKE2b of an array's bytes."""
    return hashlib.blake2b(np.ascontiguousarray(part).data, digest_size=size, person=person).digest()


class Words:
    """Words of many texts: maximal runs of letters and digits, in lower case.

    cp: lower-cased code points; s, e: spans; h: 64-bit hashes; doc: number of the text; first: first word of each
    text (one more at the end); starts: first code point of each text.
    """

    def __init__(self, texts: list[str]):
        kind, lower, _, _ = tables()
        cp, self.starts = codes(texts)
        at = np.minimum(cp, _TOP - 1)
        k = kind[at]
        self.cp = np.where(cp < _TOP, lower[at], cp)
        word = np.zeros(len(cp) + 2, bool)
        word[1:-1] = (k == LETTER) | (k == NUMBER)
        begins = word[1:-1] & ~word[:-2]
        inner = self.starts[1:-1]
        inner = inner[inner < len(cp)]
        begins[inner] |= word[1:-1][inner]
        self.s = np.flatnonzero(begins)
        ends = word[1:-1] & ~word[2:]
        before = inner[inner > 0] - 1
        ends[before] |= word[1:-1][before]
        self.e = np.flatnonzero(ends) + 1
        self.h = spans_hash(self.cp, self.s, self.e)
        self.first = np.searchsorted(self.s, self.starts)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)


def grams(w: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words of a text; with ``short``, a text of fewer words gives one.

    Runs are a few words long, so the polynomial over their hashes is safe (see SHORT)."""
    n = len(w.h)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    have = np.maximum(w.counts - size + 1, np.where(short & (w.counts > 0), 1, 0))
    doc = np.repeat(np.arange(len(w.counts)), have)
    head = np.cumsum(have) - have
    at = np.arange(have.sum()) - np.repeat(head - w.first[:-1], have)
    up, down = powers(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(w.h * up[:n], out=pre[1:])
    end = np.minimum(at + size, w.first[1:][doc])
    return mix((pre[end] - pre[at]) * down[at]), doc
