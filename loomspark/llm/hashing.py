"""Vectorised word hashing over UTF-8 bytes, shared by the operators on word windows.

Words are runs of bytes of a given class. Every class used here treats all bytes from 0x80 on alike, so
runs of bytes are exactly runs of code points. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_LETTER = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 2**62, dtype=np.int64)) * 2 + 1
_GRAM = int(_RNG.integers(1, 2**62, dtype=np.int64)) * 2 + 1
_MASK = 2**64 - 1

#: A-Z to a-z, on bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F] once lower-cased.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of the words [^\x20\x09-\x0D].
NONSPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.array([1], dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 2**64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


class Words:
    """Words of one block of documents: byte buffer, start and end of each word, first word of each document, hashes."""

    __slots__ = ("buf", "start", "end", "first", "hash")

    def __init__(self, raw: list[bytes], kind: np.ndarray):
        self.buf = b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.buf, np.uint8)
        inside = kind[data]
        flips = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = flips[0::2], flips[1::2]
        size = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(size)]))
        n = self.end - self.start
        if len(n):
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            power = _power(int(n.max()))
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            value = _LETTER[data[inside]] * power[place]
            self.hash = mix(np.add.reduceat(value, at) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), one space between."""
        return b" ".join([self.buf[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for each start."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * np.uint64(pow(_GRAM, j + 1, 2**64))
    return mix(out)


def blocks(texts: Iterable[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, lower-cased UTF-8 of the texts) in blocks of about limit bytes; null counts as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass").translate(LOWER)
        if held and size + len(raw) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held
