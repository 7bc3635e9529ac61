"""Words of texts as 64-bit hashes, for the operators that work on arrays inside tasks."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np

from talktally.llm.base import held

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
SHIFT = np.uint64(33)


def hash64(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words met lately."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = hash64(word)
        return value


def mixed(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers without visible order."""
    x = np.bitwise_xor(x, x >> SHIFT, out=out)
    x *= MIX[0]
    x ^= x >> SHIFT
    x *= MIX[1]
    x ^= x >> SHIFT
    return x


def low_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words between space and the controls 9 to 13 (what bytes.split() splits at)."""
    return text.lower().split()


def hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after the other, and each text's number of words."""
    counts = np.fromiter(map(len, words), "int64", len(words))
    return np.fromiter(map(held("word hashes", WordHashes).__getitem__, chain.from_iterable(words)), "uint64", int(counts.sum())), counts


GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTES = mixed((np.arange(256, dtype="uint64") + np.uint64(1)) * ODD)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
POWERS = 5 << 18  # powers that are kept


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of `ODD` and of its inverse."""
    made = []
    for factor in (int(ODD), pow(int(ODD), -1, 1 << 64)):
        each = np.full(n, factor, "uint64")
        each[0] = 1
        made.append(np.multiply.accumulate(each))
    return made[0], made[1]


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words one after the other, A-Z lower-cased, and each text's number of words, in array steps.

    A word's hash is a polynomial in `ODD` over numbers of its bytes, taken from running sums, and mixed with its length.
    """
    joined = np.frombuffer(b"\n".join([*texts, b""]), "uint8")
    borders = np.cumsum(np.fromiter(map(len, texts), "int64", len(texts)) + 1)
    inside = np.concatenate(([False], ~GAPS[joined]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(joined)
    powers, inverse = _powers(n) if n > POWERS else held("powers", lambda: _powers(POWERS))
    sums = np.zeros(n + 1, "uint64")
    np.cumsum(BYTES[joined] * powers[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mixed(hashes + (ends - starts).astype("uint64") * MIX[0])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)
