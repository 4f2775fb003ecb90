"""Words of a text as 64-bit hashes, for the operators that run in Python."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words that a worker remembers before it starts afresh.
CACHE_WORDS = 400_000
_U = np.uint64


class WordHashes(dict):
    """bytes -> 64-bit hash; bounded, and the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than the six ASCII white spaces, A-Z lower-cased; other letters stay as they are."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=_U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_PLACE = odd_numbers(8, 17)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of size-word shingles; fewer words make one shingle; none, an empty set."""
    n = len(h)
    if not n:
        return np.empty(0, _U)
    width = min(n, size)
    s = np.full(n - width + 1, (width * 0x9E3779B97F4A7C15) & (2**64 - 1), _U)
    for k in range(width):
        s += h[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix(s))


#: Value of each byte, A-Z as a-z, and the base of the polynomial that hashes words; any fixed random numbers.
_BYTE = mix(np.arange(256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(29))
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x2545F4914F6CDD1D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(many: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < many:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * many, x, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of words_of() of all texts, one after the other, without a Python object for each: 64-bit hashes, hashes of their last three bytes, and how many each text has."""
    raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    many = np.zeros(len(raws), np.int64)
    hashes, ends, k = [np.empty(0, _U)], [np.empty(0, _U)], 0
    while k < len(raws):  # about a megabyte at a time
        first, size = k, 0
        while k < len(raws) and (k == first or size + len(raws[k]) < 1 << 20):
            size += len(raws[k]) + 1
            k += 1
        b = np.frombuffer(b" ".join([b"", *raws[first:k], b""]), np.uint8)
        gap = _SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        up, down = _power(len(b))
        values = _BYTE[b]
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(values * up[: len(b)])))
        size = (stop - start).astype(_U)
        hashes.append(mix((sums[stop] - sums[start]) * down[start] + size * _U(0x9E3779B97F4A7C15)))
        last = values[stop - 1] + np.where(size > 1, values[stop - 2], _U(0)) * _U(3) + np.where(size > 2, values[stop - 3], _U(0)) * _U(7)
        ends.append(mix(last))
        at = np.cumsum([1, *(len(r) + 1 for r in raws[first:k])])  # where each text starts, and the last ends
        many[first:k] = np.diff(np.searchsorted(start, at))
    return np.concatenate(hashes), np.concatenate(ends), many
