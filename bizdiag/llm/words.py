"""Words of texts as 64-bit hashes, for operators on word sequences.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return. Hashes of words in lists are kept in a bounded cache of the worker.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from bizdiag.llm import worker

CACHE_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_cache = _Hashes()


def hashes(words: list[list[bytes]]) -> np.ndarray:
    """The hashes of all words, one list after the other."""
    worker.keeps("words", _cache.clear)
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    return np.fromiter(map(_cache.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words)))


#: Bytes of a word that are hashed eight at a time with those of all other words; the rest of longer ones goes by itself.
_TOGETHER = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def spans(text: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each of the byte ranges of ``text``, for all of them at once: no cache, and no object for a word.

    Other values than those of ``hashes``. Ranges of equal bytes have equal hashes wherever they lie.
    """
    padded = text + bytes(8)
    eight = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position on
    size = stop - start
    h = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = mixed(h ^ (eight[start] & _MASKS[np.minimum(size, 8)]))
    done = 8
    longer = np.flatnonzero(size > done)
    while len(longer) and done < _TOGETHER:
        part = eight[start[longer] + done] & _MASKS[np.minimum(size[longer] - done, 8)]
        h[longer] = mixed(h[longer] ^ part)
        done += 8
        longer = longer[size[longer] > done]
    if len(longer):
        rest = [xxhash.xxh3_64_intdigest(text[a + done : b]) for a, b in zip(start[longer].tolist(), stop[longer].tolist())]
        h[longer] = mixed(h[longer] ^ np.array(rest, np.uint64))
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each run of ``n`` hashes; there are ``len(h) - n + 1``.

    A polynomial in the hashes, put together from runs of 1, 2, 4, ... of them.
    """
    if len(h) < n:
        return h[:0]
    power, span, part = 0x9E3779B97F4A7C15 + 2 * seed, 1, h  # factor to the span; hashes of runs of the span
    out, done = None, 0
    while True:
        if n & span:
            size = len(h) - done - span + 1
            out = part if out is None else out[:size] * np.uint64(power) + part[done : done + size]
            done += span
        if done == n:
            return mixed(out)
        part = part[:-span] * np.uint64(power) + part[span:]
        power, span = power * power % (1 << 64), 2 * span


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each run of ``n`` values."""
    size, span = len(x) - n + 1, 1
    if size <= 0:
        return x[:0]
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:size], x[n - span : n - span + size])
