"""Words, word hashes and rolling hashes of whole texts, for use inside tasks.

A word is a run of characters other than space and U+0009 to U+000D, which is what ``bytes.split``
cuts UTF-8 text into.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
_CACHED_WORDS = 200_000
_CHUNK = 1 << 20
_LONG = 512


def word_array(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


class WordHashes(dict):
    """Word -> 8 bytes of its hash; a cache that starts anew when it is full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        code = self[word] = blake2b(word, digest_size=8).digest()
        return code

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Rolling:
    """Hashes of all runs of ``width`` words, by differences of one running sum.

    The sum of ``hash_i * base^-i`` over a run times ``base^start`` depends only on the run's words.
    """

    def __init__(self, width: int, seed: int):
        self.width = width
        self.base = int(odd_numbers(1, seed)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(1024)

    def _grow(self, n: int) -> None:
        powers = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)]), dtype=np.uint64)
        self.up, self.down = powers(np.uint64(self.base)), powers(np.uint64(self.inverse))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Running sums from which ``span`` takes the hash of any run of words."""
        n = len(codes)
        if n > len(self.up):
            self._grow(1 << n.bit_length())
        return np.concatenate([[np.uint64(0)], np.cumsum(codes * self.down[:n], dtype=np.uint64)])

    def span(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.up[start])

    def of(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n < self.width:
            return np.empty(0, dtype=np.uint64)
        sums = self.sums(codes)
        return mix((sums[self.width :] - sums[: -self.width]) * self.up[: n - self.width + 1])


class TextHashes:
    """Hashes of all words of whole texts, straight from their bytes, so that no word becomes an object.

    A word is hashed eight bytes at a time, each step mixing the bytes into what came before, beginning with its length: no sum whose
    terms could cancel. Words of over ``_LONG`` bytes are hashed by blake2b.
    """

    def __init__(self):
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

    def spans(self, data: bytes, starts: np.ndarray, stops: np.ndarray, lane: int = 0) -> np.ndarray:
        """Hashes of parts of ``data``; each lane is a hash of its own."""
        first, factor, step = odd_numbers(3, 18 + lane)
        # Eight bytes from any place, read as one number.
        eight = np.ndarray((len(data),), dtype="<u8", buffer=data + bytes(8), strides=(1,))
        sizes = stops - starts
        with np.errstate(over="ignore"):
            out = mix(sizes.astype(np.uint64) * first)
            take = lambda at, left: eight[at] & self.masks[np.minimum(left, 8)]
            out = mix((out ^ take(starts, sizes)) * factor + step)
            open_, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
            while len(open_):
                out[open_] = mix((out[open_] ^ take(starts[open_] + done, sizes[open_] - done)) * factor + step)
                done += 8
                open_ = open_[sizes[open_] > done]
        for i in np.flatnonzero(sizes > _LONG).tolist():
            out[i] = np.frombuffer(blake2b(data[starts[i] : stops[i]], digest_size=8, key=bytes([lane])).digest(), dtype="<u8")[0]
        return out

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, words per text)."""
        codes, sizes, at = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < _CHUNK):
                size += len(texts[stop]) + 1
                stop += 1
            found = self._chunk(texts[at:stop])
            codes.append(found[0]), sizes.append(found[1])
            at = stop
        return np.concatenate(codes), np.concatenate(sizes)

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b" ".join([b"", *texts, b""])
        space = self.space[np.frombuffer(whole, dtype=np.uint8)]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        sizes = np.diff(np.searchsorted(starts, ends, side="right"), prepend=0)
        return self.spans(whole, starts, stops), sizes
