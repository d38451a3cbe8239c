"""Vectorised word scanning over the flat UTF-8 buffers of Arrow batches.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes
never occur inside a multi-byte UTF-8 sequence, so scanning bytes equals
scanning characters. Words are identified by 64-bit hashes of their bytes and windows of
some words by 64-bit hashes made from prefix sums over the words' hashes, so no
Python code runs per word. Where an identity must hold among all windows of a
corpus, some bits of a second, independent hash join the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits, for words without punctuation.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Masks that keep the first n bytes of a little-endian word.
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
#: Words of so many bytes are digested one by one.
_LONG_WORD = 512

#: Bytes of text that one vectorised step works on (a longer text goes alone).
CHUNK_BYTES = 1 << 21


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, size, 1 << 64))])
        return self.up, self.down


_WORD_POWERS = _Powers(_WORD_BASE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """The words of consecutive texts in one flat buffer.

    ``bounds`` has one entry more than there are texts: text i owns words
    ``bounds[i]:bounds[i + 1]``, whose bytes are ``buf[starts:ends]``.
    """

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text's index for every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: (rows, bytes, offsets)."""
    buf, offsets = flat(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield slice(i, j), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def scan(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = _IS_SPACE) -> Words:
    """Finds the words of the texts; ``lower`` maps A-Z to a-z first, ``gaps`` says which bytes part words."""
    if lower:
        buf = _LOWER[buf]
    space = gaps[buf]
    inner = ~space
    first, last = inner.copy(), inner.copy()
    if len(buf):
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(buf))]
        first[edges] = inner[edges]
        last[edges - 1] = inner[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(w: Words, lane: int = 0, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for every word, of its bytes alone; works through ``step`` words at a time.

    A word is absorbed in blocks of eight bytes, each followed by a bijective scramble, so words of
    equal length up to eight bytes never collide; from ``_LONG_WORD`` bytes on, a keyed BLAKE2b
    digest is taken. ``lane`` 1 is an independent hash: two words that agree in both lanes differ
    with a chance of 2**-128.
    """
    out, size = np.empty(len(w.starts), dtype=U64), w.ends - w.starts
    padded = np.concatenate([w.buf, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(w.buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from any place
    for i in range(0, len(out), step):
        at, n = w.starts[i : i + step], size[i : i + step]
        h, live, done = mix(n.astype(U64), 2 * lane), np.flatnonzero(n < _LONG_WORD), 0
        while len(live):
            block = loads[at[live] + done] & _TAIL[np.minimum(n[live] - done, 8)]
            h[live] = mix(h[live] ^ block, 2 * lane + 1)
            done += 8
            live = live[n[live] > done]
        for j in np.flatnonzero(n >= _LONG_WORD):
            h[j] = int.from_bytes(blake2b(w.buf[at[j] : at[j] + n[j]], digest_size=8, key=bytes([lane])).digest(), "little")
        out[i : i + step] = h
    return out


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any run of words."""
    up, _ = _WORD_POWERS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of word runs ``start:end``; equal runs have equal hashes wherever they stand."""
    _, down = _WORD_POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start], seed)


def span_digests(hashes: np.ndarray, start: np.ndarray, n: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Digests of word runs made word by word from each word and its place in the run, some
    ``step`` words at a time; no prefix sums, so they share nothing with ``span_hash``."""
    out, total, i = np.zeros(len(start), dtype=U64), np.concatenate([[0], np.cumsum(n)]), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(total, total[i] + step, "right")) - 1)
        place = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], n[i:j])
        each = mix(hashes[np.repeat(start[i:j], n[i:j]) + place] ^ mix(place.astype(U64), 21), 22)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(each)])
        out[i:j] = sums[total[i + 1 : j + 1] - total[i]] - sums[total[i:j] - total[i]]
        i = j
    return mix(out + n.astype(U64), 23)


def measure(docs, text: str = "text", per_group: int = 3 << 20) -> int:
    """Number of groups so that each holds about ``per_group`` bytes of text (one aggregate pass)."""
    from pyspark.sql import functions as F

    row = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, -(-int(row["b"] or 0) // per_group), -(-int(row["n"] or 0) // 20_000))
