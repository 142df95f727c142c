"""Vectorised passes over the bytes of text columns: words, lines and shingles as 64-bit fingerprints.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A null text counts as empty. Fingerprints are
polynomials over a table of random 64-bit values, mixed; they depend on the content alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240521))
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256)
LOWER[65:91] += 32
TABLE_LOWER = TABLE[LOWER]
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Bytes taken in one go; a longer document is one block of its own.
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Block(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # uint8, the texts one after another
    offsets: np.ndarray  # int64, one more than there are documents


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """Whole documents of a text column, about size bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield Block(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, key: str) -> np.ndarray:
    got = _powers.get(key)
    if got is None or len(got) < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        got = np.multiply.accumulate(steps)
        if len(got) <= 2 * BLOCK:
            _powers[key] = got
    return got[:n]


class Hasher:
    """Fingerprints of byte ranges of one block."""

    def __init__(self, data: np.ndarray, table: np.ndarray = TABLE):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * _power(n, BASE, "up"), out=self.sums[1:])
        self.down = _power(n + 1, BASE_INV, "down")

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def range_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Fingerprints of ranges that follow one another, with the memory of one block (or of the longest range)."""
    out, i, ends = np.zeros(len(begin), dtype=np.uint64), 0, begin + size
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(ends, begin[i] + BLOCK, side="right")))
        out[i:j] = Hasher(data[begin[i] : ends[j - 1]], table).of(begin[i:j] - begin[i], ends[i:j] - begin[i])
        i = j
    return out


class Words(NamedTuple):
    doc: np.ndarray  # index of the document in the block
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # first word of each document, and the count


def words(block: Block, table: np.ndarray = TABLE, gap: np.ndarray = SPACE) -> Words:
    data, offsets = block.data, block.offsets
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~gap[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes = Hasher(data, table).of(start, end) if n <= 2 * BLOCK else range_hashes(data, start, end - start, table)
    return Words(doc, start, end, hashes, bounds)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and fingerprints of all runs of k words that lie in one document."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h += w.hash[i : i + n] * STEPS[i]
    return at, mix(h[at])


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (document, fingerprint), ordered by both; a shorter text is one shingle."""
    at, h = windows(w, k)
    doc = w.doc[at]
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += w.hash[w.bounds[short][has] + i] * STEPS[i]
        extra = mix(extra + counts[short].astype(np.uint64) * STEPS[k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each document."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
