"""SuperMinHash signatures of many sets at once.

Element i ranks all m slots by a random permutation; in round j it offers j + r_ij (r_ij uniform in [0, 1)) to the slot at
place j of its permutation, and a slot keeps the least offer. The ranks of one element are thus correlated, which lowers the
variance below that of independent hashes. Offers of round j are at least j, so a set whose slots all hold less than j is
done: with more elements than slots that is after a few rounds. Offers are integers here: the round in the high bits.
"""

from __future__ import annotations

import numpy as np

from leafmill.llm.textscan import mix

U = np.uint64
#: Rounds for which places are traced back through the swaps before whole permutations are laid out.
TRACED = 6
#: Elements whose permutations are laid out at once.
LAID = 1 << 13


def _draw(h: np.ndarray, j: int) -> np.ndarray:
    return h if j == 0 else mix(h + U((0x9E3779B97F4A7C15 * j) & (2**64 - 1)))


def _offer(sig: np.ndarray, doc: np.ndarray, slot: np.ndarray, value: np.ndarray) -> None:
    flat = doc * sig.shape[1] + slot
    less = value < sig.ravel()[flat]
    flat, value = flat[less], value[less]
    np.minimum.at(sig.ravel(), flat, value)


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, m: int = 128) -> np.ndarray:
    """Signatures (n_docs, m) of sets given as (document, well-mixed hash) ordered by document; m is a power of two.

    An empty set has the greatest value everywhere.
    """
    bits = m.bit_length() - 1
    sig = np.full((n_docs, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    doc, h = doc.astype(np.int64), h.astype(np.uint64)
    picks: list[np.ndarray] = []  # place drawn in each round so far, by element
    j = 0
    while len(doc) and j < min(TRACED, m):
        r = _draw(h, j)
        k = (j + (((r >> U(40)) * U(m - j)) >> U(24))).astype(np.int64)
        slot = k
        for t in range(j - 1, -1, -1):  # where the slot at place k stood before round t's swap
            slot = np.where(slot == t, picks[t], np.where(slot == picks[t], t, slot))
        _offer(sig, doc, slot, (r & U((1 << 40) - 1)) + (U(j) << U(40)))
        picks.append(k)
        j += 1
        open_ = sig.max(axis=1) >> U(40) >= U(j)
        keep = open_[doc]
        if not keep.all():
            doc, h, picks = doc[keep], h[keep], [p[keep] for p in picks]
    cut = 0
    while cut < len(doc):  # few sets are left: those smaller than the signature
        end = min(cut + LAID, len(doc))
        end = int(np.searchsorted(doc, doc[end - 1], side="right"))
        _laid_out(sig, doc[cut:end], h[cut:end], [p[cut:end] for p in picks], j, m)
        cut = end
    return sig


def _laid_out(sig: np.ndarray, doc: np.ndarray, h: np.ndarray, picks: list[np.ndarray], j: int, m: int) -> None:
    at = np.arange(len(doc))
    perm = np.tile(np.arange(m, dtype=np.int16), (len(doc), 1))

    def swap(t: int, k: np.ndarray) -> None:
        own = perm[at, t].copy()
        perm[at, t] = perm[at, k]
        perm[at, k] = own

    for t in range(j):
        swap(t, picks[t])
    while j < m and len(doc):
        r = _draw(h, j)
        k = (j + (((r >> U(40)) * U(m - j)) >> U(24))).astype(np.int64)
        swap(j, k)
        _offer(sig, doc, perm[at, j].astype(np.int64), (r & U((1 << 40) - 1)) + (U(j) << U(40)))
        j += 1
        keep = (sig.max(axis=1) >> U(40) >= U(j))[doc]
        if not keep.all():
            doc, h, perm = doc[keep], h[keep], perm[keep]
            at = np.arange(len(doc))


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """Hashes (n_docs, m / rows) of the bands of each signature, the band's number mixed in."""
    n, m = sig.shape
    out = np.zeros((n, m // rows), dtype=np.uint64)
    for i in range(rows):
        out = mix(out * U(0x2545F4914F6CDD1D) + sig[:, i::rows][:, : m // rows])
    return mix(out + np.arange(m // rows, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
