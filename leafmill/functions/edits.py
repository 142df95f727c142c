"""Weighted edit costs between words, priced in Arrow batches of pairs; deletion keys on which near words meet."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.cluster import ship
from leafmill.scratch import in_bloom

# Cost of an insertion, deletion, substitution or swap of neighbours, and of a confusable substitution.
EDIT, CONFUSABLE = 10, 4

# Letters that are easily taken for one another, group by group.
GROUPS = (
    "aàảãáạ", "ăằẳẵắặ", "âầẩẫấậ", "eèẻẽéẹ", "êềểễếệ", "iìỉĩíị",
    "oòỏõóọ", "ôồổỗốộ", "ơờởỡớợ", "uùủũúụ", "ưừửữứự", "yỳỷỹýỵ",
)
GROUP_OF = {c: i + 1 for i, g in enumerate(GROUPS) for c in g}


#: What no pair within reach can cost.
FAR = 1 << 20
#: First letters of a word whose deletions are keys: bounds a word's keys to some 300. Edits behind them are left to the price.
PREFIX = 12
#: Most edits of a word: the keys are made for 1, 2 and 3.
EDITS = 3


def pair_costs(a: list[str], b: list[str], confusable: bool | np.ndarray = True, most: int | None = None) -> np.ndarray:
    """Optimal string alignment costs of pairs of words; confusable: for all pairs alike, or of each.

    With most, costs above it may come out greater than they are, and only the table's band that it reaches is filled.
    """
    out = np.zeros(len(a), dtype=np.int64)
    if not a:
        return out
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flags = np.broadcast_to(np.asarray(confusable, dtype=bool), (len(a),))
    size = -(-np.maximum(la, lb) // 4)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # pairs of like length share a table
        at = order[s:e]
        out[at] = _table([a[i] for i in at.tolist()], [b[i] for i in at.tolist()], la[at], lb[at], flags[at], most)
    return out


def _table(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, confusable: np.ndarray, most: int | None) -> np.ndarray:
    wide = max(1, int(max(la.max(), lb.max())))
    reach = wide if most is None else most // EDIT
    codes = [np.array(x, dtype=f"U{wide}").view(np.uint32).reshape(len(x), wide).T for x in (a, b)]
    grouped = bool(confusable.any())
    if grouped:
        table = np.zeros(max(int(c.max()) for c in codes) + 1, dtype=np.int16)
        for c, g in GROUP_OF.items():
            if ord(c) < len(table):
                table[ord(c)] = g
        groups = [table[c] for c in codes]
    rows = np.arange(len(a))
    before = now = np.repeat((np.arange(lb.max() + 1, dtype=np.int32) * EDIT)[:, None], len(a), axis=1)
    out = np.where(la == 0, now[lb, rows], FAR)
    for i in range(1, int(la.max()) + 1):
        new = np.full_like(now, FAR)
        new[0] = i * EDIT
        x = codes[0][i - 1]
        for j in range(max(1, i - reach), min(int(lb.max()), i + reach) + 1):
            y = codes[1][j - 1]
            change = np.where(x == y, 0, EDIT)
            if grouped:
                alike = confusable & (x != y) & (groups[0][i - 1] > 0) & (groups[0][i - 1] == groups[1][j - 1])
                change = np.where(alike, CONFUSABLE, change)
            cell = np.minimum(np.minimum(now[j], new[j - 1]) + EDIT, now[j - 1] + change)
            if i > 1 and j > 1:
                swap = (x == codes[1][j - 2]) & (codes[0][i - 2] == y)
                cell = np.where(swap, np.minimum(cell, before[j - 2] + EDIT), cell)
            new[j] = cell
        before, now = now, new
        out = np.where(la == i, now[lb, rows], out)
    return out


def edit_cost(a: Column, b: Column, confusable: Column | None = None, most: int | None = None) -> Column:
    """Cost of turning one word into the other, in tenths of an edit; see pair_costs."""

    ship(SparkSession.active())

    @F.pandas_udf("int")
    def cost(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, c in batches:
            yield pd.Series(pair_costs(x.tolist(), y.tolist(), c.to_numpy(dtype=bool), most), dtype="int32")

    return cost(a, b, F.lit(True) if confusable is None else confusable)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


@functools.cache
def _kept(size: int, left: int) -> np.ndarray:
    picks = list(itertools.combinations(range(size), left))
    return np.array(picks, dtype=np.int64).reshape(len(picks), left)


def deletion_keys(words: list[str], edits: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, own) of what is left of each word's first letters when some are deleted.

    Two words within k edits (insertion, deletion, change, swap of neighbours) have, after at most k deletions each, something
    in common, and so have their first PREFIX letters. Further deletions on both sides keep it so; a key is therefore made for
    just one length, that of the longer word less k, and holds k and that word's length. In a pair the longer word's
    key is its own. Keys of different salts do not meet.
    """
    chars = np.array(words, dtype=f"U{PREFIX}").view(np.uint32).reshape(len(words), PREFIX).astype(np.uint64)
    size = np.array([min(len(w), PREFIX) for w in words], dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for code in np.unique(size * (EDITS + 1) + edits).tolist():
        n, k = divmod(code, EDITS + 1)
        at = np.flatnonzero((size == n) & (edits == k))
        own = chars[at]
        for gone in range(min(n, k) + 1):
            pick = _kept(n, n - gone)
            h = np.full((len(at), len(pick)), (n + k - gone) * 8 + k, dtype=np.uint64)
            for c in range(n - gone):
                h = h * np.uint64(0x9E3779B97F4A7C15) + own[:, pick[:, c]] + np.uint64(1)
            h = _spread(_spread(h) ^ salt[at].astype(np.uint64)[:, None])
            out.append((np.repeat(at, len(pick)), h.ravel(), np.full(h.size, gone == k)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(words: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """id, key, own: the deletion keys of words (id long, salt long, word, edits int); with wanted, those that may be in that Bloom filter."""
    ship(words.sparkSession)
    shared = None if wanted is None else words.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = None if shared is None else shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                ids, salt = (b.column(c).to_numpy() for c in (0, 1))
                at, key, own = deletion_keys(b.column(2).to_pylist(), b.column(3).to_numpy(), salt.view(np.uint64))
                if filt is not None:
                    hit = in_bloom(filt, key)
                    at, key, own = at[hit], key[hit], own[hit]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(key.view(np.int64)), pa.array(own)], names=["id", "key", "own"])

    return words.select("id", "salt", "word", "edits").mapInArrow(run, "id long, key long, own boolean")


def folded(word: Column) -> Column:
    """A word with every confusable letter as its group's first: confusable changes vanish."""
    of = {c: g[0] for g in GROUPS for c in g[1:]}
    return F.translate(word, "".join(of), "".join(of.values()))
