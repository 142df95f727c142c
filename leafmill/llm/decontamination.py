"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without ASCII punctuation. Documents and benchmark items are joined on Karp-Rabin
fingerprints of k-token windows; equal windows that follow one another on a diagonal make maximal matches. The longest
match is marked first; what earlier tiles hide is cut off and the remainder waits its turn. An item's coverage is the
share of its tokens under tiles, wherever they lie in the document, so reordered passages count in full.

Equal windows of a block of documents are expanded MATCHES at a time: of fewer documents, then of fewer items. Where one document
and one item have more (both repeat themselves), the longest common run is searched for by its length instead, with Karp-Rabin
fingerprints of that many tokens; the tiles are the same. An item of fewer than MIN_MATCH tokens is a tile as a whole, or not at all.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import map_text

#: Tokens of the shortest tile. An item with fewer is found where all its tokens stand together; one of a single token, which is
#: anywhere, only where it is the whole document.
MIN_MATCH = 4
#: Equal windows expanded at once.
MATCHES = 1 << 20
#: A document is contaminated if tiles cover at least this share of some item.
MIN_COVERAGE = 0.5
#: Characters of benchmark text held by a task at once; a larger benchmark is searched in several passes.
SLICE_CHARS = 32_000_000
GAP = ts.SPACE.copy()
GAP[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
FILTER = 1 << 20

OUT = "doc_id long, n_items int, best_item long, n_tiles int, covered int, coverage double, contaminated boolean, kept boolean"


class Index(NamedTuple):
    items: np.ndarray  # item ids
    sizes: np.ndarray  # tokens of each item
    seeds: np.ndarray  # different window fingerprints, in order
    bounds: np.ndarray  # first entry of each seed, and the number of entries
    item: np.ndarray  # item number of each entry, in order within a seed
    at: np.ndarray  # first token of each entry in its item
    maybe: np.ndarray  # bit of each fingerprint's low bits
    tokens: np.ndarray  # all items' tokens
    first: np.ndarray  # first token of each item
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # items of fewer tokens than a window, by size: fingerprints in order, item numbers


def tokens(b: ts.Block) -> ts.Words:
    return ts.words(b, ts.TABLE_LOWER, GAP)


def index(items: np.ndarray, texts: pa.Array, k: int = MIN_MATCH) -> Index:
    sizes, seeds, item, at, words = [], [], [], [], []
    short: dict[int, list] = {n: [] for n in range(1, k)}
    for b in ts.blocks(texts):
        w = tokens(b)
        first, h = ts.windows(w, k)
        sizes.append(np.diff(w.bounds))
        seeds.append(h)
        item.append(b.first + w.doc[first])
        at.append(first - w.bounds[w.doc[first]])
        words.append(w.hash)
        for n in short:
            start, h = ts.windows(w, n)
            own = np.flatnonzero(sizes[-1][w.doc[start]] == n)
            short[n].append((h[own], b.first + w.doc[start[own]]))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    sizes, seeds, item, at, words = map(cat, (sizes, seeds, item, at, words))
    seeds = seeds.astype(np.uint64)
    order = np.lexsort((at, item, seeds))
    different, bounds = np.unique(seeds[order], return_index=True)
    maybe = np.zeros(FILTER, dtype=bool)
    maybe[(different & np.uint64(FILTER - 1)).astype(np.int64)] = True
    few = {}
    for n, got in short.items():
        h, number = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if len(h):
            o = np.argsort(h, kind="stable")
            few[n] = h[o], number[o]
    return Index(items, sizes, different, np.append(bounds, len(seeds)), item[order], at[order], maybe, words, np.cumsum(sizes) - sizes, few)


def tiles(p: np.ndarray, q: np.ndarray, n_doc: int, n_item: int, k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling from equal windows at document token p and item token q: (length, p, q), longest first."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(p))) + k - 1
    heap = [(-int(n), int(q[i]), int(p[i])) for i, n in zip(start, size, strict=True)]
    heapq.heapify(heap)
    doc, item = np.zeros(n_doc, dtype=bool), np.zeros(n_item, dtype=bool)
    out = []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        hidden = doc[i : i + n] | item[j : j + n]
        if not hidden.any():
            doc[i : i + n] = item[j : j + n] = True
            out.append((n, i, j))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], hidden, [True])).astype(np.int8)))
        for a, z in zip(edge[::2], edge[1::2], strict=True):
            if z - a >= k:
                heapq.heappush(heap, (-int(z - a), j + int(a), i + int(a)))
    return out


def searched(a: np.ndarray, b: np.ndarray, k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The same tiles of document tokens a and item tokens b, found by the length of the longest common run not yet hidden."""
    doc, item = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    rising = lambda x: np.concatenate(([np.uint64(0)], np.cumsum(ts.mix(x) * ts._power(len(x), ts.BASE, "up"), dtype=np.uint64)))
    sums = rising(a), rising(b)
    down = ts._power(max(len(a), len(b)) + 1, ts.BASE_INV, "down")

    def runs(n: int, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the runs of n tokens that are not hidden."""
        hidden = np.concatenate(([0], np.cumsum((doc, item)[side])))
        at = np.flatnonzero(hidden[n:] == hidden[: len(hidden) - n])
        return at, ts.mix((sums[side][at + n] - sums[side][at]) * down[at])

    def common(n: int) -> bool:
        return bool(len(np.intersect1d(runs(n, 0)[1], runs(n, 1)[1])))

    out, top = [], min(len(a), len(b))
    while top >= k and common(k):
        low, high = k, top
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        n = top = low
        p, hp = runs(n, 0)
        q, hq = runs(n, 1)
        order = np.argsort(hp, kind="stable")
        hp, p = hp[order], p[order]
        begin, end = np.searchsorted(hp, hq, side="left"), np.searchsorted(hp, hq, side="right")
        nxt = dict(zip(begin.tolist(), begin.tolist(), strict=True))  # by fingerprint: its first start that may still be free
        for j, lo, hi in zip(q.tolist(), begin.tolist(), end.tolist(), strict=True):
            if lo == hi or item[j : j + n].any():
                continue
            at = nxt[lo]
            while at < hi and doc[p[at] : p[at] + n].any():
                at += 1
            nxt[lo] = at
            if at < hi:
                i = int(p[at])
                doc[i : i + n] = item[j : j + n] = True
                out.append((n, i, j))
        top = n - 1
    return out


def scan(b: ts.Block, x: Index, k: int = MIN_MATCH, least: float = MIN_COVERAGE) -> dict[int, tuple]:
    """For each document of a block with a tile: items with one, and the best item's id, tiles, tokens covered and coverage."""
    w = tokens(b)
    counts = np.diff(w.bounds)
    out: dict[int, tuple] = {}

    def add(d: int, i: int, n_tiles: int, covered: int) -> None:
        share = covered / int(x.sizes[i])
        old = out.get(d)
        better = old is None or (share, covered, -int(x.items[i])) > (old[4], old[3], -old[1])
        out[d] = ((old[0] if old else 0) + 1, *((int(x.items[i]), n_tiles, covered, share) if better else old[1:]))

    for n, (h, number) in x.short.items():
        first, own = ts.windows(w, n)
        lo, hi = np.searchsorted(h, own, side="left"), np.searchsorted(h, own, side="right")
        near = (hi > lo) & ((n > 1) | (counts[w.doc[first]] == 1))
        pairs = {(int(w.doc[f]), int(i)) for f, s, e in zip(first[near].tolist(), lo[near].tolist(), hi[near].tolist(), strict=True) for i in number[s:e]}
        for d, i in sorted(pairs):
            add(d, i, 1, n)

    first, h = ts.windows(w, k)
    near = np.flatnonzero(x.maybe[(h & np.uint64(FILTER - 1)).astype(np.int64)])
    rank = np.minimum(np.searchsorted(x.seeds, h[near]), max(0, len(x.seeds) - 1))
    ok = x.seeds[rank] == h[near] if len(x.seeds) else np.zeros(len(near), bool)
    start, rank = first[near[ok]], rank[ok]
    if not len(start):
        return out
    entry = np.repeat(np.arange(len(x.seeds)), np.diff(x.bounds)) * len(x.items) + x.item  # in order
    todo = [(0, len(start), 0, len(x.items))]  # starts and items
    while todo:
        s, e, i0, i1 = todo.pop()
        lo = np.searchsorted(entry, rank[s:e] * len(x.items) + i0)
        n = np.searchsorted(entry, rank[s:e] * len(x.items) + i1) - lo
        total = int(n.sum())
        doc = w.doc[start[s:e]]
        if not total:
            continue
        if total > MATCHES and doc[0] != doc[-1]:
            m = s + int(np.searchsorted(doc, doc[(e - s) // 2]))
            m = m if m > s else s + int(np.searchsorted(doc, doc[0], side="right"))
            todo += [(m, e, i0, i1), (s, m, i0, i1)]
            continue
        if total > MATCHES and i1 - i0 > 1:
            todo += [(s, e, (i0 + i1) // 2, i1), (s, e, i0, (i0 + i1) // 2)]
            continue
        if total > MATCHES:
            d = int(doc[0])
            got = searched(w.hash[w.bounds[d] : w.bounds[d + 1]], x.tokens[x.first[i0] : x.first[i0] + x.sizes[i0]], k)
            add(d, i0, len(got), sum(t[0] for t in got))
            continue
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        p = np.repeat(start[s:e], n)
        own, item, q = w.doc[p], x.item[at], x.at[at]
        p = p - w.bounds[own]
        order = np.lexsort((item, own))
        own, item, p, q = own[order], item[order], p[order], q[order]
        cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (item[1:] != item[:-1]), [True])))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            d, i = int(own[a]), int(item[a])
            got = tiles(p[a:z], q[a:z], int(counts[d]), int(x.sizes[i]), k)
            add(d, i, len(got), sum(t[0] for t in got))
    return out


def slices(benchmark: DataFrame, most: int = SLICE_CHARS):
    """The benchmark as (item ids, texts) of at most about `most` characters each; usually one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // most))
    for i in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").toArrow()
        yield got["item_id"].fill_null(-1).to_numpy(), got["text"].combine_chunks()


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, least: float = MIN_COVERAGE) -> DataFrame:
    """One row for each row of docs (doc_id, text): items with a tile, the best covered item, and the verdict.

    Null and empty texts have no tile and are kept; then best_item is null and the counts are 0. Null and empty items are in no
    text. Of items covered alike the one with more tokens covered, then the smaller id is named. Repeated rows each get a row, rows of one
    id each by its own text, however many passes the benchmark takes. Texts of any length are read whole. Empty tables on either side give
    an empty result, or one in which every row is kept. Other columns are not read.
    """
    parts = list(slices(benchmark))
    if len(parts) == 1:
        return one_pass(docs, index(*parts[0], k), k, least)
    # rows are told apart by id and text: what is found depends on nothing else
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct("doc_id", F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), F.octet_length(text).alias("n"))
    kind = "key struct<doc_id:long,a:long,b:long,n:int>, "
    out = None
    for i, s in enumerate(parts):
        got = one_pass(docs.withColumn("doc_id", F.col("doc_id").cast("long")), index(*s, k), k, least, [key.alias("key")], kind + OUT.removeprefix("doc_id long, "), brief=False)
        got = got.dropDuplicates(["key"])
        out = got if out is None else out.unionByName(got)
    best = F.max_by(F.struct("best_item", "n_tiles", "covered", "coverage"), F.struct("coverage", "covered", -F.col("best_item")))
    out = out.groupBy("key").agg(F.sum("n_items").cast("int").alias("n_items"), best.alias("found"), F.bool_or("contaminated").alias("contaminated"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", key.alias("own"))
    return own.join(out, F.col("own").eqNullSafe(F.col("key"))).select("doc_id", "n_items", "found.*", "contaminated", (~F.col("contaminated")).alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, as they are, that no part of the benchmark contaminates.

    Null and empty texts stay, repeated rows fare alike, columns of any name are carried along. Without items every row stays; an
    empty table stays empty.
    """
    for s in slices(benchmark):
        row = StructType().add("row", docs.schema)
        got = one_pass(docs, index(*s), MIN_MATCH, MIN_COVERAGE, [F.struct(*docs.columns).alias("row")], row.add("kept", BooleanType()))
        docs = got.where("kept").select("row.*")
    return docs


def one_pass(docs: DataFrame, x: Index, k: int, least: float, keys: list | None = None, ddl: str | StructType = OUT, brief: bool | None = None) -> DataFrame:
    """A row of results for each row of docs; with other keys, those and the verdict alone (brief)."""
    brief = keys is not None if brief is None else brief
    shared = docs.sparkSession.sparkContext.broadcast(x)

    def make():
        x = shared.value

        def step(cols, texts):
            for b in ts.blocks(texts):
                n_docs = len(b.offsets) - 1
                got = scan(b, x, k, least)
                rows = [got.get(i, (0, None, 0, 0, 0.0)) for i in range(n_docs)]
                bad = [r[4] >= least for r in rows]
                own = [c.slice(b.first, n_docs) for c in cols]
                yield [*own, *([] if brief else [*map(list, zip(*rows, strict=True)), bad]), [not r for r in bad]]

        return step

    return map_text(docs, keys or ["doc_id"], make, ddl)
