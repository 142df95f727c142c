"""Exact substring dedup: maximal repeats from an enhanced suffix array, over the parts of the corpus that can repeat.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id.

1. Anchors. Of the GRAM-byte grams of a LENGTH-byte window the one with the least hash is its anchor; equal windows have
   equal anchors. A first pass sends each batch's distinct anchors, packed by hash range; what several documents have in
   common goes into a Bloom filter of bounded size. A fuller filter lets more through and changes no result.
2. Contexts. A second pass cuts out the bytes of all windows that share an anchor of the filter. Equal contexts of a batch are
   sent once, with their places, packed by the anchor's hash range.
3. Suffixes. In each range equal contexts are joined. Of their windows those stay that two documents have in common and whose
   left extensions differ; their suffixes are sorted, common prefixes of neighbours measured, and a stack scan gives the
   intervals of the common-prefix tree: each is a maximal repeat with all its occurrences and the smallest document id.
   Occurrences in other documents are marked over the repeat's whole length.
4. Marks are packed by document, merged, and joined to the texts of just the documents that have any (a second Bloom filter
   keeps the others' texts where they are).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import arrow_schema, map_text, trim
from leafmill.llm.scratch import bloom, in_bloom, saved

LENGTH = 50
GRAM = 24
#: Windows of one context; 80 bytes at most, so that a suffix is ten words of eight bytes.
RUN = 31
SUFFIX = LENGTH + RUN - 1
#: Text bytes for each hash range, and the bounds on their number.
RANGE_BYTES, RANGES = 4_000_000, (64, 1 << 16)
BLOOM_BITS = 1 << 30
#: Blocks of text whose anchors or contexts are packed together.
PACKED = 8
#: Suffixes sorted at once, and windows hashed at once within a range; ranges are cut between anchors.
SORTED = 20_000
WINDOWS = 60_000

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(b: ts.Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within documents, and their anchors' hashes."""
    n = len(b.data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, mul = ts.TABLE[b.data], int(ts.BASE)
    done, at, step = None, 0, 1
    while step <= GRAM:  # a gram's hash from those of its power-of-two parts
        if GRAM & step:
            done = h if done is None else done[: n - at - step + 1] * np.uint64(pow(mul, step, 2**64)) + h[at : at + n - at - step + 1]
            at += step
        if step * 2 <= GRAM:
            h = h[: len(h) - step] * np.uint64(pow(mul, step, 2**64)) + h[step:]
        step *= 2
    m, size, w = ts.mix(done), 1, LENGTH - GRAM + 1
    while size * 2 <= w:  # least of w neighbours by doubling
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    ends = np.repeat(b.offsets[1:], np.diff(b.offsets))[: len(m)]
    start = np.flatnonzero(np.arange(len(m)) + LENGTH <= ends)
    return start, ts.mix(m[start] ^ np.uint64(0xB5026F5AA96619E9))  # least hashes are small ones: spread them again


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(columns), *(len(c) for c in columns)], dtype=np.int64)
    kinds = b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + kinds + b"".join(c.tobytes() for c in columns))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    k = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * k], np.int64)
    kinds = [np.dtype(raw[8 + 8 * k + 4 * i : 12 + 8 * k + 4 * i].decode().strip()) for i in range(k)]
    out, at = [], 8 + 12 * k
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def cut_by(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, and the parts' bounds in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    out = np.ones(len(x), dtype=bool)
    out[1:] = x[1:] != x[:-1]
    return out


def shared_anchors(docs: DataFrame, ranges: int) -> DataFrame:
    """The hashes (code) of anchors that lie in rows with different ids, by their leading bits: all that follows tests these."""
    bits = ranges.bit_length() - 1

    def make():
        codes: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def step(keys, texts):
            ids = keys[0].fill_null(0).to_numpy(zero_copy_only=False)
            for b in ts.blocks(texts):
                start, m = anchors(b)
                new = changes(m) | changes(start - np.arange(len(start)))
                codes.append(m[new] >> np.uint64(32 - bits))
                rows.append(ids[b.first + np.searchsorted(b.offsets, start[new], side="right") - 1])
                if len(codes) == PACKED:
                    yield from done()

        def done():
            if not codes:
                return
            code, row = np.concatenate(codes), np.concatenate(rows)
            codes.clear()
            rows.clear()
            order = np.argsort(code)
            code, row = code[order], row[order]
            first = np.flatnonzero(changes(code))
            if not len(first):
                return
            lone = np.minimum.reduceat(row, first)
            many = lone != np.maximum.reduceat(row, first)
            code = code[first]
            bounds = np.searchsorted(code, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
            parts = np.flatnonzero(np.diff(bounds))
            yield [parts.astype(np.int32), [pack(code[i:j].astype(np.uint32), many[i:j], lone[i:j]) for i, j in zip(bounds[parts], bounds[parts + 1], strict=True)]]

        step.done = done
        return step

    def meet(table: pa.Table) -> pa.Table:
        got = [unpack(x) for x in table["packed"].to_pylist()]
        code, many, row = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.argsort(code)
        code, many, row = code[order], many[order], row[order]
        first = np.flatnonzero(changes(code))
        both = np.logical_or.reduceat(many, first) | (np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first))
        part = np.uint64(table["part"][0].as_py())
        return pa.table({"code": pa.array(ts.mix(code[first][both].astype(np.uint64) | (part << np.uint64(32))).view(np.int64))})

    sent = map_text(docs, ["doc_id"], make, "part int, packed binary")
    return sent.groupBy("part").applyInArrow(meet, "code long")


def contexts(docs: DataFrame, words: np.ndarray, ranges: int) -> DataFrame:
    """(part, packed): the contexts of windows whose anchors may be shared, by hash range, with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    bits = ranges.bit_length() - 1

    def make():
        filt = shared.value
        out: list[tuple] = []

        def step(keys, texts):
            ids = keys[0].fill_null(0).to_numpy(zero_copy_only=False)
            marks = keys[1].to_numpy(zero_copy_only=False).astype(np.int64)
            for b in ts.blocks(texts):
                start, m = anchors(b)
                if not len(start):
                    continue
                new = np.flatnonzero(changes(m) | changes(start - np.arange(len(start))))
                hit = in_bloom(filt, ts.mix(m[new] >> np.uint64(32 - bits)))
                size = np.diff(np.append(new, len(m)))[hit]
                new = new[hit]
                pieces = -(-size // RUN)  # long runs, of periodic text, are cut
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(np.repeat(size, pieces) - nth * RUN, RUN) + LENGTH - 1
                at, h = np.repeat(start[new], pieces) + nth * RUN, np.repeat(m[new], pieces)
                doc = np.searchsorted(b.offsets, at, side="right") - 1
                code = ts.Hasher(b.data).of(at, at + size)
                order = np.argsort(code, kind="stable")
                first = changes(code[order])
                number = np.empty(len(code), np.int64)
                number[order] = np.cumsum(first) - 1
                one = order[first]
                n = size[one]
                text = b.data[np.repeat(at[one] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                out.append((text, n, h[one], number, b.first + doc, at - b.offsets[doc], ids, marks))
                if len(out) == PACKED:
                    yield from done()

        def done():
            if not out:
                return
            base = np.cumsum([0, *(len(x[1]) for x in out)])
            number = np.concatenate([x[3] + n for x, n in zip(out, base[:-1], strict=True)])
            text, size, h, place = (np.concatenate([x[i] for x in out]) for i in (0, 1, 2, 5))
            tables = list({id(x[6]): (x[6], x[7]) for x in out}.values())  # rows' ids and marks, batch by batch
            at = dict(zip((id(x) for x, _ in tables), np.cumsum([0, *(len(x) for x, _ in tables)]).tolist(), strict=False))
            row = np.concatenate([x[4] + at[id(x[6])] for x in out])
            ids, marks = (np.concatenate(x) for x in zip(*tables, strict=True))
            out.clear()
            part = (h >> np.uint64(64 - bits)).astype(np.int64)
            order, bounds = cut_by(part, ranges)
            begin = np.cumsum(size) - size
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            use = np.argsort(rank[number], kind="stable")
            owner = rank[number][use]
            cuts = np.searchsorted(owner, bounds)
            parts = np.flatnonzero(np.diff(bounds))
            blobs = []
            for p in parts.tolist():
                own = order[bounds[p] : bounds[p + 1]]
                n = size[own]
                flat = text[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                u = use[cuts[p] : cuts[p + 1]]
                rows, nth = np.unique(row[u], return_inverse=True)
                blobs.append(pack(flat, n.astype(np.uint8), h[own], (owner[cuts[p] : cuts[p + 1]] - bounds[p]).astype(np.int32), ids[rows], marks[rows], nth.astype(np.int32), place[u]))
            yield [parts.astype(np.int32), blobs]

        step.done = done
        return step

    return map_text(docs, ["doc_id", F.col("__mark")], make, "part int, packed binary")


def intervals(lcp: list[int], docs: list[int], left: list[int], least: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Maximal repeats (first, last, length, smallest document) among sorted suffixes, by a stack scan.

    lcp[i] is the common prefix of suffixes i - 1 and i (0 at 0 and behind the last). left is the byte before each suffix,
    below 0 where nothing is known of it; an interval whose suffixes all have one byte before them is no maximal repeat.
    """
    out = []
    stack: list[list[int]] = []  # length, first suffix, smallest document, byte before (or -1 if they differ)
    for i in range(1, len(lcp)):
        here = lcp[i]
        doc, byte, first = docs[i - 1], left[i - 1], i - 1
        if byte < 0:
            byte = -1
        while stack and stack[-1][0] > here:
            size, first, d, c = stack.pop()
            doc = d if d < doc else doc
            byte = byte if byte == c else -1
            if byte < 0:
                out.append((first, i - 1, size, doc))
        if stack and stack[-1][0] == here:
            top = stack[-1]
            top[2] = doc if doc < top[2] else top[2]
            top[3] = byte if byte == top[3] else -1
        elif here >= least:
            stack.append([here, first, doc, byte])
    return out


def repeats_in(flat: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Marks (context, from, length, smallest document) on distinct contexts; low and high: their least and greatest document."""
    begin = np.cumsum(size) - size
    n = size - LENGTH + 1
    ctx = np.repeat(np.arange(len(size)), n)
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[ctx] + rel
    h = ts.Hasher(flat).of(at, at + LENGTH)
    order = np.argsort(h)
    first = np.flatnonzero(changes(h[order]))
    both = np.minimum.reduceat(low[ctx[order]], first) != np.maximum.reduceat(high[ctx[order]], first)
    before = np.where(rel > 0, flat[np.maximum(at - 1, 0)].astype(np.int64), np.int64(256))  # a context's start: unknown
    b = before[order]
    free = np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first)
    free |= np.maximum.reduceat(b, first) > 255
    classes = np.flatnonzero(both & free)
    n = np.diff(np.append(first, len(order)))
    out, i = [[np.zeros(0, np.int64)] * 4], 0
    upto = np.concatenate(([0], np.cumsum(n[classes])))
    while i < len(classes):  # windows of one class stay together; classes are independent
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + SORTED, side="right")) - 1)
        use = classes[i:j]
        k = np.repeat(first[use] - (upto[i:j] - upto[i]), n[use]) + np.arange(upto[j] - upto[i])
        keep = order[k]
        out.append(maximal(flat, size, low, high, ctx[keep], rel[keep], at[keep], before[keep]))
        i = j
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def maximal(flat, size, low, high, ctx, rel, at, before) -> list[np.ndarray]:
    """Marks from the suffixes that begin at some windows: the part of the enhanced suffix array that holds their classes."""
    none = [np.zeros(0, np.int64)] * 4
    length = np.minimum(size[ctx] - rel, SUFFIX)
    grid = np.arange(SUFFIX, dtype=np.int32)
    chars = np.append(flat, np.zeros(SUFFIX, np.uint8))[at.astype(np.int32)[:, None] + grid]
    chars[grid >= length[:, None]] = 0
    words = chars.view(">u8")
    order = np.lexsort((length, *words.T[::-1]))
    chars, length, ctx, rel, before = chars[order], length[order], ctx[order], rel[order], before[order]
    differ = chars[1:] != chars[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), SUFFIX)
    lcp = np.minimum(lcp, np.minimum(length[1:], length[:-1]))
    found = intervals([0, *lcp.tolist(), 0], low[ctx].tolist(), np.where(before > 255, -1, before).tolist())
    # where no neighbour shares as much: a context that several documents have as it stands
    lone = np.flatnonzero(low[ctx] != high[ctx])
    nodes = [np.array(x, dtype=np.int64) for x in zip(*found, strict=True)] if found else none
    a, z, size_, doc = (np.concatenate([x, y]) for x, y in zip(nodes, (lone, lone, length[lone], low[ctx[lone]]), strict=True))
    n = z - a + 1
    s = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    doc, size_ = np.repeat(doc, n), np.repeat(size_, n)
    use = high[ctx[s]] > doc
    return [ctx[s][use], rel[s][use], size_[use], doc[use]]


def needed(ctx: np.ndarray, rel: np.ndarray, length: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """The marks without those whose bytes others with no greater document cover: at most SUFFIX for each context."""
    order = np.lexsort((-length, rel, least, ctx))
    keep, now, covered = [], -1, 0
    for i, c, r, n in zip(order.tolist(), ctx[order].tolist(), rel[order].tolist(), length[order].tolist(), strict=True):
        if c != now:
            now, covered = c, 0
        mask = ((1 << n) - 1) << r
        if mask & ~covered:
            keep.append(i)
            covered |= mask
    at = np.array(keep, dtype=np.int64)
    return ctx[at], rel[at], length[at], least[at]


def union(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint runs of overlapping or touching ranges within each key (keys from 0)."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    lift = key * (int(end.max()) + 2)  # so that ranges of other keys never touch
    reach = np.maximum.accumulate(end + lift)
    first = np.ones(len(key), dtype=bool)
    first[1:] = start[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return key[at], start[at], np.maximum.reduceat(end, at)


def marks_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, its text's mark, place, length) of the marks of one hash range."""
    got = [unpack(x) for x in table["packed"].to_pylist()]
    base = np.cumsum([0, *(len(g[1]) for g in got)])
    flat, size, h, place = (np.concatenate([g[i] for g in got]) for i in (0, 1, 2, 7))
    doc, text = (np.concatenate([g[i][g[6]] for g in got]) for i in (4, 5))
    number = np.concatenate([g[3] + n for g, n in zip(got, base[:-1], strict=True)])
    del got
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    code = ts.range_hashes(flat, begin, size)
    order = np.lexsort((code, h))
    same = np.cumsum(changes(code[order]) | changes(h[order])) - 1
    rank = np.empty(len(order), np.int64)
    rank[order] = same
    one = order[changes(same)]
    size, begin, h = size[one], begin[one], h[one]
    number = rank[number]
    use = np.argsort(number, kind="stable")
    number, doc, text, place = number[use], doc[use], text[use], place[use]
    first = np.searchsorted(number, np.arange(len(one) + 1))
    low, high = np.minimum.reduceat(doc, first[:-1]), np.maximum.reduceat(doc, first[:-1])
    upto = np.concatenate(([0], np.cumsum(size - LENGTH + 1)))
    edge = np.append(np.flatnonzero(changes(h)), len(h))
    out: list[list[np.ndarray]] = []
    i = 0
    while i < len(h):
        k = max(int(np.searchsorted(upto[edge], upto[i] + WINDOWS, side="right")) - 1, int(np.searchsorted(edge, i, side="right")))
        j = int(edge[k])
        n = size[i:j]
        part = flat[np.repeat(begin[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ctx, rel, length, least = needed(*repeats_in(part, n, low[i:j], high[i:j]))
        ctx = ctx + i
        m = first[ctx + 1] - first[ctx]
        o = np.repeat(first[ctx] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        ok = doc[o] > np.repeat(least, m)
        o, rel, length = o[ok], np.repeat(rel, m)[ok], np.repeat(length, m)[ok]
        order = np.lexsort((rel, o))
        k0, s0, e0 = union(o[order], rel[order], (rel + length)[order])
        out.append([doc[k0], text[k0], place[k0] + s0, e0 - s0])
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def marked(packed: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, mark, starts, ends) of every document with marks, merged."""
    ddl = "part int, packed binary"

    def mark(table: pa.Table) -> pa.Table:
        doc, text, place, size = marks_of(table)
        trim()
        part = (ts.mix(doc.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order, bounds = cut_by(part, ranges)
        parts = np.flatnonzero(np.diff(bounds))
        blobs = [pack(doc[o], text[o], place[o], size[o].astype(np.uint8)) for p in parts.tolist() for o in [order[bounds[p] : bounds[p + 1]]]]
        return pa.table({"part": pa.array(parts.astype(np.int32)), "packed": pa.array(blobs, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        doc, text, start, size = (np.concatenate(x) for x in zip(*[unpack(x) for x in table["packed"].to_pylist()], strict=True))
        order = np.lexsort((text, doc))
        doc, text, start, size = doc[order], text[order], start[order], size[order].astype(np.int64)
        key = np.cumsum(changes(doc) | changes(text)) - 1
        head = np.flatnonzero(changes(key))
        key, s, e = union(key, start, start + size)
        bounds = np.searchsorted(key, np.arange(len(head) + 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))
        return pa.table({"doc_id": pa.array(doc[head]), "mark": pa.array(text[head]), "starts": lists(s), "ends": lists(e)})

    return packed.groupBy("part").applyInArrow(mark, ddl).groupBy("part").applyInArrow(merge, "doc_id long, mark long, starts array<long>, ends array<long>")


def _key(doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return ts.mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mark.astype(np.int64).view(np.uint64))


def _result(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    gone = int((ends - starts).sum())
    if gone:
        at, kept = 0, []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            kept.append(raw[at:s])
            at = e
        raw, size = b"".join([*kept, raw[at:]]), len(raw)
    else:
        size = len(raw)
    return size, gone, len(starts) if gone else 0, hashlib.sha256(raw).hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): bytes, bytes removed, removed runs, and the digest of what is left.

    A null text counts as empty; a text under LENGTH bytes loses nothing; one of any length is read whole. Rows of one doc_id never take
    from each other, each is judged by its own text (rows are told apart by id and a 64-bit hash of the text), so that repeated rows
    fare alike. Of equal passages the one in the smallest doc_id stays. A row without doc_id takes nothing and loses nothing. An empty table
    gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("__mark"))
    known = docs.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = RANGES[0]
    while ranges < RANGES[1] and ranges * RANGE_BYTES < size:
        ranges *= 2
    codes = saved(shared_anchors(known, ranges), "anchors")
    gone = saved(marked(contexts(known, bloom(codes, "code", BLOOM_BITS), ranges), ranges), "marks")
    has = docs.sparkSession.sparkContext.broadcast(bloom(_keyed(gone), "key"))

    def split(wanted: bool):
        def make():
            filt = has.value

            def step(keys, texts):
                ids = keys[0].fill_null(0).to_numpy(zero_copy_only=False)
                hit = in_bloom(filt, _key(ids, keys[1].to_numpy(zero_copy_only=False))) & keys[0].is_valid().to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(hit == wanted)
                for i in range(0, len(rows), 1000):
                    part = rows[i : i + 1000]
                    if wanted:
                        yield [keys[0].take(part), keys[1].take(part), texts.take(part)]
                    else:
                        none = np.zeros(0, np.int64)
                        yield [keys[0].take(part), *map(list, zip(*[_result(x.encode(), none, none) for x in texts.take(part).to_pylist()], strict=True))]

            return step

        return map_text(docs, ["doc_id", "__mark"], make, "doc_id long, mark long, text string" if wanted else OUT)

    schema = arrow_schema(OUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                rows = []
                for x, s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    rows.append(_result(x.encode(), np.array(s or [], np.int64), np.array(e or [], np.int64)))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    touched = split(True).join(gone, ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(cut, OUT)
    return split(False).unionByName(touched)


def _keyed(gone: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(b.column(0).to_numpy(), b.column(1).to_numpy()).view(np.int64))], names=["key"])

    return gone.select("doc_id", "mark").mapInArrow(run, "key long")
