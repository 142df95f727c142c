"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its rows. A source's target says how many whole passes over its blocks the
mix takes and how many blocks of one more pass. What is then left is less than any other block: a few of these are cut into cells by
further bits of the hash, cells that fit are taken whole, a few of the others are cut again, down to single rows, the last of
which is the one that comes nearest. The block draws are dealt to output shards down a binary tree: each node splits its
exact counts per source between its halves by a multivariate hypergeometric draw. Each shard then gets its own slice of each
source's permuted draws, and orders its rows by a hash.

Texts are counted once; the sizes are kept as a table. Only sums by block and cell reach the driver: about BLOCK_ROWS of blocks, or
LEAST_BLOCKS a source where there are more sources, and CUT * CELLS of cells a source and level, however many documents there are.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import saved

#: Blocks of a source at most and at least, blocks in all, and the rows that a block of a small table should have.
BLOCKS, LEAST_BLOCKS, BLOCK_ROWS = 256, 4, 1 << 16
ROWS_PER_BLOCK = 1000
MAX_REPEATS = 3
SHARD_WORDS = 4_000_000
#: Blocks and cells of a source that are cut at each level, the cells of each (a power of two), and levels at most.
CUT, BITS, LEVELS = 4, 8, 7
CELLS = 1 << BITS
#: Control rows up to which the plan is broadcast; a larger one is joined by shuffle on (source, block).
BROADCAST_ROWS = 200_000
SEED = 17


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"), F.lit(SEED))


def sized(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, source, size (words; 0 for null), h (hash of id and text) and block of each row, as a table; and the number of blocks.

    Small tables get fewer, fuller blocks, and so do many sources.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), row_hash().alias("h")), "sizes")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("source").alias("sources")).first()
    blocks = min(BLOCKS, max(LEAST_BLOCKS, n["rows"] // ROWS_PER_BLOCK), max(LEAST_BLOCKS, BLOCK_ROWS // max(1, n["sources"])))
    return rows.withColumn("block", block_of(F.col("h"), blocks)), blocks


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def cell(h: Column, level: int) -> Column:
    """A row's cell at a level from 1 on: the leading bits of another hash of its hash, and the level."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(h, F.lit(SEED)), 64 - BITS * level), 4).bitwiseOR(F.lit(level))


def targets(sizes: dict[str | None, int], max_repeats: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: weights 1, 2, 3 repeating by code point, null last, capped at max_repeats times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    rest, free = float(sum(sizes.values())), list(names)
    while free:
        each = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * each > max_repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * each for s in free}
        for s in over:
            out[s] = float(max_repeats * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


class Draw(NamedTuple):
    source: str | None
    block: int
    shard: int
    nth: int  # which pass over the source
    left: float | None  # words still wanted, for the blocks of a source that are cut


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact counts per source dealt to shards down a binary tree, as (shards, sources)."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    todo = [(0, shards, counts)]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        n = int(have.sum())
        left = rng.multivariate_hypergeometric(have, round(n * (mid - lo) / (hi - lo)), method="marginals") if n else have
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def draws(blocks: dict[str | None, dict[int, int]], target: dict[str | None, float], shards: int, seed: int = SEED) -> list[Draw]:
    """Every (source, block) draw of the mix with its shard; blocks: words by source and block."""
    names = sorted(blocks, key=lambda s: (s is None, s or ""))
    lists = []
    for s in names:
        own = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"{seed}\0{s is None}\0{s}".encode()).digest()[:8], "little")))
        ids, total = sorted(blocks[s]), sum(blocks[s].values())
        whole = min(int(target[s] / total + 1e-9), MAX_REPEATS) if total else 0
        left = target[s] - whole * total
        got: list[tuple[int, int, float | None]] = [(int(b), nth, None) for nth in range(whole) for b in own.permutation(ids)]
        rest = []
        for b in own.permutation(ids):
            if blocks[s][b] <= left:
                got.append((int(b), whole, None))
                left -= blocks[s][b]
            else:
                rest.append(int(b))
        if left >= 0.5:  # less than any block left over: single rows of a few of them
            got += [(b, whole, left) for b in rest[:CUT]]
        lists.append(got)
    rng = np.random.Generator(np.random.PCG64(seed))
    dealt = split(np.array([len(x) for x in lists], dtype=np.int64), shards, rng)
    out = []
    for i, s in enumerate(names):
        order = rng.permutation(len(lists[i]))
        shard = np.repeat(np.arange(shards), dealt[:, i])
        out += [Draw(s, *(lists[i][k][0],), int(g), lists[i][k][1], lists[i][k][2]) for k, g in zip(order, shard, strict=True)]
    return out


class Plan(NamedTuple):
    sizes: dict[str | None, int]
    target: dict[str | None, float]
    draws: list[Draw]
    cells: dict[tuple[str | None, int], list[int]]  # the cells that are taken of a block that is cut
    shards: int
    blocks: int


def plan(rows: DataFrame, blocks_: int, shard_words: int = SHARD_WORDS) -> Plan:
    """The mix of sized() rows, from sums by block and, for the blocks that are cut, by cell."""
    blocks: dict[str | None, dict[int, int]] = {}
    for r in rows.groupBy("source", "block").agg(F.sum("size").alias("n")).toArrow().to_pylist():
        blocks.setdefault(r["source"], {})[r["block"]] = r["n"]
    sizes = {s: sum(b.values()) for s, b in blocks.items()}
    target = targets(sizes)
    shards = max(1, -(-sum(sizes.values()) // shard_words))
    got = draws(blocks, target, shards)
    return Plan(sizes, target, got, cut(rows, [(d.source, d.block) for d in got if d.left is not None], {d.source: d.left for d in got if d.left is not None}), shards, blocks_)


def cut(rows: DataFrame, whole: list[tuple[str | None, int]], left: dict[str | None, float]) -> dict[tuple[str | None, int], list[int]]:
    """The cells taken of some blocks, so that their words come to what is left of each source."""
    spark = rows.sparkSession
    taken: dict[tuple[str | None, int], list[int]] = {}
    last: dict[str | None, list[tuple[int, int, int]]] = {}  # of each source: cells of one hash, as (words, cell, block)
    open_ = [(s, b, 0) for s, b in whole]
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        table = spark.createDataFrame(open_, "s string, b int, c long")
        on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & ((cell(F.col("h"), level - 1) if level > 1 else F.lit(0).cast("long")) == F.col("c"))
        near = rows.join(F.broadcast(table) if len(open_) <= BROADCAST_ROWS else table, on)
        sums = near.groupBy("source", "block", cell(F.col("h"), level).alias("cell")).agg(F.sum("size").alias("n"), (F.min("h") == F.max("h")).alias("one")).where("n > 0")
        found: dict[str | None, list[tuple[int, int, int, bool]]] = {}
        for r in sums.toArrow().to_pylist():
            found.setdefault(r["source"], []).append((r["cell"], r["block"], r["n"], r["one"]))
        open_ = []
        for s, cells in found.items():
            rest = []
            for c, b, n, one in sorted(cells):
                if n <= left[s]:
                    taken.setdefault((s, b), []).append(c)
                    left[s] -= n
                elif one or level == LEVELS:
                    last.setdefault(s, []).append((n, c, b))
                else:
                    rest.append((s, b, c))
            if left[s] >= 0.5:
                open_ += rest[:CUT]
    for s, cells in last.items():  # one more row, if that comes nearer
        n, c, b = min(cells, key=lambda x: (abs(x[0] - left[s]), x))
        if abs(n - left[s]) < left[s]:
            taken.setdefault((s, b), []).append(c)
    return taken


def in_cells(h: Column) -> Column:
    """Whether a row of a block that is cut is in one of the cells taken."""
    return F.coalesce(F.arrays_overlap(F.col("__cells"), F.array(*[cell(h, i) for i in range(1, LEVELS + 1)])), F.lit(False))


def taken(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text, source): its size, its source's size and target, and the words the mix takes of it.

    A row is taken whole, 0 to 3 times. Null and empty texts have size 0 and are never taken; a null source is a source of
    its own, last in order. Repeated rows (of one id and text) are taken alike. A text of any length is a row like others: of a source
    whose rows are all longer than what is left, that much is missing, or less if one more row comes nearer. An empty table gives an empty
    result. Other columns are not read.
    """
    rows, blocks = sized(docs)
    p = plan(rows, blocks)
    counts: dict[tuple[str | None, int], int] = {}
    for d in p.draws:
        counts[d.source, d.block] = counts.get((d.source, d.block), 0) + (d.left is None)
    control = [(s, b, counts.get((s, b), 0), p.cells.get((s, b)), p.sizes[s], p.target[s]) for s in p.sizes for b in range(p.blocks)]
    table = docs.sparkSession.createDataFrame(control, "__s string, __b int, __n int, __cells array<long>, source_size long, target double")
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))
    met = rows.join(F.broadcast(table) if len(control) <= BROADCAST_ROWS else table, on)
    copies = F.col("__n") + in_cells(F.col("h")).cast("int")
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' columns, one row for each time that a row is taken, a shard to a partition, ordered by hash in each.

    Adds __shard (long) and __order (long) behind docs' columns, which are carried along unread, whatever their names; one that has
    either name itself takes its place. Rows without a word are left out; else see taken().
    """
    rows, blocks = sized(docs)
    p = plan(rows, blocks)
    draws_ = [(s, b, shard, nth, None if left is None else p.cells.get((s, b), [])) for s, b, shard, nth, left in p.draws]
    control = docs.sparkSession.createDataFrame(draws_, "__s string, __b int, __shard long, __nth int, __cells array<long>")
    some = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(some).select(F.col("source").cast("string").alias("__source"), row_hash().alias("__h"), F.struct(*docs.columns).alias("__row"))
    on = F.col("__source").eqNullSafe(F.col("__s")) & (block_of(F.col("__h"), p.blocks) == F.col("__b"))
    met = own.join(F.broadcast(control) if len(draws_) <= BROADCAST_ROWS else control, on).where(F.col("__cells").isNull() | in_cells(F.col("__h")))
    dealt = met.withColumn("__order", F.xxhash64("__h", "__nth", F.lit(SEED))).repartitionById(p.shards, F.col("__shard").cast("int")).sortWithinPartitions("__shard", "__order")
    extra = [c for c in ("__shard", "__order") if c not in docs.columns]
    return dealt.select("__row.*", *extra)
