"""Content-addressed store of token ids.

Every document's id stream is cut where a rolling hash over the last WINDOW ids meets a pattern (content-defined chunking).
A chunk is addressed by its BLAKE2b digest and stored once, whatever documents it occurs in. A document's recipe names its
chunks in order; its Merkle root is built over their digests. Recipes lie in ascending doc_id order, each with the position
of its first id in the whole stream; the manifest names the roots of all recipe files and one root over them.

Format, under one folder:
  chunks/     Parquet, zstd: digest binary(16), n int, held (whether the row has the ids: one row of a digest), ids binary
              (little-endian unsigned 16- or 32-bit, see manifest; else null), at array<struct<doc_id, row, nth>> (where it occurs)
  recipes/    Parquet, zstd, files (part) in ascending doc_id order: doc_id, row, n_tokens, start (in its file),
              chunks array<struct<digest, n>>, root
  manifest/   JSON: tokenizer digest, id width, number of chunks and a sum of their digests, for each recipe file its ids,
              documents and root, and the root over these

Reading checks every chunk against its digest, every recipe against its Merkle root, the recipe files against the manifest, and
the manifest's root. A document with a chunk that is missing or damaged is not verified; a recipe file that is missing, or chunks
that no manifest knows of, are errors.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import arrow_schema, ship
from leafmill.llm.scratch import new_path

END_ID = 2
WINDOW = 16
#: Chunks have about MEAN ids, at least LEAST and at most MOST; a document's last one may be shorter.
MEAN, LEAST, MOST = 1024, 256, 4096
#: Encoded pieces of text that a worker remembers, the first that it meets (about 25 MB); others are encoded each time.
CACHE = 1_200_000
RECENT = 100_000
#: Chunks of which a task remembers that it has sent them.
SENT = 300_000
#: Documents whose chunks are sent together.
GROUP = 512
#: Ids per recipe file, roughly.
RECIPE_ROWS = 200_000
GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 2**32, 1 << 16, dtype=np.uint64).astype(np.uint32)
#: White space other than the space and the newline; bytes that may begin it beyond ASCII.
OTHER = np.zeros(256, dtype=bool)
OTHER[[9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F]] = True
MAY_BE_SPACE = re.compile(r"[^\S \n]")
BREAK = np.zeros(256, dtype=bool)
BREAK[[0x20, 0x0A]] = True


def odd_documents(b: ts.Block) -> np.ndarray:
    """Documents whose white space is not made of single spaces and up to two newlines between visible characters.

    In all others the tokenizer's own first step parts the text before each single space and around each newline, so that
    the pieces there can be encoded by themselves.
    """
    d, n = b.data, len(b.data)
    odd = np.zeros(len(b.offsets) - 1, dtype=bool)
    if not n:
        return odd
    last = np.zeros(n + 2, dtype=bool)  # the next byte belongs to another document
    last[b.offsets[1:] - 1] = True
    last = last[:n]
    space, line = d == 0x20, d == 0x0A
    after = np.append(BREAK[d][1:], True)
    bad = OTHER[d] | (space & (after | last)) | (line & ~last & np.append(space[1:], False))
    two = line & np.append(line[1:], False) & ~last
    end2 = np.append(last[1:], True)
    bad |= two & (end2 | np.append(line[2:], [False, False])[:n] & ~end2)
    at = np.flatnonzero(bad)
    odd[np.searchsorted(b.offsets, at, side="right") - 1] = True
    raw = b.data.tobytes()
    wide = np.flatnonzero((d == 0xC2) | (d == 0xE1) | (d == 0xE2) | (d == 0xE3))  # first bytes of wider white space
    for i in np.unique(np.searchsorted(b.offsets, wide, side="right") - 1).tolist():
        if not odd[i] and MAY_BE_SPACE.search(raw[b.offsets[i] : b.offsets[i + 1]].decode("utf-8", "replace")):
            odd[i] = True
    return odd


def _inserted(held: tuple, more: tuple) -> tuple:
    """Columns ordered by the first, with more rows, in order too, put in their places."""
    at = np.searchsorted(held[0], more[0])
    return tuple(np.insert(x, at, y) for x, y in zip(held, more, strict=True))


class Encoder:
    """Whole texts to ids. Pieces between single spaces and newlines are encoded once and remembered by fingerprint."""

    def __init__(self, vocabulary: bytes, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = special_as_text
        words = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(words) <= 1 << 16 else np.dtype("<u4")
        self.bytes = np.zeros(max(words.values()) + 1, dtype=np.int64)  # of each id's text: a character stands for a byte
        for x, i in words.items():
            self.bytes[i] = len(x)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if special_as_text else [t.content.encode() for t in added]  # where they stand, the text is parted first
        self.flat = np.zeros(1 << 16, dtype=self.kind)
        self.used = 0
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.old, self.new = none, none  # fingerprints in order, first ids in flat, numbers of ids

    def _add(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(1 << 20, len(ids)), dtype=self.kind)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _pieces(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces; where their ids lie in flat, and how many."""
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        led = np.array([raw[i] == 0x20 for i in start.tolist()], dtype=bool)
        spaced = np.flatnonzero(led)
        for k in range(0, len(spaced), 5000):  # pieces that begin with a space stay apart when they are put together
            part = spaced[k : k + 5000]
            text = b"".join(raw[i:j] for i, j in zip(start[part].tolist(), end[part].tolist(), strict=True)).decode("utf-8")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(end[part] - start[part])) + 1
            first = np.concatenate(([0], ends[:-1]))
            at[part], n[part] = self._add(ids) + first, ends - first
        for k in np.flatnonzero(~led).tolist():
            ids = self.tokenizer.encode(raw[start[k] : end[k]].decode("utf-8"), add_special_tokens=False).ids
            at[k], n[k] = self._add(np.array(ids, dtype=self.kind)), len(ids)
        return at, n

    def encode(self, b: ts.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's documents one after another, and where each document's begin."""
        n_docs = len(b.offsets) - 1
        odd = odd_documents(b)
        raw = b.data.tobytes()
        for x in self.special:
            k = raw.find(x)
            while k >= 0:
                odd[np.searchsorted(b.offsets, k, side="right") - 1] = True
                k = raw.find(x, k + 1)
        whole = np.flatnonzero(odd)
        w = ts.words(b, ts.TABLE, BREAK)
        lines = np.flatnonzero(b.data == 0x0A)
        start = np.concatenate([w.start, lines])
        end = np.concatenate([w.end, lines + 1])
        doc = np.concatenate([w.doc, np.searchsorted(b.offsets, lines, side="right") - 1])
        h = np.concatenate([w.hash, np.full(len(lines), 10, dtype=np.uint64)])
        if len(w.start):
            led = (w.start > b.offsets[w.doc]) & (b.data[np.maximum(w.start - 1, 0)] == 0x20)
            start[: len(led)] -= led
            h[: len(led)] ^= np.where(led, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        keep = ~odd[doc]
        order = np.argsort(start[keep], kind="stable")
        start, end, doc, h = (x[keep][order] for x in (start, end, doc, h))
        mark = self.used
        u, first, number = np.unique(h, return_index=True, return_inverse=True)
        at, n = np.zeros(len(u), np.int64), np.full(len(u), -1)
        for keys, places, sizes in (self.old, self.new):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                ok = keys[i] == u
                at[ok], n[ok] = places[i[ok]], sizes[i[ok]]
        miss = np.flatnonzero(n < 0)
        if len(miss):
            at[miss], n[miss] = self._pieces(raw, start[first[miss]], end[first[miss]])
        full = len(self.old[0]) + len(self.new[0]) + len(miss) > CACHE
        if len(miss) and not full:
            self.new = _inserted(self.new, (u[miss], at[miss].astype(np.int32), n[miss].astype(np.int32)))
            if len(self.new[0]) > RECENT:
                self.old, self.new = _inserted(self.old, self.new), tuple(x[:0].copy() for x in self.new)
        sizes = n[number]
        ids = self.flat[np.repeat(at[number] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        counts = np.bincount(doc, weights=sizes, minlength=n_docs).astype(np.int64)
        if full:
            self.used = mark
        if len(whole):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            texts = [raw[b.offsets[i] : b.offsets[i + 1]].decode("utf-8") for i in whole.tolist()]
            for i, e in zip(whole.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, dtype=self.kind)
            counts[whole] = [len(parts[i]) for i in whole.tolist()]
            ids = np.concatenate(parts)
        return ids, np.concatenate(([0], np.cumsum(counts)))


_encoders: dict[tuple[bytes, bool], Encoder] = {}


def encoder(vocabulary: bytes, special_as_text: bool = False) -> Encoder:
    """This process's encoder for a vocabulary file's content; workers keep it from task to task."""
    key = hashlib.sha256(vocabulary).digest(), special_as_text
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, special_as_text)
    return _encoders[key]


def cuts(ids: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Chunk ends of one id stream, the last being its length."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    h = GEAR[ids & 0xFFFF].astype(np.uint32)
    mul = 0x2C9277B5
    step, power = 1, mul
    while step < WINDOW:  # h covers the last `step` ids; join it with the step before
        older = h[:-step] * np.uint32(power)
        h = h.copy()
        h[step:] += older
        power = power * power % 2**32
        step *= 2
    at = np.flatnonzero(h >> np.uint32(32 - (mean - least).bit_length() + 1) == 0) + 1
    out, last, i = [], 0, 0
    while last < n:
        i = int(np.searchsorted(at, last + least))
        end = min(int(at[i]) if i < len(at) else n, last + most, n)
        out.append(end)
        last = end
    return out


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is, and no leaf gives the digest of nothing."""
    if not leaves:
        return digest(b"")
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        pairs = [digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def chunk_rows(docs: DataFrame, end_id: int, vocabulary) -> DataFrame:
    """digest, n, ids and where they occur, as (doc_id, row, nth): per task one row with ids for a chunk, then ids are null.

    row tells rows of one doc_id apart. Occurrences are packed by document batch, so a chunk that is everywhere makes a
    few rows a task, not one a document.
    """
    ddl = "digest binary, n int, ids binary, at array<struct<doc_id:long,row:long,nth:int>>"
    schema = arrow_schema(ddl)
    at_type = schema.field("at").type
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        sent: set[bytes] = set()
        row = TaskContext.get().partitionId() << 40
        for batch in (b.slice(i, GROUP) for b in batches for i in range(0, b.num_rows, GROUP)):
            found: dict[bytes, tuple[int, bytes | None, list]] = {}
            doc_ids = batch.column(0).to_pylist()
            for b in ts.blocks(batch.column(1), 1 << 20):
                ids, bounds = enc.encode(b)
                for i in range(len(bounds) - 1):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], enc.kind.type(end_id))
                    data, a = own.tobytes(), 0
                    for nth, z in enumerate(cuts(own)):
                        part = data[a * enc.kind.itemsize : z * enc.kind.itemsize]
                        d = digest(part)
                        if d not in found:
                            found[d] = (z - a, None if d in sent else part, [])
                            sent.add(d)
                        found[d][2].append((doc_ids[b.first + i], row, nth))
                        a = z
                    row += 1
            if len(sent) > SENT:
                sent.clear()
            rows = list(found.values())
            ends = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).astype(np.int32)
            places = [pa.array(c, f.type) for c, f in zip(zip(*[x for r in rows for x in r[2]], strict=True), at_type.value_type, strict=True)] if rows else [pa.array([], f.type) for f in at_type.value_type]
            at = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(places, fields=list(at_type.value_type)), type=at_type)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), at], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def _finished(recipes: DataFrame) -> DataFrame:
    """Ordered recipes with the place of their first id in their file and the Merkle root over their chunks' digests."""
    ddl = "part int, doc_id long, row long, n_tokens long, chunks array<struct<digest:binary,n:int>>, start long, root binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            n = b.column(3).to_numpy()
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            roots = [merkle([c["digest"] for c in x]) for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(b.columns, schema, strict=False)], pa.array(start), pa.array(roots, pa.binary())], schema=schema)

    return recipes.select("part", "doc_id", "row", "n_tokens", "chunks").mapInArrow(run, ddl)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes docs (doc_id, text) to the store at path.

    A null text counts as empty: its stream is the end id alone. Rows of one doc_id are documents of their own, in the
    order in which they were read; a null doc_id comes first. A text of any length is cut into chunks of at most MOST ids. Equal
    texts share their chunks. Other columns are not read. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    raw = chunk_rows(docs, end_id, spark.sparkContext.broadcast(vocabulary))  # a vocabulary file: a few megabytes
    # one row with ids for each digest: those that have them meet, at most one for a task and digest (and for SENT chunks of a
    # task); the others, which only say where a chunk occurs, are spread by their first place, however common the chunk is
    raw = raw.withColumn("__spread", F.when(F.col("ids").isNull(), F.xxhash64(F.element_at("at", 1))).otherwise(F.lit(0).cast("long")))
    bound = Window.partitionBy("digest", "__spread").orderBy(F.element_at("at", 1))
    held = (F.row_number().over(bound) == 1) & F.col("ids").isNotNull()
    raw.withColumn("held", held).select("digest", "n", "held", F.when(F.col("held"), F.col("ids")).alias("ids"), "at").write.option("compression", "zstd").parquet(f"{path}/chunks")
    kept = spark.read.parquet(f"{path}/chunks")
    flat = kept.select(F.explode("at").alias("at"), "digest", "n").select("at.*", "digest", "n")
    recipe = flat.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "n"))).alias("c"))
    recipe = recipe.select("doc_id", "row", F.transform("c", lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("chunks"))
    recipe = recipe.withColumn("n_tokens", F.aggregate("chunks", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    parts = max(1, -(-docs.count() // RECIPE_ROWS))
    recipe = recipe.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    recipe = recipe.withColumn("part", F.spark_partition_id())
    _finished(recipe).write.option("compression", "zstd").parquet(f"{path}/recipes")
    files = part_roots(spark.read.parquet(f"{path}/recipes"))
    manifest = {
        "tokenizer_sha256": hashlib.sha256(vocabulary).hexdigest(), "end_id": end_id, "files": files, "chunks": chunk_sum(kept),
        "id_bytes": encoder(vocabulary).kind.itemsize, "root": merkle([bytes.fromhex(x["root"]) for x in files]).hex(),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def chunk_sum(chunks: DataFrame) -> list[int]:
    """Number of held chunks, and two sums over their digests that do not depend on order."""
    held = chunks.where("held").select(F.xxhash64("digest").alias("a"), F.xxhash64("digest", F.lit(1)).alias("b"))
    r = held.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).first()
    return [r["n"], r["a"] or 0, r["b"] or 0]


def part_roots(recipes: DataFrame) -> list[dict]:
    """Ids, documents and Merkle root of each recipe file in order; a row for each file reaches the driver."""
    ddl = "part int, ids long, docs long, root string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, docs, level = None, 0, 0, hashlib.blake2b(digest_size=16)
        out = []
        for b in batches:
            for p, n, r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part and part is not None:
                    out.append((part, ids, docs, level.hexdigest()))
                    ids, docs, level = 0, 0, hashlib.blake2b(digest_size=16)
                part, ids, docs = p, ids + n, docs + 1
                level.update(r)
        if part is not None:
            out.append((part, ids, docs, level.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ordered = recipes.select("part", "n_tokens", "root", "doc_id", "row").repartition("part").sortWithinPartitions("part", "doc_id", "row")
    got = ordered.select("part", "n_tokens", "root").mapInArrow(run, ddl).toArrow().to_pylist()
    return sorted(got, key=lambda x: x["part"])


#: x^(2^k) modulo the polynomial of CRC-32, bits reversed.
POLY = 0xEDB88320


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 32-bit polynomials modulo POLY."""
    out = np.zeros(len(b), dtype=np.uint32)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1) == 1, b, np.uint32(0))
        b = np.where(b & np.uint32(1) == 1, (b >> np.uint32(1)) ^ np.uint32(POLY), b >> np.uint32(1))
    return out


def crc_shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the CRC-32 of some bytes adds to the CRC-32 of a text in which n bytes follow them."""
    crc, bits = crc.astype(np.uint32), n.astype(np.uint64) * np.uint64(8)
    power = np.array([1 << 30], dtype=np.uint32)  # x
    for k in range(64):
        left = bits >> np.uint64(k)
        if not left.any():
            break
        on = np.flatnonzero(left & np.uint64(1))
        crc[on] = _multiply(np.repeat(power, len(on)), crc[on])
        power = _multiply(power, power)
    return crc


def read_manifest(spark: SparkSession, path: str) -> dict:
    m = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if merkle([bytes.fromhex(x["root"]) for x in m["files"]]).hex() != m["root"]:
        raise ValueError("the manifest does not agree with its root")
    return m


def _checked(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, set[int], bool]:
    """The manifest, chunks and recipes of a store, the recipe files as the manifest has them, and whether the chunks are all.

    Recipe files that are missing or not in the manifest, and chunks that are in no recipe or there twice, are errors.
    """
    m = read_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    recipes = spark.read.parquet(f"{path}/recipes")
    want, have = {x["part"]: x for x in m["files"]}, {x["part"]: x for x in part_roots(recipes)}
    if set(want) != set(have):
        raise ValueError(f"recipe files that are missing: {sorted(set(want) - set(have))}, that the manifest does not name: {sorted(set(have) - set(want))}")
    whole = chunk_sum(chunks) == m["chunks"]
    if not whole:
        held = chunks.where("held").groupBy("digest").count()
        used = recipes.select(F.explode("chunks.digest").alias("digest")).distinct()
        if held.where("count > 1").limit(1).count() or held.join(used, "digest", "left_anti").limit(1).count():
            raise ValueError("chunks that are there twice or in no recipe")
    return m, chunks.where("held").select("digest", "ids"), recipes, {p for p, x in want.items() if have[p] == x}, whole


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified for each document, from the files alone.

    Every chunk's ids are read, held against their digest, and summed up; a document's checksum is put together from those
    of its chunks in the recipe's order, and is null if one of them is missing. verified says that all are there and intact, that
    the recipe has its Merkle root and its file the manifest's. Of rows of one doc_id each has its row; an empty store has none.
    """
    m, held, recipes, good_files, _ = _checked(spark, path)
    kind = np.dtype("<u2") if m["id_bytes"] == 2 else np.dtype("<u4")
    chunk_ddl = "digest binary, size int, crc long, good boolean"
    chunk_schema = arrow_schema(chunk_ddl)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, dtype=kind).astype("<u4").tobytes()) for x in ids]
            good = [digest(x) == d for x, d in zip(ids, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // kind.itemsize for x in ids], pa.int32()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], schema=chunk_schema)

    chunks = held.mapInArrow(sums, chunk_ddl)
    base, at = {}, 0
    for x in m["files"]:
        base[x["part"]] = at
        at += x["ids"]
    use_ddl = "doc_id long, row long, start long, n_tokens long, intact boolean, digest binary, n int, after long"
    use_schema = arrow_schema(use_ddl)

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                intact = r["part"] in good_files and merkle([c["digest"] for c in r["chunks"]]) == r["root"]
                after = r["n_tokens"]
                for c in r["chunks"]:
                    after -= c["n"]
                    rows.append((r["doc_id"], r["row"], base[r["part"]] + r["start"], r["n_tokens"], intact, c["digest"], c["n"], after))
            cols = list(zip(*rows, strict=True)) or [()] * len(use_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, use_schema, strict=True)], schema=use_schema)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = crc_shift(b.column(5).to_numpy(), b.column(6).to_numpy() * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(crc), b.column(7)], names=["doc_id", "row", "start", "n_tokens", "good", "crc", "there"])

    met = recipes.mapInArrow(uses, use_ddl).join(chunks, "digest", "left")
    good = F.coalesce(F.expr("good and intact and size = n"), F.lit(False))
    met = met.select("doc_id", "row", "start", "n_tokens", good.alias("good"), F.coalesce("crc", F.lit(0)).alias("crc"), "after", F.col("crc").isNotNull().alias("there"))
    met = met.mapInArrow(shift, "doc_id long, row long, start long, n_tokens long, good boolean, crc long, there boolean")
    out = met.groupBy("doc_id", "row", "start", "n_tokens").agg(F.bit_xor("crc").alias("crc"), F.min("there").alias("there"), F.min("good").alias("verified"))
    return out.select("doc_id", "start", "n_tokens", F.when(F.col("there"), F.col("crc")).alias("ids_crc32"), "verified")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array<int>) of each document, put together from the store.

    Nothing is given out unchecked: a chunk that is missing, surplus or damaged, or a recipe that is not what the manifest names, is
    an error, when the store is opened or when the rows are read. An empty store has no rows; rows of one doc_id each have theirs.
    """
    m, held, files, good_files, whole = _checked(spark, path)
    if not whole or good_files != {x["part"] for x in m["files"]}:
        raise ValueError("chunks are missing or recipe files differ from the manifest")
    kind = np.dtype("<u2") if m["id_bytes"] == 2 else np.dtype("<u4")
    ddl = "doc_id long, start long, ids array<int>"
    schema = arrow_schema(ddl)
    base, at = {}, 0
    for x in m["files"]:
        base[x["part"]] = at
        at += x["ids"]
    recipes = files.select("part", "doc_id", "row", "start", "root", F.posexplode("chunks").alias("nth", "c"))
    met = recipes.join(held, F.col("c.digest") == F.col("digest"), "left").select("part", "doc_id", "row", "start", "root", "nth", F.col("c.digest").alias("digest"), F.col("c.n").alias("n"), "ids")
    rows = met.groupBy("part", "doc_id", "row", "start", "root").agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "n", "ids"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for c, root in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True):
                if any(x["ids"] is None or len(x["ids"]) != x["n"] * kind.itemsize or digest(x["ids"]) != x["digest"] for x in c) or merkle([x["digest"] for x in c]) != root:
                    raise ValueError("a chunk is missing or damaged, or a recipe is not that of its root")
                ids.append(np.frombuffer(b"".join(x["ids"] for x in c), dtype=kind).astype(np.int32))
            start = [base[p] + v for p, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(start, pa.int64()), pa.array(ids, schema.field("ids").type)], schema=schema)

    return rows.select("part", "doc_id", "start", "root", "c").mapInArrow(run, ddl)


def store_and_index(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads its index back; see write_store for odd rows, read_index for the result."""
    path = new_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, end_id)
    return read_index(docs.sparkSession, path)
