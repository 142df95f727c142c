"""MinHash near-dedup: SuperMinHash signatures, banding, verification on whole sets, union-find grouping.

1. A pass over the texts gives each row its set's size and fingerprint and its signature's band hashes.
2. Rows with equal sets form a class, represented by its smallest doc_id. Only representatives go on.
3. Representatives that share a band hash share a bucket. Buckets are not expanded into pairs. First every member is paired
   with one pivot, the most central member (of the fullest buckets) that it shares a bucket with, then with a few more;
   pairs are verified on whole shingle sets and the links found are merged into components. A bucket whose members are all
   in one component is done. In a small bucket that is not, the pairs across components follow. In a large one the members
   outside its main component become a query set, which is held in blocks of bounded size against the sets of all members
   of such buckets by an inverted index; so no link is lost, and no group's pairs are ever rows.
4. Components: a union-find in each partition shrinks the links to a forest; large-star and small-star steps turn what is left
   into stars, each a component around its least member.

Tables between steps are written to the shared folder. Nothing about single documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import arrow_schema, lists, map_text, ship
from leafmill.llm.scratch import bloom, in_bloom, new_path, saved
from leafmill.llm.superminhash import bands, signatures

WORDS = 5
#: 32 bands of 4 rows miss a pair of similarity 0.75 with probability 5e-6.
SLOTS, ROWS = 128, 4
SIMILARITY = (75, 100)
#: Pivots that a bucket names in the second round.
PIVOTS = 3
#: Members of the largest bucket whose pairs across components are joined.
SMALL = 32
#: Ids up to which a list of documents is broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of shingles in one block of the query set.
QUERY_BYTES = 16_000_000


def shingle_sets(b: ts.Block) -> tuple[np.ndarray, np.ndarray]:
    return ts.shingles(ts.words(b, ts.TABLE_LOWER), WORDS)


def fingerprints(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit fingerprint of each set."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for key in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAF3C7B2E1D5F96B)):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(ts.mix(h ^ key), dtype=np.uint64)))
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return np.diff(bounds), out[0].view(np.int64), out[1].view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprint), bands (empty for an empty set) of each row."""

    def make():
        def step(keys, texts):
            for b in ts.blocks(texts):
                n_docs = len(b.offsets) - 1
                doc, h = shingle_sets(b)
                n, f1, f2 = fingerprints(doc, h, n_docs)
                full = n > 0
                sig = bands(signatures(doc, h, n_docs, SLOTS), ROWS)[full]
                ends = np.concatenate(([0], np.cumsum(full))) * sig.shape[1]
                yield [keys[0].slice(b.first, n_docs), n, f1, f2, lists(sig.ravel().view(np.int64), ends, pa.int64())]

        return step

    return map_text(docs, ["doc_id"], make, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def once(rows: DataFrame, again: DataFrame, id_: str, f: str) -> DataFrame:
    """rows with one row of each (id_, f), where again (id, f1) has those that there are more of: only these are aggregated."""
    same = (F.col(id_) == F.col("__id")) & (F.col(f) == F.col("__f"))
    many = again.select(F.col("id").alias("__id"), F.col("f1").alias("__f"))
    return rows.join(many, same, "left_anti").unionByName(rows.join(many, same, "left_semi").dropDuplicates([id_, f]))


def sets_of(docs: DataFrame, wanted: DataFrame, again: DataFrame) -> DataFrame:
    """id, f1 and the sorted shingle set of the rows named by wanted (id, f1, key), key a hash of both; again as in once().

    A bounded Bloom filter keeps the other rows' sets from being shuffled; an exact join follows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "key"))

    def make():
        filt = shared.value

        def step(keys, texts):
            for b in ts.blocks(texts):
                n_docs = len(b.offsets) - 1
                doc, h = shingle_sets(b)
                _, f1, _ = fingerprints(doc, h, n_docs)
                ids = keys[0].slice(b.first, n_docs)
                raw = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = in_bloom(filt, ts.mix(raw.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ f1.view(np.uint64))) & ids.is_valid().to_numpy(zero_copy_only=False)
                bounds = np.searchsorted(doc, np.arange(n_docs + 1))
                keep = hit[doc]
                ends = np.concatenate(([0], np.cumsum(np.diff(bounds)[hit])))
                yield [raw[hit], f1[hit], lists(h[keep].view(np.int64), ends, pa.int64())]

        return step

    got = map_text(docs, ["doc_id"], make, "sid long, sf long, items array<long>")
    got = got.join(wanted.select("id", "f1"), (F.col("sid") == F.col("id")) & (F.col("sf") == F.col("f1")), "left_semi")
    return got if again.isEmpty() else once(saved(got, "sets"), again, "sid", "sf")


def _key(ids: DataFrame) -> DataFrame:
    """ids (id, f1) with the hash that sets_of computes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, f = (x.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            k = ts.mix(a * np.uint64(0x9E3779B97F4A7C15) ^ f)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(k.view(np.int64))], names=["id", "f1", "key"])

    return ids.select("id", "f1").mapInArrow(run, "id long, f1 long, key long")


def forest(edges: DataFrame) -> DataFrame:
    """Links (a, b) shrunk by a union-find in each partition to at most one link a member: (a, b), b the least of its tree."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
        names = np.array(list(up), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.array([root(int(x)) for x in names], dtype=np.int64))], schema=schema)

    return edges.select("a", "b").mapInArrow(run, ddl).where("a <> b")


def stars(links: DataFrame) -> bool:
    """Whether each id of links (a, b), b below a, is either linked to one other or others are linked to it."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every id on a link (a, b) but the roots: root is the least id that can be reached."""
    e = saved(forest(edges).distinct(), name)
    while not stars(e):
        # large star: larger neighbours of each id are linked to its least neighbour (or itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of each id, and the id, are linked to the least of them
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = saved(small, name)
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


def linked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) with a similarity of their sets of at least similarity[0] / similarity[1], on whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    part, whole = similarity
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(right.withColumn("ny", F.size("y")), "b").join(left.withColumn("nx", F.size("x")), "a")
        .where(F.col("nx") * whole >= F.col("ny") * part).where(F.col("ny") * whole >= F.col("nx") * part)
        .where(whole * common >= part * (F.col("nx") + F.col("ny") - common))
        .select("a", "b").distinct()
    )


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) as (a, b) with a < b."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")


def split_buckets(open_: DataFrame, root: DataFrame) -> DataFrame:
    """The buckets whose members are in more than one component, with each member's component."""
    now = open_.drop("root").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return saved(now.join(split, "bucket", "left_semi"), "open")


def central(open_: DataFrame, n: int) -> DataFrame:
    """(bucket, x, xr): up to n members of each bucket with their components, the most central one of each n-th of its ids."""
    nth = F.pmod(F.xxhash64("id"), F.lit(n))
    picks = [F.max_by(F.struct(F.col("id").alias("x"), F.col("root").alias("xr")), F.when(nth == i, F.struct("rank", -F.col("id")))).alias(f"p{i}") for i in range(n)]
    got = open_.groupBy("bucket").agg(*picks).select("bucket", F.explode(F.array_compact(F.array(*[f"p{i}" for i in range(n)]))).alias("p"))
    return got.select("bucket", "p.*")


def searched(open_: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (a, b) across components within crowded buckets (bucket, id, root).

    Any such pair has a member outside its bucket's main component. Those members are the query set; blocks of it, of at
    most QUERY_BYTES, are indexed by shingle and met with the sets of all members, which counts what each pair has in common.
    Each block's links are written as they are found.
    """
    spark = sets.sparkSession
    mass = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = mass.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    asked = open_.join(main, "bucket").where("root <> main").select("id").distinct()
    asked_sets = sets.join(asked, F.col("sid") == F.col("id"), "left_semi").select("sid", "items")
    bytes_ = asked_sets.agg(F.sum(F.size("items") * 8)).first()[0]
    if not bytes_:
        return spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    blocks = -(-bytes_ // QUERY_BYTES)
    part = F.pmod(F.xxhash64("sid"), F.lit(blocks))
    asked_sets = saved(asked_sets.withColumn("part", part), "asked")
    all_sets = saved(sets.join(open_.select("id").distinct(), F.col("sid") == F.col("id"), "left_semi").select("sid", "items"), "crowds")
    path = new_path(spark, "found")
    for i in range(blocks):
        t = asked_sets.where(F.col("part") == i).select("sid", "items").orderBy("sid").toArrow()  # QUERY_BYTES, or one set
        if not len(t):
            continue
        items = t["items"].combine_chunks()
        sizes = np.diff(items.offsets.to_numpy())
        flat = items.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        shared = spark.sparkContext.broadcast((t["sid"].to_numpy(), sizes, flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]))
        _met(all_sets.repartition(spark.sparkContext.defaultParallelism), shared, similarity).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema("a long, b long").parquet(path)


def _met(all_sets: DataFrame, shared, similarity: tuple[int, int]) -> DataFrame:
    ddl = "a long, b long"
    schema = arrow_schema(ddl)
    part, whole = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, flat, owner = shared.value
        for batch in batches:
            items = batch.column(1)
            offsets = items.offsets.to_numpy().astype(np.int64)
            values = items.values.to_numpy()
            own = batch.column(0).to_numpy()
            left = np.searchsorted(flat, values, side="left")
            n = np.searchsorted(flat, values, side="right") - left
            upto = np.concatenate(([0], np.cumsum(n)))[offsets]
            a = 0
            while a < len(own):  # rows that meet about two million entries of the index at a time
                z = max(a + 1, int(np.searchsorted(upto, upto[a] + 2_000_000, side="right")) - 1)
                s = slice(offsets[a], offsets[z])
                hit = n[s].sum()
                at = np.repeat(left[s] - np.concatenate(([0], np.cumsum(n[s])[:-1])), n[s]) + np.arange(hit)
                row = np.repeat(np.repeat(np.arange(a, z), np.diff(offsets[a : z + 1])), n[s])
                key, common = np.unique(row * len(ids) + owner[at], return_counts=True)
                row, q = key // len(ids), key % len(ids)
                near = (own[row] != ids[q]) & (whole * common >= part * (np.diff(offsets)[row] + sizes[q] - common))
                x, y = own[row[near]], ids[q[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=schema)
                a = z

    return all_sets.mapInArrow(run, ddl).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_shingles, component_id (least doc_id reachable) and kept.

    A null or blank text has an empty set and is linked with nothing; a text of fewer than five words is one shingle, the
    whole sequence; one of any length counts whole. Rows of one doc_id are one document, linked wherever any of their texts is.
    Repeated rows each get a row. A row without doc_id belongs to no component: component_id is null and it is kept. Of pairs
    exactly at the least similarity all are links. Other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = saved(sketches(docs), "sketches")
    named = rows.where("doc_id is not null and n > 0")
    # tables of their own, so that the joins below have exchanges of their own, which can be split where a key is common
    reps = saved(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
    again = saved(named.groupBy(F.col("doc_id").alias("id"), "f1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", "f1"), "again")
    same = named.join(reps, ["f1", "f2", "n"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    heads = named.join(reps, (named.doc_id == reps.id) & (named.f1 == reps.f1) & (named.f2 == reps.f2)).select("id", named.f1, "bands")
    member = once(heads, again, "id", "f1").select("id", "f1", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    sizes = saved(sizes.select("bucket", "size"), "sizes")
    member = saved(member.join(sizes, "bucket").select("bucket", "id", "f1", "size").hint("rebalance"), "buckets")
    ranks = saved(member.groupBy("id", "f1").agg(F.sum("size").alias("rank")), "ranks")
    sets = saved(sets_of(docs, _key(ranks), again), "sets")
    open_ = member.join(ranks.groupBy("id").agg(F.max("rank").alias("rank")), "id").select("bucket", "id", "size", "rank", F.col("id").alias("root"))
    best = F.max_by(F.struct("id", "rank"), F.struct("rank", -F.col("id"))).alias("p")
    pairs = open_.join(open_.groupBy("bucket").agg(best), "bucket").where("id <> p.id")
    pairs = pairs.groupBy(F.col("id").alias("y")).agg(F.max_by("p.id", F.struct("p.rank", -F.col("p.id"))).alias("x"))
    pairs = saved(ordered(pairs), "pairs")
    links = saved(linked(pairs, sets), "links")
    open_ = split_buckets(open_, components(links))
    if not open_.isEmpty():
        more = open_.join(central(open_, PIVOTS), "bucket").where("root <> xr").select("x", F.col("id").alias("y"))
        more = saved(ordered(more).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        pairs = pairs.unionByName(more)
        links = links.unionByName(saved(linked(more, sets), "links"))
        open_ = split_buckets(open_, components(links))
    if not open_.isEmpty():
        few = open_.where(F.col("size") <= SMALL)
        more = few.select("bucket", F.col("id").alias("y"), F.col("root").alias("yr")).join(few.select("bucket", F.col("id").alias("x"), F.col("root").alias("xr")), "bucket")
        more = ordered(more.where("xr < yr").select("x", "y")).distinct().join(pairs, ["a", "b"], "left_anti")
        found = saved(linked(more, sets), "links")
        links = links.unionByName(found).unionByName(searched(open_.where(F.col("size") > SMALL), sets))
    root = components(same.unionByName(links), "classes")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(root, F.col("doc_id") == F.col("id"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, as they are, without all but one document of each component; of rows of one doc_id one stays.

    Which one of these is decided by a hash of the whole row. Rows without doc_id, and null and blank texts with one, stay.
    Columns of any name are carried along unread. An empty table stays empty.
    """
    found = saved(near_duplicates(docs), "found")
    gone = found.where("not kept").select(F.col("doc_id").alias("id")).distinct()
    again = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    few = lambda x: F.broadcast(x) if x.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else x
    rows = docs.select(F.col("doc_id").alias("key"), F.struct(*docs.columns).alias("row"))
    out = rows.join(few(gone), F.col("key") == F.col("id"), "left_anti")
    if not again.isEmpty():
        many, same = few(again), F.col("key") == F.col("id")
        one = out.join(many, same, "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.join(many, same, "left_anti").unionByName(one)
    return out.select("row.*")
