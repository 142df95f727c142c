"""Quality classifier with hierarchical empirical Bayes over sites.

Document level: counts on the text and its words' mean log odds fall into classes; each class's log likelihood ratio is learned
from labelled documents by grouped counts over all of them, and a logistic fit calibrates their sum. The words' odds come from a bounded
sample of other labelled documents, and a fifth of the labelled ones is never learned from. Site level: the classifier's
probabilities are summed by host and by path. A path's rate is shrunk towards its host's, a host's towards the global one,
each with the strength that the spread between sites shows (method of moments), so sparse sites stay near their parent. A
document's score joins its own evidence with its path's posterior rate as the prior: the rate of the other documents
there, its own probability being taken out of path and host alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import map_text
from leafmill.llm.langid import fold
from leafmill.llm.quality_rules import SYMBOLS
from leafmill.llm.scratch import saved
from leafmill.llm.toxicity import logistic

CLASSES = 12
#: Sites up to which their rates are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
THRESHOLD = 0.5
#: Bounds on how many documents a prior counts for.
STRENGTH = (2.0, 1000.0)
NAMES = ("symbols", "upper", "digits", "marks", "repeats", "word_size", "words", "odds")
OUT = "doc_id long, fold int, host string, path string, classes array<int>"
#: Labelled rows at most that words are learned from, the first by a hash of their id; classes that words are hashed to.
SAMPLE, BUCKETS = 20_000, 1 << 16
#: crc32(doc_id) modulo 5: never learned from; words are learned from these; classes and calibration from the others.
HELD_OUT, FOR_WORDS = 0, (1, 2)
#: Documents that a word's odds need to be half believed.
BELIEF = 5.0

UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[0x80:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
MARK = np.zeros(256, dtype=bool)
MARK[[ord(c) for c in "!?;:=@^~_+{}[]"]] = True


def word_buckets(w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the different words of each document, hashed."""
    both = np.unique(w.doc * BUCKETS + (ts.mix(w.hash) % np.uint64(BUCKETS)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def word_odds(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log odds of label 1 of the words of each bucket, shrunk towards 0 where few documents have them; of a bounded sample."""
    y = labelled(labels).where(fold(5).isin(*FOR_WORDS))
    picked = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()
    keys = picked["doc_id"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, ys = keys[order], picked["y"].to_numpy()[order]

    def make():
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        sizes = np.zeros(2, dtype=np.int64)

        def step(cols, texts):
            doc = cols[0].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, doc), max(0, len(keys) - 1))
            rows = np.flatnonzero((keys[at] == doc) & cols[0].is_valid().to_numpy(zero_copy_only=False)) if len(keys) else np.zeros(0, np.int64)
            for b in ts.blocks(texts.take(rows)):
                own, bucket = word_buckets(ts.words(b, ts.TABLE_LOWER))
                label = ys[at[rows]][b.first : b.first + len(b.offsets) - 1]
                for i in range(2):
                    counts[i] += np.bincount(bucket[label[own] == i], minlength=BUCKETS)
                    sizes[i] += int((label == i).sum())
            return ()

        def done():
            bucket = np.flatnonzero(counts.any(axis=0))
            yield [np.append(bucket, -1), np.append(counts[0][bucket], sizes[0]), np.append(counts[1][bucket], sizes[1])]

        step.done = done
        return step

    got = map_text(docs, ["doc_id"], make, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().to_pydict()
    table = {b: (x, y) for b, x, y in zip(got["bucket"], got["n0"], got["n1"], strict=True)}
    sizes = table.pop(-1, (0, 0))
    out = np.zeros(BUCKETS, dtype=np.float32)
    if min(sizes) and table:
        at = np.array(list(table), dtype=np.int64)
        n = np.array(list(table.values()), dtype=float)
        rate = (n + 0.5) / (np.array(sizes) + 1.0)
        out[at] = (np.log(rate[:, 1]) - np.log(rate[:, 0])) * n.sum(axis=1) / (n.sum(axis=1) + BELIEF)
    return out


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and y of the rows with a label; several of an id count as the least."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))


def classes(b: ts.Block, odds: np.ndarray) -> np.ndarray:
    """A class from 0 to CLASSES - 1 of each feature, as (documents, features)."""
    w = ts.words(b, ts.TABLE_LOWER)
    n_docs = len(b.offsets) - 1
    n, size = np.diff(w.bounds), np.maximum(np.diff(b.offsets), 1)
    letters = np.maximum(ts.total(LETTER[b.data], b.offsets), 1)
    order = np.lexsort((w.hash, w.doc))
    again = np.bincount(w.doc[order][1:][(w.doc[order][1:] == w.doc[order][:-1]) & (w.hash[order][1:] == w.hash[order][:-1])], minlength=n_docs) if len(order) else np.zeros(n_docs)
    share = lambda x, y: np.ceil(np.log2(1 + 2000 * x / y)).astype(np.int64)
    out = [
        share(ts.total(SYMBOLS[b.data], b.offsets), size), share(ts.total(UPPER[b.data], b.offsets), letters),
        share(ts.total(DIGIT[b.data], b.offsets), size), share(ts.total(MARK[b.data], b.offsets), size),
        np.floor(10 * again / np.maximum(n, 1)).astype(np.int64),
        np.floor(np.bincount(w.doc, weights=w.end - w.start, minlength=n_docs) / np.maximum(n, 1)).astype(np.int64),
        np.floor(np.log2(1 + n)).astype(np.int64),
        np.floor(CLASSES / 2 + 24 * mean_odds(w, odds, n_docs)).astype(np.int64),
    ]
    return np.clip(np.stack(out, axis=1), 0, CLASSES - 1)


def mean_odds(w: ts.Words, odds: np.ndarray, n_docs: int) -> np.ndarray:
    doc, bucket = word_buckets(w)
    return np.bincount(doc, weights=odds[bucket], minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)


def measured(docs: DataFrame, host: Column, path: Column, odds: np.ndarray) -> DataFrame:
    import pyarrow as pa

    from leafmill.llm.arrowmap import lists

    shared = docs.sparkSession.sparkContext.broadcast(odds)  # BUCKETS numbers

    def make():
        table = shared.value

        def step(keys, texts):
            for b in ts.blocks(texts):
                c = classes(b, table)
                ends = np.arange(len(c) + 1) * c.shape[1]
                yield [*[k.slice(b.first, len(c)) for k in keys], lists(c.ravel().astype(np.int32), ends, pa.int32())]

        return step

    return map_text(docs, ["doc_id", fold(5).cast("int").alias("fold"), host.cast("string").alias("host"), path.cast("string").alias("path")], make, OUT)


def ratios(labelled: DataFrame) -> np.ndarray:
    """Log likelihood ratios (features, CLASSES) of the classes, from grouped counts over all labelled rows."""
    counts = np.zeros((2, len(NAMES), CLASSES))
    for r in labelled.select("y", F.posexplode("classes").alias("f", "c")).groupBy("y", "f", "c").count().collect():
        counts[r["y"], r["f"], r["c"]] = r["count"]
    p = (counts + 0.5) / (counts + 0.5).sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def evidence(table: np.ndarray) -> Column:
    """The sum of a row's log ratios."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    return F.aggregate(F.zip_with(rows, F.col("classes"), lambda r, c: F.get(r, c)), F.lit(0.0), lambda s, x: s + x)


def strength(rates: DataFrame, n: str, s: str, parent: str) -> float:
    """How many documents the parent's rate counts for, by the method of moments over sites with n documents and sum s."""
    p = F.col(parent)
    r = rates.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (F.col(s) / F.col(n) - p) ** 2).alias("between"), F.sum(p * (1 - p)).alias("within"),
        F.sum(F.col(n) * p * (1 - p)).alias("mass"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"),
    ).first()
    if not r["k"] or not r["mass"]:
        return STRENGTH[1]
    # E[between] = sum p(1-p) (1 + (n-1) / (m+1)); solved for m
    excess = (r["between"] - r["within"]) / max(r["mass"] - r["within"], 1e-12)
    return float(np.clip(1 / excess - 1, *STRENGTH)) if excess > 0 else STRENGTH[1]


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p) - F.log(1 - p)


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """One row for each row of docs (doc_id, text): evidence, host_rate, path_rate, score, kept (score of at least 0.5) and held_out.

    host and path are columns of docs; a null one is a site of its own. The rates are those of a row's site without the row. Labels
    (doc_id, quality 0 or 1) are joined by id, but not learned from where held_out says so (crc32 of doc_id modulo 5 is 0); several for an
    id count as the least. Without labels of both kinds the evidence is 0 and every score the neutral 0.5, which keeps the row. Null
    and empty texts fall into the classes of no words; texts of any length are read whole. A null doc_id never has a label and is held
    out; repeated rows each get a row, and each is one document of its site. An empty table gives an empty result. Other columns are
    not read.
    """
    rows = saved(measured(docs, host, path, word_odds(docs, labels)), "measures")
    held = (F.col("fold") == HELD_OUT).alias("held_out")
    learned = rows.where(~F.col("fold").isin(HELD_OUT, *FOR_WORDS)).join(labelled(labels), "doc_id")
    learned = saved(learned.select("y", "classes"), "labelled")
    sizes = {r["y"]: r["count"] for r in learned.groupBy("y").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return rows.select("doc_id", F.lit(0.0).alias("evidence"), F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"), held)
    table = ratios(learned)
    steps = learned.select("y", F.round(evidence(table), 1).alias("x")).groupBy("x", "y").count().collect()
    bias, slope = logistic(*(np.array([float(r[c]) for r in steps]) for c in ("x", "y", "count")))
    prior = float(np.log(sizes[1] / sizes[0]))
    own = F.lit(bias - prior) + F.lit(slope) * evidence(table)
    scored = rows.select("doc_id", "host", "path", own.alias("evidence"), (1 / (1 + F.exp(-(own + prior)))).alias("p"), held)
    # tables of their own, so that the join of a common site has exchanges that can be split
    sites = saved(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "sites")
    total = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    world = total["s"] / total["n"] if total["n"] else 0.5
    hosts = sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")).withColumn("world", F.lit(float(world)))
    m_host = strength(hosts, "hn", "hs", "world")
    rate = shrunk(F.col("hs"), F.col("hn"), m_host, F.lit(float(world)))
    rates = saved(sites.join(hosts.select(F.col("host").alias("h"), "hn", "hs", rate.alias("host_rate")), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "rates")
    m_path = strength(rates, "n", "s", "host_rate")
    sums = rates.select(F.col("host").alias("h"), F.col("path").alias("p1"), "n", "s", "hn", "hs")
    few = sums.count() <= BROADCAST_ROWS
    on = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p1"))
    out = scored.join(F.broadcast(sums) if few else sums, on)
    out = out.withColumn("host_rate", shrunk(F.col("hs") - F.col("p"), F.col("hn") - 1, m_host, F.lit(float(world))))
    out = out.withColumn("path_rate", shrunk(F.col("s") - F.col("p"), F.col("n") - 1, m_path, F.col("host_rate")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= THRESHOLD).alias("kept"), "held_out")


def shrunk(s: Column, n: Column, m: float, parent: Column) -> Column:
    """The rate of n documents with sum s, as if m more had the parent's rate."""
    return (F.greatest(s, F.lit(0.0)) + F.lit(m) * parent) / (n + F.lit(m))
