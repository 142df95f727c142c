"""Quality rules: repetition counts, and a hashed n-gram log-likelihood ratio against trusted text.

Two multinomials over hashed word unigrams and bigrams are counted: one over every document, one over trusted documents.
A document's score is the mean of log(p_trusted / p_raw) over its n-grams; it is kept at or above a fixed threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import map_text
from leafmill.llm.scratch import saved

#: Hashed n-gram classes; also the bound on what the driver holds of the counts.
BUCKETS = 1 << 16
#: Trusted ids up to which their list is broadcast (8 bytes each); a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Documents with a mean log ratio below this are dropped.
MIN_LLR = -0.15
SMOOTH = 0.5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def ngrams(w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Documents and classes of all unigrams and bigrams of a block."""
    at, two = ts.windows(w, 2)
    return np.concatenate([w.doc, w.doc[at]]), (np.concatenate([w.hash, two]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the (document, hash) pairs occur more than once."""
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(b: ts.Block, w: ts.Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document of a block."""
    n_docs = len(b.offsets) - 1
    inside = ~ts.SPACE[b.data]
    chars = ts.total(inside & ((b.data & 0xC0) != 0x80), b.offsets)
    # lines: the ranges between newlines and document bounds
    cut = np.flatnonzero(b.data == 10)
    start = np.union1d(b.offsets[:-1], cut + 1)
    start = start[start < len(b.data)]
    end = np.append(start[1:], len(b.data))
    end = end - (b.data[end - 1] == 10) if len(end) else end
    end = np.maximum(end, start)
    line_doc = np.searchsorted(b.offsets, start, side="right") - 1
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_doc = start[has_word], end[has_word], line_doc[has_word]
    lh = ts.Hasher(b.data).of(start, end)
    order = np.lexsort((np.arange(len(lh)), lh, line_doc))
    again = np.zeros(len(lh), dtype=bool)
    again[order[1:]] = (line_doc[order][1:] == line_doc[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    at, h5 = ts.windows(w, 5)
    hit = at[repeats(w.doc[at], h5)]
    cover = np.zeros(len(w.hash) + 6, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    covered = np.cumsum(cover)[: len(w.hash)] > 0
    return [
        np.diff(w.bounds), chars, ts.total(SYMBOLS[b.data], b.offsets),
        np.bincount(line_doc[again], minlength=n_docs), np.bincount(w.doc[covered], minlength=n_docs),
    ]


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(trusted, text) of each row of docs: trusted is whether all labels of its doc_id that have a quality say 1."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    ids = saved(one.select(F.col("doc_id").alias("id"), F.lit(True).alias("trusted")), "trusted")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").alias("key"), "text")
    known = rows.where("key is not null").join(ids, F.col("key") == F.col("id"), "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    return known.unionByName(rows.where("key is null").select(F.lit(False).alias("trusted"), "text"))  # which meet no label


def ngram_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every class over all trusted documents and over all documents (BUCKETS rows reach the driver)."""

    def make():
        raw = np.zeros(BUCKETS, dtype=np.int64)
        target = np.zeros(BUCKETS, dtype=np.int64)

        def step(keys, texts):
            good = keys[0].to_numpy(zero_copy_only=False)
            for b in ts.blocks(texts):
                doc, c = ngrams(ts.words(b))
                np.add(raw, np.bincount(c, minlength=BUCKETS), out=raw)
                np.add(target, np.bincount(c[good[b.first + doc]], minlength=BUCKETS), out=target)
            return ()

        def done():
            at = np.flatnonzero(raw)
            yield [at.astype(np.int32), target[at], raw[at]]

        step.done = done
        return step

    got = map_text(marked(docs, labels), ["trusted"], make, "c int, target long, raw long").groupBy("c").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[got["c"].to_numpy()], raw[got["c"].to_numpy()] = got["target"].to_numpy(), got["raw"].to_numpy()
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():  # nothing is trusted: no verdict
        return np.zeros(len(raw))
    p = (target + SMOOTH) / (target.sum() + SMOOTH * len(target))
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * len(raw))
    return np.log(p) - np.log(q)


def quality_rules(docs: DataFrame, labels: DataFrame, min_llr: float = MIN_LLR) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, base_failed, the mean log ratio and the verdict.

    A null or empty text has no words, so it fails the base rules; its log ratio is 0. Repeated rows each get a row; a
    null doc_id is kept as null and never trusted. Without labels the log ratio is 0 everywhere. Other columns are not read.
    """
    ratio = log_ratio(*ngram_counts(docs, labels))

    def make():
        def step(keys, texts):
            for b in ts.blocks(texts):
                w = ts.words(b)
                n_docs = len(b.offsets) - 1
                base = base_counts(b, w)
                n, rep = base[0], base[4]
                failed = (n < 10) | (100 * rep > 20 * n)
                doc, c = ngrams(w)
                llr = np.bincount(doc, weights=ratio[c], minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)
                yield [keys[0].slice(b.first, n_docs), *base, failed, llr, ~failed & (llr >= min_llr)]

        return step

    return map_text(docs, ["doc_id"], make, OUT)
