"""Language ID with a linear-chain conditional random field over words.

A word's potentials come from hashed features: its prefixes and suffixes (affixes), its character n-grams and itself
(lexicon). A word longer than PIECE is a run of pieces, each a link of the chain with its own posterior, so that texts without
white space are read from end to end. Transition potentials between neighbouring words are learned with them, so a run of
words in another language shows as such in code-switched text. Before a chain's first word any language is as likely as another.
Forward-backward gives each word's posterior; a document's languages are the means of these over its words, weighted by
their letters.

Training takes a bounded sample of labelled documents (PER_LANGUAGE for each language, chosen by a hash of the id) on the
driver: whole texts, or windows of the longest where all would be more than SAMPLE_CHARS. Prediction is one Arrow pass. A
document's chain is cut into segments whose transfer matrices are multiplied first, so that long documents run as fast as
short ones; the result is that of the whole chain. Segments are worked on CELLS numbers at a time, however many languages
there are and however long a chain is.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import map_text

#: Labelled documents a language in the training sample (about: a hash picks them).
PER_LANGUAGE = 300
#: Languages learned: the most frequent ones. A link of the chain costs their number squared, so this bounds the fit.
LANGUAGES = 200
#: Characters of training text in all. Languages share it: what one leaves over, others may use, and so do a language's documents;
#: of a document longer than its share a window is taken. None is left out.
SAMPLE_CHARS = 8_000_000
#: Features, and the most weights (features times languages): with more than 128 languages there are fewer features.
FEATURES, WEIGHTS = 1 << 17, 1 << 24
#: Numbers that forward-backward holds of segments at a time, in each of its tables.
CELLS = 1 << 22
STEPS, RATE, SHRINK = 14, 0.6, 1e-5
SEGMENT = 128
#: A document whose best language has a lower mean posterior is rejected.
MIN_SCORE = 0.3
#: Pieces of words whose potentials a task remembers.
CACHE = 150_000
UND = "und"
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Characters of a piece, and how many of them the next one has too: no n-gram falls between two.
PIECE, SHARED = 16, 2
AFFIX = 4

OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (FEATURES, languages)
    steps: np.ndarray  # (languages, languages) log potentials


def cores(b: ts.Block, start: np.ndarray, end: np.ndarray) -> list[str]:
    """Words in lower case without what is no letter at their ends; empty if there is no letter."""
    raw = b.data.tobytes()
    return [EDGE.sub("", raw[s:e].decode("utf-8", "replace").lower()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each word (1 at least), and the letters each piece counts for: those that the next one has not."""
    step = PIECE - SHARED
    size = np.array([len(w) for w in words], dtype=np.int64)
    counts = np.maximum(1, -(-(size - SHARED) // step))
    letters = np.full(counts.sum(), step, dtype=np.int64)
    letters[np.cumsum(counts) - 1] = size - step * (counts - 1)
    return counts, letters


def sequence(w: ts.Words, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all words' pieces (counts of them from start, for each word), their documents, and the documents' bounds."""
    ends = np.cumsum(counts)
    rows = np.repeat(start - (ends - counts), counts) + np.arange(counts.sum())
    return rows, np.repeat(w.doc, counts), np.concatenate(([0], ends))[w.bounds]


def features(words: list[str], size_of: int = FEATURES) -> np.ndarray:
    """Feature numbers (pieces, n), below size_of, of the words' pieces; where one is too short for a feature, number 0 stands.

    Only a word's first piece has its prefixes and the word itself, only the last one its suffixes.
    """
    counts, _ = pieces(words)
    step = PIECE - SHARED
    cut = [w[i * step : i * step + PIECE] for w, n in zip(words, counts.tolist(), strict=True) for i in range(n)]
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    chars = np.array(cut, dtype=f"U{PIECE}").view(np.uint32).reshape(len(cut), PIECE).astype(np.uint64)
    head, tail = np.zeros((len(cut), AFFIX), dtype=np.uint64), np.zeros((len(cut), AFFIX), dtype=np.uint64)
    head[first] = chars[first, :AFFIX]
    tail[last] = np.array([w[: -AFFIX - 1 : -1] for w in words], dtype=f"U{AFFIX}").view(np.uint32).reshape(len(words), AFFIX)
    itself, size = np.zeros(len(cut), dtype=np.uint64), np.zeros(len(cut), dtype=np.uint64)
    itself[first] = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
    size[first] = [len(w) for w in words]
    out = []

    def add(kind: int, *chars: np.ndarray) -> None:
        h = np.full(len(cut), kind, dtype=np.uint64)
        for c in chars:
            h = ts.mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
        h = h % np.uint64(size_of - 1) + np.uint64(1)
        out.append(np.where(chars[-1] > 0, h, np.uint64(0)))

    for n in range(1, AFFIX + 1):
        add(n, *(head[:, i] for i in range(n)))
        add(10 + n, *(tail[:, i] for i in range(n)))
    for i in range(PIECE - 2):
        add(20, *(chars[:, i + j] for j in range(3)))
    later = np.ones(len(cut), dtype=bool)  # a piece's first two characters are the last ones of the piece before
    later[first] = False
    for i in range(PIECE - 1):
        add(21, *(chars[:, i + j] for j in range(2)))
        if not i:
            out[-1][later] = 0
    add(30, itself, size)
    return np.stack(out, axis=1).astype(np.int64)


def potentials(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    out = np.zeros((len(f), weights.shape[1]))
    for i in range(0, len(f), 4096):
        out[i : i + 4096] = weights[f[i : i + 4096]].sum(axis=1)
    return out


class Chains(NamedTuple):
    """Segments of the chains of some documents."""

    index: np.ndarray  # (segments, SEGMENT) word numbers, -1 after the end
    rank: np.ndarray  # which segment of its chain
    chain: np.ndarray


def chains(bounds: np.ndarray) -> Chains:
    counts = np.diff(bounds)
    n = -(-counts // SEGMENT)
    chain = np.repeat(np.arange(len(counts)), n)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
    index = (bounds[chain] + rank * SEGMENT)[:, None] + np.arange(SEGMENT)
    return Chains(np.where(index < bounds[chain + 1][:, None], index, -1), rank, chain)


def forward_backward(c: Chains, emit: np.ndarray, steps: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors (words, languages) of all words of the chains, and expected counts of transitions if pairs.

    The step into a chain's first word counts as one from a language before it that nothing is known of.
    """
    k = emit.shape[1]
    S = len(c.index)
    post = np.zeros((len(emit), k))
    counts = np.zeros((k, k))
    A = np.exp(steps - steps.max())
    size = max(1, CELLS // (k * max(k, SEGMENT)))
    groups = [slice(i, min(i + size, S)) for i in range(0, S, size)]
    into, back = np.full((S, k), 1 / k), np.full((S, k), 1 / k)
    follows = np.append(c.rank[1:] > 0, False)  # the next segment is of the same chain
    held: list = []
    if follows.any():
        for g in groups:  # what is known at each segment's start, from all before it
            M = _transfer(c, g, emit, A)
            for r in np.unique(c.rank[g]).tolist():
                s = np.flatnonzero((c.rank[g] == r) & follows[g])
                v = np.einsum("sk,skl->sl", into[g][s], M[s])
                into[g.start + s + 1] = v / v.sum(axis=1, keepdims=True)
            held = [M]
        for i, g in enumerate(reversed(groups)):  # and at its end, from all behind it
            M = held[0] if not i else _transfer(c, g, emit, A)
            for r in np.unique(c.rank[g])[::-1].tolist():
                s = np.flatnonzero((c.rank[g] == r) & (c.rank[g] > 0))
                v = np.einsum("skl,sl->sk", M[s], back[g][s])
                back[g.start + s - 1] = v / v.sum(axis=1, keepdims=True)
    for g in groups:
        on, E, at = _potentials(c, g, emit)
        alpha = np.empty(E.shape)
        a = into[g]
        for t in range(SEGMENT):
            new = (a @ A) * E[t]
            new /= new.sum(axis=1, keepdims=True)
            a = alpha[t] = np.where(on[t][:, None], new, a)
        b = back[g]
        for t in range(SEGMENT - 1, -1, -1):
            live = on[t]
            p = alpha[t] * b
            post[at[t][live]] = (p / p.sum(axis=1, keepdims=True))[live]
            eb = E[t] * b
            if pairs:
                before = (alpha[t - 1] if t else into[g])[live]
                xi = before[:, :, None] * A * eb[live][:, None, :]
                counts += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            new = eb @ A.T
            new /= new.sum(axis=1, keepdims=True)
            b = np.where(live[:, None], new, b)
    return post, counts if pairs else None


def _potentials(c: Chains, g: slice, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments g: which places have a word (place, segment), the words' potentials there, and the words."""
    at = c.index[g].T
    on = at >= 0
    E = np.ones((*at.shape, emit.shape[1]))
    E[on] = np.exp(emit[at[on]] - emit[at[on]].max(axis=1, keepdims=True))
    return on, E, at


def _transfer(c: Chains, g: slice, emit: np.ndarray, A: np.ndarray) -> np.ndarray:
    """Transfer matrices of the segments g, each scaled to sum up to 1."""
    on, E, at = _potentials(c, g, emit)
    k = emit.shape[1]
    M = np.broadcast_to(np.eye(k), (at.shape[1], k, k)).copy()
    for t in range(SEGMENT):
        live = on[t]
        M[live] = (M[live] @ A) * E[t][live][:, None, :]
        M[live] /= M[live].sum(axis=(1, 2), keepdims=True)
    return M


def unique_words(w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each different word, and each word's number among them."""
    _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    return first, number


class Part(NamedTuple):
    """Training texts of one block."""

    chains: Chains
    features: np.ndarray  # of each different piece
    number: np.ndarray  # which of these each link of the chains is
    truth: np.ndarray  # each link's language
    moves: np.ndarray  # transitions between links of one chain, (languages, languages)
    starts: np.ndarray  # chains by the language of their first link


def prepared(texts: list[str], code: np.ndarray, k: int, size_of: int) -> list[Part]:
    parts = []
    for b in ts.blocks(pa.array(texts, pa.large_string())):
        w = ts.words(b, ts.TABLE_LOWER)
        first, number = unique_words(w)
        words = cores(b, w.start[first], w.end[first])
        f = features(words, size_of)
        counts, letters = pieces(words)
        f[letters == 0] = 0
        number, doc, bounds = sequence(w, (np.cumsum(counts) - counts)[number], counts[number])
        truth = code[b.first + doc]
        same = doc[1:] == doc[:-1]
        moves = np.bincount(truth[1:][same] + k * truth[:-1][same], minlength=k * k).reshape(k, k)
        begin = bounds[:-1][np.diff(bounds) > 0]
        parts.append(Part(chains(bounds), f, number, truth, moves, np.bincount(truth[begin], minlength=k)))
    return parts


def gradient(parts: list[Part], weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log likelihood of a link's true language: by weights, and by transition potentials."""
    size_of, k = weights.shape
    total = max(1, sum(len(p.number) for p in parts))
    grad, grad2 = np.zeros((size_of, k)), np.zeros((k, k))
    entry = np.exp(steps - steps.max())
    entry /= entry.sum(axis=0)  # from which language, if from any, a chain came into its first link's
    for p in parts:
        post, pairs = forward_backward(p.chains, potentials(weights, p.features)[p.number], steps, pairs=True)
        diff = -post
        diff[np.arange(len(p.truth)), p.truth] += 1
        own = np.stack([np.bincount(p.number, weights=diff[:, j], minlength=len(p.features)) for j in range(k)], axis=1)
        for i in range(p.features.shape[1]):
            for j in range(k):
                grad[:, j] += np.bincount(p.features[:, i], weights=own[:, j], minlength=size_of) / total
        grad2 += (p.moves + entry * p.starts - pairs) / total
    grad[0] = 0
    return grad, grad2


def train(texts: list[str], labels: list[str]) -> Model:
    """The model of labelled texts; their order does not matter. Without two languages it has no weights."""
    langs = sorted(set(labels))
    k = len(langs)
    size_of = FEATURES
    while size_of * k > WEIGHTS:
        size_of //= 2
    weights, steps = np.zeros((size_of, k)), np.zeros((k, k))
    if k < 2:
        return Model(langs, weights, steps)
    number = {x: i for i, x in enumerate(langs)}
    parts = prepared(texts, np.array([number[x] for x in labels]), k, size_of)
    square, square2 = np.full((size_of, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(STEPS):
        grad, grad2 = gradient(parts, weights, steps)
        grad -= SHRINK * weights
        square += grad**2
        square2 += grad2**2
        weights += RATE * grad / np.sqrt(square)
        steps += RATE * grad2 / np.sqrt(square2)
    return Model(langs, weights.astype(np.float32), steps)


def sample(docs: DataFrame, lang: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages of the training sample: rows with a language whose fold of five is not 0."""
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & (fold(5) != 0)).select("doc_id", F.col(lang).cast("string").alias("l"), F.col("text").cast("string").alias("t"))
    counts = known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()
    if not counts:
        return [], []
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], int((1 << 40) * min(1.0, PER_LANGUAGE / r["n"])))])
    got = known.withColumn("h", h).where(F.col("h") < share[F.col("l")])
    sizes: dict[str, list[int]] = {}
    for r in got.select("l", F.length("t").alias("n")).collect():
        sizes.setdefault(r["l"], []).append(r["n"])
    room = level([sum(x) for x in sizes.values()], SAMPLE_CHARS)
    most = {x: level(n, room) for x, n in sizes.items() if sum(n) > room}
    if most:
        upto = F.coalesce(F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("l")], F.length("t"))
        begin = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.greatest(F.lit(1), F.length("t") - upto + 1)) + 1
        got = got.withColumn("t", F.when(F.length("t") > upto, F.col("t").substr(begin.cast("int"), upto)).otherwise(F.col("t")))
    rows = got.orderBy("h", "doc_id", "t").collect()
    return [r["t"] for r in rows], [r["l"] for r in rows]


def level(sizes: list[int], total: int) -> int:
    """The greatest bound (1 at least) at which sizes, each cut to it, sum up to total at most; the largest size if all fit."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            return max(1, share)
        left -= n
    return max([1, *sizes])


def predict(docs: DataFrame, model: Model, keys: list | None = None, ddl: str | StructType = OUT) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text); keys and ddl: other columns before the last two."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = max(1, len(model.langs))

    def make():
        langs, weights, steps = shared.value
        names = np.array([*langs, UND], dtype=object)
        known: dict[int, int] = {}
        table = np.zeros((0, k + 2))  # potentials and letters of a piece, and how many pieces its word has

        def step(keys, texts):
            nonlocal table
            for b in ts.blocks(texts):
                n_docs = len(b.offsets) - 1
                w = ts.words(b, ts.TABLE_LOWER)
                first, number = unique_words(w)
                hashes = w.hash[first].tolist()
                if len(table) > CACHE:
                    known.clear()
                    table = table[:0]
                rows = np.array([known.get(h, -1) for h in hashes], dtype=np.int64)
                new = np.flatnonzero(rows < 0)
                if len(new):
                    words = cores(b, w.start[first[new]], w.end[first[new]])
                    counts, size = pieces(words)
                    begin = np.cumsum(counts) - counts
                    more = np.zeros((len(size), k + 2))
                    more[:, k] = size
                    more[begin, k + 1] = counts
                    if len(langs) > 1:
                        has = np.flatnonzero(size)
                        more[has, :k] = potentials(weights, features([x for x in words if x], len(weights))) if len(has) else 0
                    rows[new] = len(table) + begin
                    known.update(zip((hashes[i] for i in new), rows[new].tolist(), strict=True))
                    table = np.concatenate([table, more])
                at, doc, bounds = sequence(w, rows[number], table[rows, k + 1].astype(np.int64)[number])
                got = table[at]
                post, _ = forward_backward(chains(bounds), got[:, :k], steps if len(langs) > 1 else np.zeros((k, k)))
                letters = got[:, k]
                mass = np.stack([np.bincount(doc, weights=post[:, j] * letters, minlength=n_docs) for j in range(k)], axis=1)
                total = np.bincount(doc, weights=letters, minlength=n_docs)
                best = mass.argmax(axis=1)
                score = mass[np.arange(n_docs), best] / np.maximum(total, 1)
                none = (total == 0) | (not langs)
                best[none], score[none] = len(langs), 0.0
                yield [*[c.slice(b.first, n_docs) for c in keys], names[best], np.clip(score, 0, 1)]

        return step

    return map_text(docs, keys or ["doc_id", (fold(5) == 0).alias("held_out")], make, ddl)


def language_id(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): held_out, lang_pred and score, the mean posterior of lang_pred.

    Learned from text and lang of rows that have both and whose crc32(doc_id) modulo 5 is not 0. A text that is null or has
    no letter gives und with score 0, and so does every text if nothing could be learned; a null doc_id counts as the empty
    text (held out). Of languages that score alike the first by name is given. Texts of any length are read whole. Repeated
    rows each get a row. Other columns are not read. An empty table gives an empty result.
    """
    return predict(docs, train(*sample(docs)))


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, as they are, that are not rejected: a language is found, with a score of at least MIN_SCORE.

    Null and blank texts and those without a letter are rejected; repeated rows fare alike; columns of any name stay. Without a
    row that has a language nothing is learned and every row is rejected. An empty table stays empty.
    """
    row = StructType().add("row", docs.schema)
    got = predict(docs, train(*sample(docs)), [F.struct(*docs.columns).alias("row")], row.add("lang_pred", StringType()).add("score", DoubleType()))
    return got.where((F.col("lang_pred") != UND) & (F.col("score") >= MIN_SCORE)).select("row.*")
