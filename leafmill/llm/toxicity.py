"""Toxicity by noisy-channel deobfuscation.

A trigram language model over characters is counted on every document. Tokens that look disguised (symbols or digits for
letters, letters spread out by spaces or punctuation, letters repeated) become lattices of what each character may stand
for, and Viterbi decoding under the character model and the channel's costs restores them. Which plain and restored
words, and which five-byte grams of them, speak for the label is learned from labelled documents (a bounded sample, after
copies and near copies are set aside); a logistic function of their summed log odds gives the score.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import map_text
from leafmill.llm.langid import fold

#: Labelled rows learned from: at most so many, the first by a hash of their id.
SAMPLE = 20_000
#: An entry of the lexicon must be in this share of the sample's label-1 documents, and in MIN_DOCS of them; the sample bounds their number.
MIN_SHARE, MIN_DOCS = 0.004, 5
#: Least log odds ratio, less two standard errors.
MIN_ODDS = 2.0
WORD = np.uint64(1 << 63)
GRAM = 5
THRESHOLD = 0.3
#: No word is longer. Longer tokens are decoded in windows of WINDOW characters and as many of those before, and part by part.
LONGEST, WINDOW = 30, 200
#: Decoded tokens that a task remembers.
CACHE = 100_000

OUT = "doc_id long, held_out boolean, score double, predicted int"

# The letters that a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c",
}

#: Channel costs, in nats: a symbol for a letter, letters dropped from a run of three or of two, a symbol that stands for nothing.
COST_SYMBOL, COST_RUN, COST_PAIR, COST_DROP = 0.5, 0.7, 3.0, 8.0

N = 28  # 0: a word's edge, 1-26: letters, 27: anything else
SYMBOL = np.full(256, 27, dtype=np.int64)
SYMBOL[[i for i in range(128) if not chr(i).isalnum()]] = 0
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
GAP = ts.SPACE.copy()
GAP[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
#: Bytes of words in lower case; anything else is a word's edge.
NORM = np.arange(256, dtype=np.uint64)
NORM[:128] = 0x20
NORM[97:123] = np.arange(97, 123)
NORM[65:91] = np.arange(97, 123)
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[65:91] = True
MARK = np.zeros(256, dtype=bool)
MARK[[ord(c) for c in LEET]] = True
STRETCHED = re.compile(r"(.)\1{3,}", re.S)
PARTS = re.compile(r"[^\w" + re.escape("".join(LEET)) + r"]+|_+")
TRIM = re.compile(r"([^\w\s])\1{2,}$|[.,;:?\"')\]}*%&#]+$")


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities (28, 28, 28) of a symbol after two others, over every text; the cube's cells reach the driver."""

    def make():
        counts = np.zeros(N**3, dtype=np.int64)

        def step(keys, texts):
            for b in ts.blocks(texts):
                s = SYMBOL[b.data]
                if len(s) > 2:
                    np.add(counts, np.bincount((s[:-2] * N + s[1:-1]) * N + s[2:], minlength=N**3), out=counts)
            return ()

        def done():
            at = np.flatnonzero(counts)
            yield [at.astype(np.int32), counts[at]]

        step.done = done
        return step

    got = map_text(docs, [], make, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(N**3)
    counts[got["c"].to_numpy()] = got["n"].to_numpy()
    three = counts.reshape(N, N, N)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + N)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


def viterbi(lattice: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The best string: each place of the lattice offers strings over a-z and the space with their costs."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for place in [*lattice, [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for emit, cost in place:
                x, y, s = a, b, score - cost
                for c in emit:
                    z = 0 if c == " " else ord(c) - 96
                    if z == 0 and y == 0:  # one edge between words
                        continue
                    s += model[x, y, z]
                    x, y = y, z
                old = new.get((x, y))
                if old is None or (s, text + emit) > old:
                    new[x, y] = (s, text + emit)
        best = new
    return max(best.values())[1].strip()


def token_lattice(token: str) -> list[list[tuple[str, float]]]:
    """What a lower-case token's characters may stand for; runs of a character may be meant once or twice."""
    out = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run[1], len(run[0])
        if "a" <= c <= "z":
            meant = [(c, 0.0)]
        elif c in LEET:
            meant = [(x, COST_SYMBOL) for x in LEET[c]] + [("", COST_DROP)]
        else:
            out.append([("", 0.0)])
            continue
        place = []
        for x, cost in meant:
            if n == 1:
                place.append((x, cost))
            elif n == 2:
                place += [(x * 2, cost), (x, cost + COST_PAIR)]
            else:
                place += [(x, cost + COST_RUN), (x * 2, cost + COST_RUN)]
        out.append(place)
    return out


def spaced_lattice(letters: str) -> list[list[tuple[str, float]]]:
    """Single letters, or symbols for them, with gaps between them; a gap may part words or nothing."""
    out = []
    for i, c in enumerate(letters):
        if i:
            out.append([("", 0.0), (" ", 0.0)])
        out.append([(x, COST_SYMBOL) for x in LEET[c]] + [("", COST_DROP)] if c in LEET else [(c, 0.0)])
    return out


def windows(text: str) -> list[str]:
    """Overlapping windows: every LONGEST characters in a row are in one."""
    return [text[max(0, k - LONGEST) : k + WINDOW] for k in range(0, len(text), WINDOW)]


def disguised(token: str) -> list[str]:
    """What is to be decoded of a lower-case token. More than three of a character mean what three do."""
    token = STRETCHED.sub(r"\1\1\1", token)
    token = token[:-64] + TRIM.sub("", token[-64:])
    odd = lambda x: not (x.isalpha() and not re.search(r"(.)\1\1", x))
    if len(token) <= LONGEST:
        return [token] if odd(token) else []
    parts = PARTS.split(token)
    return [w for x in ([token] if len(parts) == 1 else [token, *parts]) if odd(x) and re.search("[a-z]", x) for w in windows(x)]


def restored(b: ts.Block, model: np.ndarray, memory: dict) -> list[tuple[int, str]]:
    """(document, word) for the words that decoding restores from a block's disguised tokens."""
    out: list[tuple[int, str]] = []
    if len(memory) > CACHE:
        memory.clear()

    def decode(kind: str, text: str) -> list[str]:
        got = memory.get((kind, text))
        if got is None:
            got = viterbi(token_lattice(text) if kind == "token" else spaced_lattice(text), model).split()
            memory[kind, text] = got
        return got

    raw = b.data.tobytes()
    w = ts.words(b)
    letters = np.concatenate(([0], np.cumsum(LETTER[b.data])))
    marks = np.concatenate(([0], np.cumsum(MARK[b.data])))
    low = b.data | 0x20
    three = np.zeros(len(b.data) + 1, dtype=np.int64)
    if len(low) > 2:
        three[1:-2] = LETTER[b.data][:-2] & (low[:-2] == low[1:-1]) & (low[:-2] == low[2:])
    three = np.cumsum(three)
    of = lambda x: x[w.end] - x[w.start]
    inner = three[np.maximum(w.end - 2, w.start)] - three[w.start]
    odd = (of(letters) > 0) & ((of(marks) > 0) | (inner > 0))
    for i in np.flatnonzero(odd).tolist():
        for part in disguised(raw[w.start[i] : w.end[i]].decode("utf-8", "replace").lower()):
            out += [(int(w.doc[i]), x) for x in decode("token", part)]
    if not len(b.data):
        return out
    for gap, alone in ((GAP, LETTER), (GAP & ~MARK, LETTER | MARK)):
        t = ts.words(b, ts.TABLE_LOWER, gap)
        single = (t.end - t.start == 1) & alone[b.data[t.start]]
        joined = single[1:] & single[:-1] & (t.doc[1:] == t.doc[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2], strict=True):  # words s..e stand alone and follow one another
            text = b.data[t.start[s : e + 1]].tobytes().decode("ascii").lower()
            # of the second round only what the first one has not seen, and no rows of numbers
            if e - s >= 2 and (gap is GAP or (not text.isalpha() and re.search("[a-z]", text))):
                for part in windows(text):
                    out += [(int(t.doc[s]), x) for x in decode("spaced", part)]
    return out


class Lexicon(NamedTuple):
    grams: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    slope: float


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the grams of all texts; an edge may stand at a gram's ends only. Text i begins at offsets[i] + i."""
    s = np.append(np.insert(NORM[data], offsets[:-1], np.uint64(0x20)), np.uint64(0x20))
    n = len(s) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = s == 0x20
    inner = edge[1 : 1 + n].copy()
    code = s[:n].copy()
    for i in range(1, GRAM):
        code |= s[i : i + n] << np.uint64(8 * i)
        if 1 < i < GRAM - 1:
            inner |= edge[i : i + n]
    at = np.flatnonzero(~inner)
    return at, code[at]


def of_words(found: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram) of restored words."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = [x.encode() for _, x in found]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    at, code = grams(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return np.array([d for d, _ in found])[np.searchsorted(offsets[:-1] + np.arange(len(raw)), at, side="right") - 1], code


def features(b: ts.Block, model: np.ndarray, memory: dict, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of all grams and words of a block, restored words among them; maybe: only codes whose bit is set."""
    at, code = grams(b.data, b.offsets)
    w = ts.words(b, ts.TABLE_LOWER, GAP)
    word = w.hash | WORD
    doc = w.doc
    if maybe is not None:
        near = np.flatnonzero(maybe[(code % np.uint64(len(maybe))).astype(np.int64)])
        at, code = at[near], code[near]
        near = np.flatnonzero(maybe[(word % np.uint64(len(maybe))).astype(np.int64)])
        doc, word = doc[near], word[near]
    docs, codes = [text_of(b, at), doc], [code, word]
    found = restored(b, model, memory)
    if found:
        d, c = of_words(found)
        docs += [d, np.array([d for d, _ in found])]
        codes += [c, word_hash([x for _, x in found]) | WORD]
    return np.concatenate(docs).astype(np.int64), np.concatenate(codes)


def word_hash(words: list[str]) -> np.ndarray:
    raw = [x.encode() for x in words]
    ends = np.cumsum([len(x) for x in raw])
    return ts.Hasher(np.frombuffer(b"".join(raw), dtype=np.uint8), ts.TABLE_LOWER).of(np.concatenate(([0], ends[:-1])), ends)


def text_of(b: ts.Block, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(b.offsets[:-1] + np.arange(len(b.offsets) - 1), at, side="right") - 1


def hits(b: ts.Block, lexicon: np.ndarray, maybe: np.ndarray, model: np.ndarray, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """(document, lexicon number) of the different lexicon entries in each text of a block."""
    docs, codes = features(b, model, memory, maybe)
    if not len(lexicon):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    num = np.minimum(np.searchsorted(lexicon, codes), len(lexicon) - 1)
    ok = lexicon[num] == codes
    both = np.unique(docs[ok] * len(lexicon) + num[ok])
    return both // len(lexicon), both % len(lexicon)


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y of the labelled rows learned from."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold(4) != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()
    ids = {int(i): int(y > 0) for i, y in zip(picked["doc_id"].to_pylist(), picked["y"].to_pylist(), strict=True)}
    keys = np.array(sorted(ids), dtype=np.int64)
    ys = np.array([ids[i] for i in keys.tolist()], dtype=np.int32)

    def make():
        def step(cols, texts):
            doc = cols[0].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, doc), max(0, len(keys) - 1))
            ok = (keys[at] == doc if len(keys) else np.zeros(len(doc), bool)) & cols[0].is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(ok)
            yield [cols[0].take(rows), texts.take(rows), ys[at[rows]] if len(keys) else np.zeros(0, np.int32)]

        return step

    return map_text(docs, ["doc_id"], make, "doc_id long, text string, y int")


def distinct_ids(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of the sample's rows that share none of three min-hashes of word triples with a row before."""

    def make():
        def step(cols, texts):
            for b in ts.blocks(texts):
                n_docs = len(b.offsets) - 1
                doc, h = ts.shingles(ts.words(b, ts.TABLE_LOWER), 3)
                least = np.full((3, n_docs), np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(3):
                    np.minimum.at(least[i], doc, ts.mix(h + np.uint64(i)))
                yield [*[c.slice(b.first, n_docs) for c in cols], *(x.view(np.int64) for x in least)]

        return step

    t = map_text(rows, ["doc_id", "y"], make, "doc_id long, y int, m0 long, m1 long, m2 long").toArrow().sort_by("doc_id").to_pydict()
    seen: set[tuple[int, int]] = set()
    ids, ys = [], []
    for d, y, *m in zip(*t.values(), strict=True):
        keys = set(enumerate(m))
        if not keys & seen:
            ids.append(d)
            ys.append(y)
        seen |= keys
    return np.array(ids, dtype=np.int64), np.array(ys, dtype=np.int64)


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> Lexicon:
    rows = sample_rows(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first, labels_of = distinct_ids(rows)
    n1 = int(labels_of.sum())
    n0 = len(labels_of) - n1

    def make():
        char_model = shared.value
        memory: dict = {}

        def step(cols, texts):
            ids = cols[0].to_numpy(zero_copy_only=False)
            y = cols[1].to_numpy(zero_copy_only=False)
            use = np.isin(ids, first)
            for b in ts.blocks(texts):
                doc, code = features(b, char_model, memory)
                keep = use[b.first + doc]
                pairs = np.unique(np.stack([code[keep], doc[keep].astype(np.uint64)]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
                code, number = np.unique(pairs[0], return_inverse=True)
                label = y[b.first + pairs[1].astype(np.int64)]
                yield [code.view(np.int64), np.bincount(number, weights=label == 0, minlength=len(code)).astype(np.int64), np.bincount(number, weights=label == 1, minlength=len(code)).astype(np.int64)]

        return step

    found = map_text(rows, ["doc_id", "y"], make, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    least = max(MIN_DOCS, int(MIN_SHARE * n1))
    odds = F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = found.where(F.col("n1") >= least).where((F.col("n1") <= n1) & (F.col("n0") <= n0)).select("gram", odds.alias("w"), (odds - 2 * error).alias("low")).where(F.col("low") > MIN_ODDS)
    got = sorted(best.select("gram", "w").collect(), key=lambda r: r["gram"] % 2**64)
    lex = Lexicon(np.array([r["gram"] for r in got], dtype=np.int64).view(np.uint64), np.array([r["w"] for r in got], dtype=float), 0.0, 1.0)
    table = sums(rows.select("doc_id", "text", "y"), lex, model, ["y"], "y int, x double").groupBy("y", F.round("x", 2).alias("x")).count().toArrow()
    x, y, n = (np.array(table[c].to_pylist(), dtype=float) for c in ("x", "y", "count"))
    return lex._replace(**dict(zip(("bias", "slope"), logistic(x, y, n), strict=True)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Bias and slope (not below 0) of a logistic fit with a weak prior, by Newton steps."""
    t = np.zeros(2)
    X = np.stack([np.ones_like(x), x], axis=1) if len(x) else np.zeros((0, 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ t))
        g = X.T @ (n * (y - p)) - 0.01 * t
        H = (X * (n * p * (1 - p))[:, None]).T @ X + 0.01 * np.eye(2)
        t = np.clip(t + np.clip(np.linalg.solve(H, g), -2, 2), -20, 20)
    return (float(t[0]), max(0.0, float(t[1]))) if len(x) else (-4.0, 0.0)


def sums(docs: DataFrame, lex: Lexicon, model: np.ndarray, keys: list, ddl: str, finish=None) -> DataFrame:
    """keys and the summed weights of the different lexicon grams of each text."""
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def make():
        lex, char_model = shared.value
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(lex.grams % np.uint64(len(maybe))).astype(np.int64)] = True
        memory: dict = {}

        def step(cols, texts):
            for b in ts.blocks(texts):
                n_docs = len(b.offsets) - 1
                doc, num = hits(b, lex.grams, maybe, char_model, memory)
                x = np.bincount(doc, weights=lex.weights[num], minlength=n_docs) if len(doc) else np.zeros(n_docs)
                yield [*[c.slice(b.first, n_docs) for c in cols], *([x] if finish is None else finish(x, lex))]

        return step

    return map_text(docs, keys, make, ddl)


def _scores(x: np.ndarray, lex: Lexicon) -> list[np.ndarray]:
    score = 1 / (1 + np.exp(-np.clip(lex.bias + lex.slope * x, -30, 30)))
    return [score, (score >= THRESHOLD).astype(np.int32)]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): held_out, score (0 to 1) and predicted (score of at least 0.3).

    Labels (doc_id, toxic) are learned from only where crc32(doc_id) modulo 4 is not 2. A null or empty text has no word
    and gets the score of none; texts of any length are read whole. A null doc_id counts as the empty text in crc32 and is never
    learned from; several labels of an id count as 1 if one is; repeated rows each get a row and score alike. Without labels every
    score is the same low one; an empty table gives an empty result. Other columns are not read.
    """
    model = character_model(docs)
    lex = learn(docs, labels, model)
    return sums(docs, lex, model, ["doc_id", (fold(4) == 2).alias("held_out")], OUT, _scores)
