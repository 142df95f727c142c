"""Operators that learn: pieces against brute force, the whole against what a small corpus makes certain."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid, mixing, site_quality, toxicity
from tests.llm.test_text_operators import WORD, clashing


def test_forward_backward():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 5, 5, 400, 401])
    emit, steps = rng.normal(size=(401, 3)), rng.normal(size=(3, 3))
    post, pairs = langid.forward_backward(langid.chains(bounds), emit, steps, True)
    A, total = np.exp(steps), np.zeros((3, 3))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        a, alphas = np.full(3, 1 / 3), []
        for t in range(lo, hi):
            alphas.append((a, (a @ A) * np.exp(emit[t])))
            a = alphas[-1][1] / alphas[-1][1].sum()
        b = np.ones(3)
        for t in range(hi - 1, lo - 1, -1):
            p = alphas[t - lo][1] * b
            assert np.allclose(p / p.sum(), post[t])
            xi = alphas[t - lo][0][:, None] * A * (np.exp(emit[t]) * b)[None, :]
            total += xi / xi.sum()
            b = A @ (np.exp(emit[t]) * b)
            b /= b.sum()
    assert np.allclose(total, pairs)


def likelihood(parts, weights, steps):
    """Mean log probability of the true languages, by the plain forward recursion over each chain."""
    out, n, k = 0.0, 0, len(steps)
    for p in parts:
        emit = langid.potentials(weights, p.features)[p.number]
        links = [[] for _ in range(int(p.chains.chain.max()) + 1)]
        for chain, row in zip(p.chains.chain.tolist(), p.chains.index.tolist(), strict=True):
            links[chain] += [i for i in row if i >= 0]
        for own in links:
            a = np.zeros(k)  # log weight of all paths, and of the true one
            true = 0.0
            for t, i in enumerate(own):
                into = np.logaddexp.reduce(steps, axis=0) if not t else None
                a = into + emit[i] if not t else np.logaddexp.reduce(a[:, None] + steps, axis=0) + emit[i]
                y = p.truth[i]
                true += emit[i, y] + (into[y] if not t else steps[p.truth[own[t - 1]], y])
            out += true - (np.logaddexp.reduce(a) if own else 0.0)
            n += len(own)
    return out / n


def test_gradient_against_finite_differences():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices(a, k=rng.randint(2, 6))) for _ in range(rng.randint(1, 200))) for a in ("abcd", "cdef", "efab") * 5]
    code = np.array([0, 1, 2] * 5)
    parts = langid.prepared(texts, code, 3, 257)
    gen = np.random.default_rng(1)
    weights, steps = gen.normal(size=(257, 3)) * 0.2, gen.normal(size=(3, 3))
    weights[0] = 0
    g, g2 = langid.gradient(parts, weights, steps)
    e = 1e-5
    for i in range(3):
        for j in range(3):
            d = np.zeros((3, 3))
            d[i, j] = e
            assert (likelihood(parts, weights, steps + d) - likelihood(parts, weights, steps - d)) / (2 * e) == pytest.approx(g2[i, j], abs=1e-6)
    for i in gen.integers(1, 257, 12).tolist():
        d = np.zeros((257, 3))
        d[i, i % 3] = e
        assert (likelihood(parts, weights + d, steps) - likelihood(parts, weights - d, steps)) / (2 * e) == pytest.approx(g[i, i % 3], abs=1e-6)


def test_learned_steps_do_not_depend_on_order():
    rng = random.Random(2)
    words = {k: ["".join(rng.choices(a, k=5)) for _ in range(60)] for k, a in (("aa", "abcdefg"), ("bb", "efghijk"))}
    rows = [(" ".join(rng.choices(words[k], k=8)), k) for k in ("aa", "bb") * 100]
    one, two = (langid.train(*map(list, zip(*r, strict=True))) for r in (rows, sorted(rows, key=lambda x: x[1])))
    assert np.allclose(one.steps, two.steps, atol=1e-6) and np.allclose(one.weights, two.weights, atol=1e-4)
    assert one.steps[0, 0] > one.steps[0, 1] and one.steps[1, 1] > one.steps[1, 0]


def test_long_chains_in_small_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    bounds = np.array([0, 700, 700, 705, 1500])
    emit, steps = rng.normal(size=(1500, 3)), rng.normal(size=(3, 3))
    whole = langid.forward_backward(langid.chains(bounds), emit, steps, True)
    monkeypatch.setattr(langid, "CELLS", 3 * langid.SEGMENT * 2)
    cut = langid.forward_backward(langid.chains(bounds), emit, steps, True)
    assert np.allclose(whole[0], cut[0]) and np.allclose(whole[1], cut[1])


def test_languages_of_held_out_rows(docs, corpus, empty):
    got = langid.language_id(clashing(docs)).collect()
    assert len(got) == len(corpus)
    truth = {r[0]: r[2] for r in corpus}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120 and r.doc_id % 25 != 9 and r.doc_id % 10 not in (4, 7, 8) and truth[r.doc_id]]
    assert np.mean(right) > 0.9 and len(right) >= 10
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {200, 201, 202, 205} and all(0 <= r.score <= 1 for r in got)
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & und
    assert langid.language_id(empty).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_sample_keeps_rare_languages_and_long_rows(spark, monkeypatch):
    assert langid.level([5, 100, 100], 105) == 50 and langid.level([3, 4], 7) == 4 and langid.level([9, 9], 1) == 1
    rows = [(i, "common " * 30, "cc") for i in range(2000)] + [(5000 + i, "seldom " * 30, "rr") for i in range(40)]
    rows += [(6000 + i, "enormous " * 4000, "ll") for i in range(2)] + [(6002 + i, "enormous", "ll") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = df.where("lang <> 'll'")
    t, lang = langid.sample(whole)
    assert {len(x) for x in t} == {210}
    count = {x: lang.count(x) for x in set(lang)}
    want = {r["lang"]: r["n"] for r in df.where(langid.fold(5) != 0).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count["rr"] == want["rr"] and 200 < count["cc"] < 400
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 9000)
    t, lang = langid.sample(df)
    assert sum(map(len, t)) <= 9000
    assert lang.count("cc") == count["cc"] and lang.count("rr") == want["rr"] and lang.count("ll") == want["ll"]
    chars = {x: sum(len(a) for a, b in zip(t, lang, strict=True) if b == x) for x in count}
    assert all(n > 2500 for n in chars.values())
    assert (t, lang) == langid.sample(df.repartition(3))


def test_code_switched_words():
    rng = random.Random(4)
    words = {k: ["".join(rng.choices(a, k=6)) for _ in range(80)] for k, a in (("aa", "abcde"), ("bb", "klmno"))}
    texts = [" ".join(rng.choices(words[k], k=40)) for k in ("aa", "bb") * 40]
    m = langid.train(texts, ["aa", "bb"] * 40)
    mixed = rng.choices(words["aa"], k=30) + rng.choices(words["bb"], k=30)
    emit = langid.potentials(m.weights, langid.features(mixed))
    post, _ = langid.forward_backward(langid.chains(np.array([0, 60])), emit, m.steps)
    assert (post.argmax(axis=1) == [0] * 30 + [1] * 30).mean() > 0.95 and m.steps[0, 0] > m.steps[0, 1]


def test_words_are_read_from_end_to_end(spark):
    word = "abcdefghijklmnopqrstuvwxyz0123456789αβγδ"
    for n in range(1, len(word) + 1):
        counts, letters = langid.pieces([word[:n]])
        f = langid.features([word[:n]])
        assert len(f) == counts[0] == len(letters) and letters.sum() == n and (letters > 0).all()
        for i in range(n):  # another character anywhere changes each n-gram that it is in, and the word
            g = langid.features([word[:i] + "ß" + word[i + 1 : n]])
            new = (f[f > 0]).tolist(), (g[g > 0]).tolist()
            gone = len(new[0]) - sum(x in set(new[1]) for x in new[0])
            assert gone >= min(i, n - 3, 2, n - 1 - i) + 2 if n > 3 else gone
    rng = random.Random(4)
    run = lambda a, n: "".join(rng.choices(a, k=n))
    rows = [(i, run("abcde" if i % 2 else "klmno", 200), "aa" if i % 2 else "bb") for i in range(80)]
    mixed = run("abcde", 12) + run("klmno", 600) + run("abcde", 12)
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame([*rows, (99, mixed, None)], "doc_id long, text string, lang string")).collect()}
    assert got[99].lang_pred == "bb" and got[99].score > 0.9
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


def test_disguised_words_are_restored(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices(["idiot", "moron", "the", "tion", "loser", "stupid", "scum", "and", "worthy", "paths", "clown"], k=4000))
    m = toxicity.character_model(spark.createDataFrame([(text,), (None,), ("",)], "text string"))
    for seen, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("stuuupid", "stupid"), ("5cum", "scum"), ("cl0wn", "clown"), ("idiot", "idiot")):
        assert toxicity.viterbi(toxicity.token_lattice(seen), m) == meant
    assert toxicity.viterbi(toxicity.spaced_lattice("moron"), m) == "moron"


def test_long_and_spaced_disguises_are_restored():
    rng = random.Random(1)
    known = ["idiot", "moron", "the", "tion", "loser", "stupid", "scum", "and", "worthy", "paths", "clown"]
    sym = toxicity.SYMBOL[np.frombuffer(" ".join(rng.choices(known, k=4000)).encode(), dtype=np.uint8)]
    counts = np.full((28, 28, 28), 0.01)
    np.add.at(counts, (sym[:-2], sym[1:-1], sym[2:]), 1)
    m = np.log(counts / counts.sum(axis=2, keepdims=True))

    def of(text):
        return [x for b in toxicity.ts.blocks(toxicity.ts.pa.array([text])) for _, x in toxicity.restored(b, m, {})]

    assert of("st" + "u" * 40 + "pid") == ["stupid"] and of("stuuupid") == ["stupid"]
    assert {"moron", "loser", "scum", "clown"} <= set(of("m0r0n_l0$er/the.5cum.and.cl0wn.worthy.paths"))
    token = "".join(rng.choices("abcd0e1", k=700))
    assert all(any(token[i : i + 30] in x for x in toxicity.windows(token)) for i in range(670))
    assert of("ab1" * 100) and len(toxicity.disguised("ab1" * 100)) == 2
    for spaced in ("1 d 1 0 t", "1 d i 0 t", "i d i o t", "1.d.1.0.t"):
        assert "idiot" in of(spaced)
    assert of("1 2 3 4 5 6") == [] and of("") == [] and of("x" + ".,!" * 50000 + "y")


def brute_viterbi(lattice, m):
    best = None

    def walk(i, a, b, s, text):
        nonlocal best
        if i == len(lattice):
            if best is None or (s, text) > best:
                best = (s, text)
            return
        for emit, cost in lattice[i]:
            x, y, t = a, b, s - cost
            for c in emit:
                z = 0 if c == " " else ord(c) - 96
                if z == 0 and y == 0:
                    continue
                t += m[x, y, z]
                x, y = y, z
            walk(i + 1, x, y, t, text + emit)

    walk(0, 0, 0, 0.0, "")
    return best[1].strip()


@pytest.mark.parametrize("token", ["1d10t", "aa1b", "l0$3r", "b00m", "x9", "m00n"])
def test_viterbi_finds_the_best_path(token):
    m = np.log(np.random.default_rng(8).dirichlet(np.ones(28), size=(28, 28)))
    lattice = toxicity.token_lattice(token)
    assert toxicity.viterbi(lattice, m) == brute_viterbi([*lattice, [(" ", 0.0)]], m)


def test_toxic_documents(spark, empty):
    rng = random.Random(6)
    clean = ["".join(rng.choices("abcdefghilmnoprst", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["moron", "idiot", "trash"]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(clean, k=40)
        y = i % 5 == 0
        if y:
            for b in rng.sample(bad, 2):
                w[rng.randrange(40)] = b
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    rows += [(2000, "a few m0r0n words"), (2001, "an i d i o t and so on"), (2002, "quite clean words"), (2003, None), (2004, ""), (None, "moron")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(clashing(df), lab).collect()}
    assert len(got) == len(rows)
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert [got[i].predicted for i in (2000, 2001, 2002, 2003, 2004)] == [1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {r.predicted for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {0}


def brute_rates(rows, p):
    """host_rate and path_rate of each row (host, path) from probabilities, by plain sums without the row itself."""
    def strength(groups, parent):
        k = [(len(v), sum(v), parent[g]) for g, v in groups.items() if len(v) > 1]
        between, within = sum(n * (s / n - q) ** 2 for n, s, q in k), sum(q * (1 - q) for _, _, q in k)
        mass = sum(n * q * (1 - q) for n, _, q in k)
        if not k or not mass:
            return site_quality.STRENGTH[1]
        excess = (between - within) / max(mass - within, 1e-12)
        return float(np.clip(1 / excess - 1, *site_quality.STRENGTH)) if excess > 0 else site_quality.STRENGTH[1]

    hosts, paths = {}, {}
    for (h, q), x in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    world = sum(p) / len(p)
    m = strength(hosts, dict.fromkeys(hosts, world))
    whole = {h: (sum(v) + m * world) / (len(v) + m) for h, v in hosts.items()}
    m2 = strength(paths, {g: whole[g[0]] for g in paths})
    out = []
    for (h, q), x in zip(rows, p, strict=True):
        host = (sum(hosts[h]) - x + m * world) / (len(hosts[h]) - 1 + m)
        out.append((host, (sum(paths[h, q]) - x + m2 * host) / (len(paths[h, q]) - 1 + m2)))
    return out


def test_site_rates_are_shrunk(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(i, int(i % 25 != 9)) for i in range(120)] + [(None, 0)], "doc_id long, quality int")
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    got = site_quality.site_quality(clashing(docs), labels, host, path).collect()
    assert len(got) == len(corpus)
    assert all(r.kept == (r.score >= 0.5) for r in got)
    assert site_quality.site_quality(empty, labels, host, path).count() == 0
    flat = site_quality.site_quality(docs, labels.where("quality = 1"), host, path).collect()
    assert {(r.score, r.kept) for r in flat} == {(0.5, True)}


def test_site_quality_of_held_out_rows(spark):
    """Sites differ in their share of bad texts, which use words of their own; some texts say little."""
    rng = random.Random(8)
    words = {k: ["".join(rng.choices(a, k=rng.randint(3, 8))) for _ in range(150)] for k, a in (("good", "abcdefghi"), ("bad", "ghijklmno"))}
    both = words["good"] + words["bad"]
    rows, truth = [], {}
    for i in range(1500):
        h, q = f"h{i % 5}", f"h{i % 5}/{i % 3}"
        y = int(rng.random() < (0.9 if i % 5 else 0.2))
        truth[i] = y
        own = words["good" if y else "bad"]
        rows.append((i, " ".join([*rng.choices(both, k=10), *rng.choices(own, k=rng.choice([0, 4, 10]))]), h, q))
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, q string")
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 2], "doc_id long, quality int")
    got = site_quality.site_quality(df, labels, F.col("h"), F.col("q")).collect()
    held = [r for r in got if r.held_out]
    auc = lambda f: np.mean([(f(a) > f(b)) + 0.5 * (f(a) == f(b)) for a in held for b in held if truth[a.doc_id] > truth[b.doc_id]])
    assert len(held) > 200 and auc(lambda r: r.score) > 0.8 and auc(lambda r: r.score) > auc(lambda r: r.evidence) + 0.02
    prior = np.log(np.mean([truth[i] for i in truth if i % 2 and site_fold(i) in (3, 4)]) / np.mean([1 - truth[i] for i in truth if i % 2 and site_fold(i) in (3, 4)]))
    site = {r[0]: r[2:] for r in rows}
    rates = brute_rates([site[r.doc_id] for r in got], [1 / (1 + np.exp(-(r.evidence + prior))) for r in got])
    for r, (h, q) in zip(got, rates, strict=True):
        assert r.host_rate == pytest.approx(h) and r.path_rate == pytest.approx(q)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(r.evidence + np.log(q / (1 - q))))))


def site_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5


def test_strength_by_moments(spark):
    rng = np.random.default_rng(5)
    m = 20.0
    p = rng.beta(0.3 * m, 0.7 * m, 4000)
    n = rng.integers(5, 60, 4000)
    df = spark.createDataFrame(list(zip(n.tolist(), rng.binomial(n, p).astype(float).tolist(), [0.3] * 4000, strict=True)), "n long, s double, parent double")
    assert site_quality.strength(df, "n", "s", "parent") == pytest.approx(m, rel=0.25)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    t, fixed = {}, set()
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(t[s] for s in fixed)
        for s in free:
            t[s] = rest * w[s] / sum(w[x] for x in free)
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t
        for s in over:
            t[s] = 3 * sizes[s]
            fixed.add(s)


def test_mix(spark, docs, corpus, empty):
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    got = mixing.taken(clashing(docs)).collect()
    assert len(got) == len(corpus) and sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(5)).collect()))
    source = {r[0]: r[3] for r in corpus}
    total = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        total[s] += r.taken
    largest = {s: max(r["size"] for r in got if source[r.doc_id] == s) for s in sizes}
    for s, t in total.items():
        assert abs(t - want[s]) <= (20 if largest[s] < 500 else largest[s] / 2)
    assert mixing.taken(empty).count() == 0
    rows = mixing.mixed(docs)
    assert rows.columns == [*docs.columns, "__shard", "__order"]
    words = {}
    for r in rows.collect():
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    assert words == {s: t for s, t in total.items() if t}


def brute_mix(rows, shard_words):
    """What is taken of each (id, text, source), by the plan's own rules over plain lists: the same draws and cells."""
    hashed = {(r.doc_id, r.text): (r.h, r.cells) for r in rows}
    blocks = min(mixing.BLOCKS, max(mixing.LEAST_BLOCKS, len(rows) // mixing.ROWS_PER_BLOCK))
    sums, size = {}, {}
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        size[r.doc_id, r.text] = n
        own = sums.setdefault(r.source, {})
        own[r.h % blocks] = own.get(r.h % blocks, 0) + n
    target = brute_targets({s: sum(b.values()) for s, b in sums.items()})
    drawn = mixing.draws(sums, target, max(1, -(-sum(size[r.doc_id, r.text] for r in rows) // shard_words)))
    out = []
    for s in sums:
        whole = {}
        for d in drawn:
            if d.source == s and d.left is None:
                whole[d.block] = whole.get(d.block, 0) + 1
        part = [d.block for d in drawn if d.source == s and d.left is not None]
        left = next((d.left for d in drawn if d.source == s and d.left is not None), 0.0)
        mine = [r for r in rows if r.source == s]
        picked, open_, lone = set(), [(b, 0) for b in part], []
        for level in range(mixing.LEVELS):
            cells = {}
            for r in mine:
                if (r.h % blocks, r.cells[level - 1] if level else 0) in open_:
                    cells.setdefault((r.cells[level], r.h % blocks), []).append(r)
            rest = []
            for (c, b), inside in sorted(cells.items()):
                n = sum(size[r.doc_id, r.text] for r in inside)
                if not n:
                    continue
                if n <= left:
                    picked |= {(r.doc_id, r.text) for r in inside}
                    left -= n
                elif len({r.h for r in inside}) == 1:
                    lone.append((n, c, b, inside))
                else:
                    rest.append((b, c))
            open_ = rest[: mixing.CUT] if left >= 0.5 else []
        if lone:
            n, _, _, inside = min(lone, key=lambda x: (abs(x[0] - left), x[:3]))
            if abs(n - left) < left:
                picked |= {(r.doc_id, r.text) for r in inside}
        out += [(r.doc_id, size[r.doc_id, r.text] * (whole.get(r.h % blocks, 0) + ((r.doc_id, r.text) in picked))) for r in mine]
    return out


def test_draw_against_brute_force(spark, docs, monkeypatch):
    more = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat("text", F.lit(" more"))}))
    for bits in (8, 2):  # few cells: more levels
        monkeypatch.setattr(mixing, "BITS", bits)
        rows = more.select("doc_id", "text", "source", mixing.row_hash().alias("h"), F.array(*[mixing.cell(mixing.row_hash(), i) for i in range(1, mixing.LEVELS + 1)]).alias("cells")).collect()
        got = sorted(((r.doc_id, r.taken) for r in mixing.taken(more).collect()), key=str)
        assert got == sorted(brute_mix(rows, mixing.SHARD_WORDS), key=str)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing.plan, "__defaults__", (500,))
    parts = mixing.mixed(more).withColumn("part", F.spark_partition_id()).groupBy("__shard").agg(F.min("part").alias("a"), F.max("part").alias("b")).collect()
    assert len(parts) > 10 and all(r.a == r.b == r["__shard"] for r in parts)


def test_small_source_takes_three_times_its_size():
    t = mixing.targets({"a": 10, "b": 1000, "c": 10, None: 500})
    assert t == brute_targets({"a": 10, "b": 1000, "c": 10, None: 500}) and t["c"] == 30


def test_splitting_tree_keeps_counts():
    counts = np.array([5, 0, 113, 40])
    out = mixing.split(counts, 7, np.random.default_rng(1))
    assert (out.sum(axis=0) == counts).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 3
