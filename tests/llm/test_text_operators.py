"""Operators that the words or bytes of texts decide: against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import chatformat, decontamination, mixing, neardup, quality_rules, repeats, superminhash, textscan, tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df):
    """Further columns with names that the operators use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("kept", "score", "id", "row", "__text", "size", "h")})


def key(row):
    return tuple((x is None, x) for x in row)


# -- repeats


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        x = (t or "").encode()
        for i in range(len(x) - 49) if d is not None else ():
            k = x[i : i + 50]
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 49) if d is not None else ():
            if first[x[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=key)


def test_repeats(docs, corpus, empty):
    got = sorted(map(tuple, repeats.remove_repeats(clashing(docs)).collect()), key=key)
    assert got == brute_repeats([r[:2] for r in corpus])
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_over_random_joins(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(30, 300))) for _ in range(6)]
    rows = []
    for d in range(80):
        parts = [rng.choice([rng.choice(base), "".join(rng.choices("xyz", k=rng.randint(1, 40))), rng.choice(base)[rng.randint(0, 40) : rng.randint(40, 200)], "for " * rng.randint(1, 60), "a" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 5))]
        rows.append((d // 2 if d % 9 == 0 else d, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == brute_repeats(rows)


def test_many_texts_of_one_id(spark):
    """Rows of one id with different texts, enough of them for a short hash of the text to fall together."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdef", k=70))
    rows = [(1, passage)] + [(2, "".join(rng.choices("xyz", k=rng.randint(0, 30))) + (passage if i % 2 else "") + str(i)) for i in range(600)]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == brute_repeats(rows)


def test_intervals_are_the_maximal_repeats():
    text = "banana$bandana$ananas$"
    n = len(text)
    sa = sorted(range(n), key=lambda i: text[i:])
    lcp = [0] + [next(k for k in range(n + 1) if text[a : a + k + 1] != text[b : b + k + 1] or max(a, b) + k >= n) for a, b in zip(sa, sa[1:])] + [0]  # noqa: RUF007
    got = {(text[sa[a] : sa[a] + size], z - a + 1) for a, z, size, _ in repeats.intervals(lcp, [0] * n, [ord(text[i - 1]) if i else -1 for i in sa], 2)}
    want = set()
    for i in range(n):
        for j in range(i + 2, n + 1):
            s = text[i:j]
            at = [k for k in range(n) if text.startswith(s, k)]
            if len(at) > 1 and (len({text[k - 1] if k else None for k in at}) > 1) and len({text[k + len(s) : k + len(s) + 1] for k in at}) > 1:
                want.add((s, len(at)))
    assert got == want


# -- near duplicates


def brute_components(rows):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(sets[i]), root(d) if d is not None else None, d is None or root(d) == d) for i, (d, _) in enumerate(rows)), key=key)


def test_near_duplicates(docs, corpus, empty):
    got = sorted(map(tuple, neardup.near_duplicates(clashing(docs)).collect()), key=key)
    assert got == brute_components([r[:2] for r in corpus])
    assert neardup.near_duplicates(empty).count() == 0


def test_one_of_each_component_stays(docs, corpus):
    kept = neardup.without_duplicates(docs).collect()
    want = Counter(x[2] for x in brute_components([r[:2] for r in corpus]) if x[2] is not None)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert set(map(tuple, kept)) <= {tuple(r) for r in corpus}


def test_further_columns_of_any_name_stay(spark, docs, corpus):
    odd = docs.withColumns({c: F.lit(i) for i, c in enumerate(("__id", "id", "key", "row", "__nth", "kept", "__h", "__source", "__shard", "__size", "__block", "nth"))}).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    odd = odd.unionByName(odd.where("doc_id = 6"))
    before = {r.doc_id: r for r in odd.collect()}
    kept = neardup.without_duplicates(odd).collect()
    assert all(r == before[r.doc_id] for r in kept) and sum(r.doc_id == 6 for r in kept) <= 1
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(r.doc_id for r in neardup.without_duplicates(docs).collect() if r.doc_id is not None)
    mix = mixing.mixed(odd)
    assert mix.columns == [*odd.columns, "__order"] and all(tuple(r)[:-1] == tuple(before[r.doc_id]) for r in mix.collect())


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """A chain of near copies in one bucket, with the small-bucket step taken away, so that the block search does it."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    monkeypatch.setattr(neardup, "QUERY_BYTES", 4000)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(60)]
    rows = []
    for i in range(40):
        w = list(words)
        for k in rng.sample(range(60), rng.choice([1, 1, 2, 3, 4])):
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows)


def test_signatures_against_the_sequential_method():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 3, 50, 200, 700]
    doc, h = np.repeat(np.arange(6), sizes), textscan.mix(rng.integers(0, 2**63, sum(sizes), dtype=np.uint64))
    got = superminhash.signatures(doc, h, 6, 128)
    for d in range(6):
        sig = [2**64 - 1] * 128
        for x in h[doc == d].tolist():
            p = list(range(128))
            for j in range(128):
                r = x if j == 0 else int(textscan.mix(np.array([(x + 0x9E3779B97F4A7C15 * j) % 2**64], dtype=np.uint64))[0])
                k = j + (((r >> 40) * (128 - j)) >> 24)
                p[j], p[k] = p[k], p[j]
                sig[p[j]] = min(sig[p[j]], (j << 40) + (r & ((1 << 40) - 1)))
        assert got[d].tolist() == sig


def test_components_of_long_paths(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(101, 100)], "a long, b long").repartition(7)
    got = dict(map(tuple, neardup.components(edges).collect()))
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


# -- quality rules


def brute_counts(t):
    w = WORD.findall(t or "")
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(inside)


@pytest.mark.parametrize("broadcast", [quality_rules.BROADCAST_IDS, 3])
def test_quality_counts_and_ratio(spark, docs, corpus, empty, broadcast, monkeypatch):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", broadcast)  # beyond it labels are joined by shuffle
    labels = spark.createDataFrame([(i, int(i % 25 != 9), 0) for i in range(0, 120, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(clashing(docs), labels).collect()), key=key)
    want = []
    for r in corpus:
        c = brute_counts(r[1])
        want.append((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want, key=key)
    trusted = {i for i in range(0, 120, 2) if i % 25 != 9}
    counts = {True: Counter(), False: Counter()}
    ids = {}
    for b in textscan.blocks(pa.array([r[1] for r in corpus])):
        doc, c = quality_rules.ngrams(textscan.words(b))
        for d, x in zip(doc.tolist(), c.tolist(), strict=True):
            counts[False][x] += 1
            counts[True][x] += corpus[b.first + d][0] in trusted
            ids.setdefault(b.first + d, []).append(x)
    n, m, s = sum(counts[False].values()), sum(counts[True].values()), quality_rules.SMOOTH
    k = quality_rules.BUCKETS
    ratio = lambda x: np.log((counts[True][x] + s) / (m + s * k)) - np.log((counts[False][x] + s) / (n + s * k))
    llr = {}
    for i, v in ids.items():
        llr.setdefault(corpus[i][0], np.mean([ratio(x) for x in v]))
    for r in quality_rules.quality_rules(docs, labels).collect():
        assert r.llr == pytest.approx(llr.get(r.doc_id, 0.0))
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.MIN_LLR)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert {r.llr for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


# -- decontamination


def test_reordered_and_partial_passages(spark, docs, empty):
    rng = random.Random(9)
    item = ["".join(rng.choices("pqrstuv", k=5)) for _ in range(40)]
    parts = [item[:14], item[14:27], item[27:]]
    other = lambda n: ["".join(rng.choices("efghij", k=5)) for _ in range(n)]
    texts = {
        1: " ".join(other(30) + item + other(30)), 2: " ".join(other(10) + parts[2] + other(5) + parts[0] + other(5) + parts[1]), 3: " ".join(other(20) + item[:12] + other(20)),
        4: " ".join(other(50)), 5: ", ".join(item).upper(), 6: None, 7: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None), (13, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(clashing(df), bench).collect()}
    assert {d for d, r in got.items() if r.contaminated} == {1, 2, 5} == {d for d, r in got.items() if not r.kept}
    assert (got[2].n_tiles, got[2].covered, got[2].best_item) == (3, 40, 10) and got[3].covered == 12
    assert got[6].best_item is None and got[4].n_tiles == 0
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == [3, 4, 6, 7]
    assert decontamination.decontaminate(docs, bench.limit(0)).where("not kept").count() == 0
    assert decontamination.decontaminate(empty, bench).count() == 0


def brute_tiles(a, b, k):
    """Longest unmarked common run first; ties by the place in b, then in a."""
    ma, mb, out = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        out.append(best)
        ma |= set(range(best[1], best[1] + best[0]))
        mb |= set(range(best[2], best[2] + best[0]))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    a, b, k = [rng.choice("abc") for _ in range(60)], [rng.choice("abc") for _ in range(25)], 4
    p, q = zip(*[(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]] or [(0, 0)], strict=True)
    if a[p[0] : p[0] + k] != b[q[0] : q[0] + k]:
        return
    got = decontamination.tiles(np.array(p), np.array(q), len(a), len(b), k)
    assert sum(t[0] for t in got) == sum(t[0] for t in brute_tiles(a, b, k))


@pytest.mark.parametrize("seed", range(12))
def test_searched_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    a, b = [rng.choice("abc"[: 2 + seed % 2]) for _ in range(50)], [rng.choice("abc"[: 2 + seed % 2]) for _ in range(25)]
    code = lambda x: np.array([ord(c) for c in x], dtype=np.uint64)
    assert decontamination.searched(code(a), code(b), 4) == brute_tiles(a, b, 4)
    assert decontamination.searched(code(a), code([]), 4) == [] == decontamination.searched(code("xyz"), code("xyz"), 4)


def brute_scan(texts, items, k=4):
    out = {}
    for d, t in enumerate(texts):
        a = re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).split()
        for i, u in items:
            b = re.sub(r"[!-/:-@\[-`{-~]", " ", (u or "").lower()).split()
            if not b:
                continue
            if len(b) < k:
                got = [(len(b), 0, 0)] if (a == b or (len(b) > 1 and any(a[j : j + len(b)] == b for j in range(len(a))))) else []
            else:
                got = brute_tiles(a, b, k)
            n = sum(x[0] for x in got)
            if got:
                old = out.get(d)
                better = old is None or (n / len(b), n, -i) > (old[4], old[3], -old[1])
                out[d] = ((old[0] if old else 0) + 1, *((i, len(got), n, n / len(b)) if better else old[1:]))
    return out


@pytest.mark.parametrize("most", [1 << 20, 40, 1])
def test_whole_documents_against_brute_force(monkeypatch, most):
    """Short items, periodic texts, several items a document; and the same with next to no room for matches."""
    monkeypatch.setattr(decontamination, "MATCHES", most)
    rng = random.Random(4)
    words = ["ab", "cd", "ef", "gh"]
    texts = [None, "", "what is pi", "so what is Pi, really", "the", "the the", "ab " * 30] + [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(25)]
    items = [(5, "What is pi?"), (6, "the"), (7, ""), (8, None), (9, "ab " * 12), (3, "cd ef")] + [(20 + i, " ".join(rng.choices(words, k=rng.randint(4, 12)))) for i in range(8)]
    x = decontamination.index(np.array([i for i, _ in items]), pa.array([t for _, t in items]))
    got = {}
    for b in textscan.blocks(pa.array(texts), 200):
        got |= {b.first + d: r for d, r in decontamination.scan(b, x).items()}
    assert got == brute_scan(texts, items)
    assert got[2][1] == 5 == got[3][1] and got[4][1] == 6 and 5 not in got


def test_rows_of_one_id_in_slices(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta"
    df = spark.createDataFrame([(1, f"x {item} y"), (1, "harmless words here"), (1, "harmless words here"), (None, item), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, item if i == 1 else f"other words of item number {i} here") for i in range(4)], "item_id long, text string")
    one = sorted(map(tuple, decontamination.decontaminate(df, bench).collect()), key=key)
    monkeypatch.setattr(decontamination.slices, "__defaults__", (50,))
    assert len(list(decontamination.slices(bench))) > 1
    assert sorted(map(tuple, decontamination.decontaminate(df, bench).collect()), key=key) == one


def test_benchmark_in_slices(spark, docs, corpus, monkeypatch):
    bench = spark.createDataFrame([(i, corpus[i * 3][1]) for i in range(12)], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.decontaminate(docs, bench).select("doc_id", "n_items", "covered", "kept").distinct().collect()), key=key)
    monkeypatch.setattr(decontamination, "slices", lambda b: [next(iter(old(b.where(f"item_id % 3 = {i}")))) for i in range(3)])
    cut = sorted(map(tuple, decontamination.decontaminate(docs, bench).select("doc_id", "n_items", "covered", "kept").distinct().collect()), key=key)
    assert whole == cut


old = decontamination.slices

# -- tokens


def test_store_round_trip(spark, docs, corpus, empty, tmp_path):
    tok = Tokenizer.from_file(PATH)
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(clashing(docs), path, PATH)
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        at += len(ids)
    got = sorted(map(tuple, tokenstore.read_index(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    ids = {(r.doc_id, r.start): r.ids for r in tokenstore.read_ids(spark, path).collect()}
    assert all(zlib.crc32(np.array(ids[d, s], "<u4").tobytes()) == c for d, s, _, c, _ in want)
    kept = spark.read.parquet(f"{path}/chunks").where("ids is not null")
    assert kept.count() == kept.select("digest").distinct().count() == kept.where("held").count()
    tokenstore.write_store(empty, f"file://{tmp_path}/none", PATH)
    assert tokenstore.read_index(spark, f"file://{tmp_path}/none").count() == 0


def test_damage_shows(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(5)], "doc_id long, text string")
    tokenstore.write_store(df, path, PATH)
    c = spark.read.parquet(f"{path}/chunks").toPandas()
    c.loc[0, "ids"] = b"\0\0" + c.loc[0, "ids"][2:]
    spark.createDataFrame(c, spark.read.parquet(f"{path}/chunks").schema).write.parquet(f"{tmp_path}/other")
    import shutil

    shutil.rmtree(f"{path}/chunks")
    shutil.move(f"{tmp_path}/other", f"{path}/chunks")
    assert tokenstore.read_index(spark, path).where("not verified").count() == 1
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read_ids(spark, path).collect()


def rewritten(spark, path, name, change):
    """A store's table read, changed, and put in its place."""
    import shutil

    df = spark.read.parquet(f"{path}/{name}")
    spark.createDataFrame(change(df.toPandas()), df.schema).write.parquet(f"{path}-new")
    shutil.rmtree(f"{path}/{name}")
    shutil.move(f"{path}-new", f"{path}/{name}")


def test_lost_and_surplus_parts_show(spark, tmp_path):
    import shutil

    rng = random.Random(1)
    texts = [" ".join(rng.choices(["one", "two", "three", "four", "five"], k=3000)) if i == 2 else f"text number {i}" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = f"{tmp_path}/store"
    tokenstore.write_store(df, path, PATH)
    whole = {r.doc_id: r.ids_crc32 for r in tokenstore.read_index(spark, path).collect()}
    owner = {bytes(d): r.doc_id for r in spark.read.parquet(f"{path}/recipes").collect() for d in [c.digest for c in r.chunks]}

    def lost(chunks):
        return chunks[[owner[bytes(d)] not in (0, 2) or (owner[bytes(d)] == 2 and i % 2 == 0) for i, d in enumerate(chunks.digest)]]

    one = f"{tmp_path}/lost"
    shutil.copytree(path, one)
    rewritten(spark, one, "chunks", lost)
    got = {r.doc_id: r for r in tokenstore.read_index(spark, one).collect()}
    assert set(got) == set(whole) and {d for d, r in got.items() if not r.verified} == {0, 2}
    assert got[0].ids_crc32 is None and got[2].ids_crc32 is None and all(got[d].ids_crc32 == whole[d] for d in (1, 3, 4, 5))
    with pytest.raises(ValueError, match="missing"):
        tokenstore.read_ids(spark, one)

    import pandas as pd

    for change in (lambda c: pd.concat([c, c[c.held].head(1)]), lambda c: pd.concat([c, c[c.held].head(1).assign(digest=[b"x" * 16])])):
        two = f"{tmp_path}/more{change(spark.read.parquet(f'{path}/chunks').toPandas()).digest.nunique()}"
        shutil.copytree(path, two)
        rewritten(spark, two, "chunks", change)
        for read in (tokenstore.read_index, tokenstore.read_ids):
            with pytest.raises(ValueError, match="twice or in no recipe"):
                read(spark, two)

    three = f"{tmp_path}/norecipes"
    shutil.copytree(path, three)
    rewritten(spark, three, "recipes", lambda r: r[:0])
    for read in (tokenstore.read_index, tokenstore.read_ids):
        with pytest.raises(ValueError, match="recipe files that are missing"):
            read(spark, three)
    four = f"{tmp_path}/manifest"
    shutil.copytree(path, four)
    shutil.rmtree(f"{four}/manifest")
    import json

    m = tokenstore.read_manifest(spark, path)
    spark.createDataFrame([(json.dumps(m | {"files": []}),)], "value string").coalesce(1).write.text(f"{four}/manifest")
    with pytest.raises(ValueError, match="root"):
        tokenstore.read_index(spark, four)


def test_encoder_on_odd_white_space():
    rng = random.Random(1)
    tok = Tokenizer.from_file(PATH)
    enc = tokenstore.Encoder(open(PATH, "rb").read())
    alphabet = [" ", "  ", "\n", "\t", "a", "b.", "é", "'s", "1", "<|endoftext|>", "\x1c", "\x85", "\r", " ", " ", "word", " d"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(3000)]
    for b in textscan.blocks(pa.array(texts), 20000):
        ids, bounds = enc.encode(b)
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.encode(texts[b.first + i], add_special_tokens=False).ids


def test_chunks_follow_the_content():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50000, 20000).astype("<u2")
    b = np.concatenate([a[:5000], rng.integers(0, 50000, 7).astype("<u2"), a[5000:]])
    parts = [{bytes(x[s:e].tobytes()) for s, e in zip([0, *tokenstore.cuts(x)], tokenstore.cuts(x), strict=False)} for x in (a, b)]
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])


def test_crc_of_joined_parts():
    rng = random.Random(3)
    for _ in range(20):
        parts = [rng.randbytes(rng.randint(0, 900)) for _ in range(4)]
        after = [sum(map(len, parts[i + 1 :])) for i in range(4)]
        moved = tokenstore.crc_shift(np.array([zlib.crc32(p) for p in parts]), np.array(after))
        assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


# -- chat format


def test_chat_round_trip(spark):
    rng = random.Random(2)
    alphabet = ["<|", "im_end", "im_start", "|>", "\\", "\\\\", "\n", "<|im_end|>", "<|im_start|>", "a é", "<|\\im_end|>", "<|endoftext|>", "assistant", " ", "\t"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "a\\nb", None, "<|im_end|>"]), rng.choice([None, "", "".join(rng.choices(alphabet, k=rng.randint(1, 12)))])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "no id"), (99, None, "user", "no turn"), (99, 1, "assistant", "yes"), (99, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in chatformat.read_back(chatformat.format_conversations(clashing(df), PATH), PATH).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        full = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = sum(len("<|im_start|><|im_end|>") + len(chatformat.escape_role(r[2] or "")) + len(chatformat.escape(r[3] or "")) + 2 for r in own)
        assert got[c] == (len(own), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    assert chatformat.read_back(chatformat.format_conversations(df.limit(0), PATH), PATH).count() == 0


@pytest.mark.parametrize("text", ["<|im_end|>", "<|\\im_start|>", "<|\\\\im_end|> x <|im_end", "plain"])
def test_escapes(text):
    assert chatformat.unescape(chatformat.escape(text)) == text and not re.search(r"<\|im_(start|end)\|>", chatformat.escape(text))
