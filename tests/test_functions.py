import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import edits, text as fn
from leafmill.operators import pages


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_classify(spark):
    names = ["book.pdf", "scan.PNG", "notes.txt", "a/b.tiff", "noext", ".pdf", "x.jpeg", "dir.pdf/x"]
    assert column(spark, names, fn.classify) == ["pdf", "image", None, "image", None, None, "image", None]


def test_natural_order(spark):
    names = ["page-10.png", "page-2.png", "page-1.png", "page-01.png", "Page-3.png", "page-99999999999999999999999.png", "page-x.png", "page-"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r.path for r in pages.naturally(df).collect()]
    assert got == ["page-", "page-1.png", "page-01.png", "page-2.png", "Page-3.png", "page-10.png", "page-99999999999999999999999.png", "page-x.png"]


def test_native_needs_twenty_visible_characters(spark):
    assert column(spark, ["a" * 19 + " \n", "a " * 20, None, ""], fn.native) == [False, True, False, False]


def test_tokens_and_case(spark):
    assert column(spark, ["«Hó9a,»", "3rd", "12", "don't!"], fn.core) == ["Hó9a", "rd", "", "don't"]
    assert column(spark, ["«Hó9a,»", "3rd", "12."], fn.trimmed) == ["Hó9a", "3rd", "12"]
    df = spark.createDataFrame([("ABC", "simple"), ("Abc", "simple"), ("abc", "Simple")], "o string, s string")
    assert [r[0] for r in df.select(fn.match_case(F.col("o"), F.col("s"))).collect()] == ["SIMPLE", "Simple", "Simple"]


def test_case_of_letters_without_case(spark):
    df = spark.createDataFrame([("A中", "ab"), ("A1B", "ab"), ("中", "ab"), ("1", "ab"), ("", "ab")], "o string, s string")
    assert [r[0] for r in df.select(fn.match_case(F.col("o"), F.col("s"))).collect()] == ["Ab", "AB", "ab", "ab", "ab"]


def test_names(spark):
    assert column(spark, ["a/b.c.pdf", "a/", "x\\y.png", ".hidden"], fn.stem) == ["b.c", "document", "y", "document"]
    assert column(spark, [7, 1234], fn.page_name, "int") == ["page-007", "page-1234"]
    assert column(spark, [1610612736], fn.gigabytes, "long") == ["1.5 GB"]


def test_halves_of_a_tenth_go_to_the_even_digit(spark):
    sizes = [i << 28 for i in range(40)] + [i * 65536 for i in range(0, 500_000, 997)] + [(1 << 28) - 1, (1 << 28) + 1, -(1 << 28), 1 << 52]
    assert column(spark, sizes, fn.gigabytes, "long") == [f"{x / 2**30:.1f} GB" for x in sizes]
    assert column(spark, [None, 0.25 * 2**30, 0.75 * 2**30], fn.gigabytes, "double") == [None, "0.2 GB", "0.8 GB"]


def plain_cost(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = 10 * (i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            same = edits.GROUP_OF.get(x, -1) == edits.GROUP_OF.get(y, -2)
            d[i][j] = min(d[i - 1][j] + 10, d[i][j - 1] + 10, d[i - 1][j - 1] + (0 if x == y else 4 if same else 10))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 10)
    return d[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcaàảờơ", max_size=7), st.text("abcaàảờơ", max_size=7)), max_size=12))
def test_costs_against_the_plain_table(pairs):
    got = edits.pair_costs([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert got == [plain_cost(a, b) for a, b in pairs]


@pytest.mark.parametrize(("a", "b", "cost"), [("ca", "abc", 30), ("teh", "the", 10), ("smple", "simple", 10), ("ơ", "ờ", 4), ("a", "z", 10), ("", "ab", 20), ("", "", 0)])
def test_known_costs(a, b, cost):
    assert edits.pair_costs([a], [b]).tolist() == [cost]


def test_costs_as_a_column(spark):
    random.seed(1)
    rows = [("".join(random.choices("abcơờ", k=random.randint(0, 6))), "".join(random.choices("abcơờ", k=random.randint(0, 6)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.c for r in df.select(edits.edit_cost(F.col("a"), F.col("b")).alias("c")).collect()] == [plain_cost(a, b) for a, b in rows]


def test_costs_within_a_bound_and_by_pair():
    random.seed(3)
    make = lambda: "".join(random.choices("abcơờ", k=random.randint(0, 12)))
    pairs = [(make(), make()) for _ in range(400)]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    full = edits.pair_costs(a, b)
    near = edits.pair_costs(a, b, most=30)
    assert all(x == y if x <= 30 else y > 30 for x, y in zip(full, near, strict=True))
    flags = [i % 2 == 0 for i in range(400)]
    plain = edits.pair_costs(a, b, False)
    assert edits.pair_costs(a, b, edits.np.array(flags)).tolist() == [x if f else y for f, x, y in zip(flags, full, plain, strict=True)]


def changed(rng, word, k):
    for _ in range(k):
        i, kind = rng.randrange(len(word) + 1), rng.randrange(4)
        if kind == 0:
            word = word[:i] + rng.choice("abcde") + word[i:]
        elif kind == 1:
            word = word[:i] + word[i + 1 :]
        elif kind == 2:
            word = word[:i] + rng.choice("abcde") + word[i + 1 :]
        else:
            word = word[:i] + word[i : i + 2][::-1] + word[i + 2 :]
    return word


def test_near_words_meet_on_a_deletion_key():
    """Whatever up to k edits do to a word, also beyond the first letters that keys are made of."""
    rng = random.Random(5)
    for _ in range(1500):
        a = "".join(rng.choices("abcde", k=rng.randint(1, 18)))
        k = 1 if len(a) <= 3 else 2 if len(a) <= 6 else 3
        b = changed(rng, a, rng.randint(0, k))
        if not b or plain_cost(a, b) > 10 * k:
            continue
        salt = edits.np.zeros(1, dtype=edits.np.uint64)
        sides = []
        for w in (a, b):
            _, key, own = edits.deletion_keys([w], edits.np.array([k]), salt)
            sides.append({(x, o) for x, o in zip(key.tolist(), own.tolist(), strict=True)})
        assert any(x == y and (o or p) for x, o in sides[0] for y, p in sides[1]), (a, b)
    _, key, _ = edits.deletion_keys(["abcdefghijklmnop"], edits.np.array([3]), edits.np.zeros(1, dtype=edits.np.uint64))
    assert len(key) == 299
