import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in every column, empty, blank, short and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    langs = {k: ["".join(rng.choices(a, k=rng.randint(1, 7))) for _ in range(300)] for k, a in (("aa", "abcdeé"), ("bb", "klmnoß"))}
    rows = []
    passage = prose(rng, 60, langs["aa"])
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        t = prose(rng, rng.randint(3, 120), langs[lang])
        if i % 10 == 4:
            t += "\n" + passage
        if i % 10 == 7 and rows:
            t = rows[-1][1]
        if i % 10 == 8 and rows:
            w = (rows[-2][1] or "x").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 25 == 9:
            t = "same same same same line\n" * 40
        rows.append((i, t, lang if i % 11 else None, f"s{i % 4}" if i % 13 else None, len(t)))
    rows += [(200, None, "aa", "s0", None), (201, "", "aa", "s1", 0), (202, " \n\t ", None, None, 4), (203, "one", "aa", "s2", 3), (204, "x" * 3000, "bb", "s3", 3000), (205, "12 34 5%", "aa", "s0", 8), (None, "text without an id here", "aa", "s1", 23), (206, prose(rng, 4000, langs["aa"]), "aa", "s1", 1)]
    rows.append(rows[5])
    rows += [(300 + i, rows[1][1], "aa", "s2", 1) for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
