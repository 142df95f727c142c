import random
import stat

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions.edits import keyed
from leafmill.operators import export, imaging, jobs, lexicon, pages, recognition, spelling, structure
from leafmill.scratch import bloom, saved
from leafmill.sources import files, tools
from tests.test_functions import plain_cost


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_words_are_parsed(spark):
    f = lambda conf, text: "\t".join(["5", "1", "1", "1", "2", "0", "0", "0", "9", "9", conf, text])
    head = "\t".join(["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"])
    lines = [head, f("90", "Hello"), f("-1", "x"), f("80", " "), f("n/a", "y"), "5\t1\t1", f("0", "z")]
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    assert rows(pages.parse_words(df), "pos") == [(1, 1, 1, 2, 90.0, "Hello"), (6, 1, 1, 2, 0.0, "z")]


def test_lines_and_confidence(spark):
    w = [("d", 0, 1, 1, 1, 90.0, "Hello"), ("d", 1, 1, 1, 1, 80.0, "world"), ("d", 2, 1, 1, 2, 70.0, "Next"), ("d", 3, 1, 1, 1, 80.0, "again")]
    df = spark.createDataFrame(w, "doc string, pos long, block long, par long, line long, conf double, text string")
    every = spark.createDataFrame([("d",), ("empty",)], "doc string")
    got = rows(pages.page_result(pages.lines_of(df, ["doc"]), every, ["doc"]), "doc")
    assert got[0][1] == "Hello world\nNext\nagain" and got[0][2] == pytest.approx(0.8)
    assert got[1] == ("empty", "", 0.0)


def test_warnings_are_strict_at_a_half(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.49), ("", 0.0)], "t string, c double")
    assert [r[0] for r in df.select(pages.warnings(F.col("t"), F.col("c"))).collect()] == [[], ["low_confidence"], ["low_confidence", "no_text_detected"]]


def test_languages(spark):
    df = spark.createDataFrame([("vie", ["eng"]), ("auto", ["eng", "vie"]), (None, []), ("", ["vie"])], "s string, i array<string>")
    assert [r[0] for r in df.select(pages.resolve_language(F.col("s"), F.col("i"))).collect()] == ["vie", "eng+vie", "eng", "vie"]


def pool(spark, words):
    df = spark.createDataFrame(words, "word string, n long")
    return df.select("word", "n", F.lower("word").alias("low"), F.length("word").alias("len"), (F.lower("word") != F.col("word")).alias("caps"))


def test_suggestions(spark):
    p = pool(spark, [("simple", 100), ("smile", 5), ("definitely", 3), ("hóa", 2), ("hòa", 9), ("once", 1)])
    w = spark.createDataFrame([("smple",), ("definately",), ("hỏa",), ("xzqvvt",), ("once",), ("",)], "word string")
    got = dict((r[0], r[1:]) for r in rows(spelling.best(spelling.candidates(w, p))))
    assert got == {"smple": ("simple", 10), "definately": ("definitely", 10), "hỏa": ("hòa", 4)}  # once is itself: no suggestion


def test_suggestions_against_brute_force(spark):
    import random

    random.seed(4)
    make = lambda: "".join(random.choices("abcơờeé", k=random.randint(1, 8)))
    words, stock = sorted({make() for _ in range(60)}), sorted({make() for _ in range(300)})
    freq = {x: random.randint(1, 5) for x in stock}
    got = dict((r[0], r[1:]) for r in rows(spelling.best(spelling.candidates(spark.createDataFrame([(w,) for w in words], "word string"), pool(spark, list(freq.items()))))))
    want = {}
    for w in words:
        most = 10 if len(w) <= 3 else 20 if len(w) <= 6 else 30
        keys = [(c, -freq[x], w[0] != x[0], abs(len(x) - len(w)), False, x) for x in stock if abs(len(x) - len(w)) <= most // 10 and (c := plain_cost(w, x)) <= most]
        if keys and min(keys)[0] > 0:
            want[w] = (min(keys)[-1], min(keys)[0])
    assert got == want
    tiered = spelling.suggest(spark.createDataFrame([(w,) for w in words], "word string"), pool(spark, list(freq.items())))
    assert dict((r[0], r[1:]) for r in rows(tiered)) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_not_broadcast(spark):
    """A word makes hundreds of key rows, which the size of its table says nothing of."""
    w = saved(spark.createDataFrame([("definately",)], "word string"), "w")  # a table, so that its size is known
    index = saved(spark.createDataFrame([("definitely", 3)], "word string, n long"), "index")
    joins = [x for x in plan(spelling.candidates(w, index)).splitlines() if "Join [key#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_only_wanted_keys_leave_the_worker(spark):
    w = spark.createDataFrame([(1, 5, "definately", 3), (2, 5, "elephantine", 3)], "id long, salt long, word string, edits int")
    every = keyed(w)
    some = keyed(w, bloom(every.where("id = 1"), "key")).collect()
    assert {tuple(r) for r in some} >= {tuple(r) for r in every.where("id = 1").collect()}
    assert sum(r.id == 2 for r in some) < every.where("id = 2").count() / 10


def test_dearer_tiers_are_searched_for_what_is_left(spark, monkeypatch):
    seen = []
    real = spelling._priced

    def priced(words, *rest):
        seen.append(sorted((r.lang or "", r.word) for r in words.collect()))
        return real(words, *rest)

    monkeypatch.setattr(spelling, "_priced", priced)
    w = spark.createDataFrame([("en", "abcdefgx"), ("en", "abcdexyh"), ("en", "abcdwxyh"), ("en", "zzzzzzzz"), ("en", "same"), (None, "abcdefgx"), (None, "nul")], "lang string, word string")
    index = spark.createDataFrame([("en", "abcdefgh", 3), ("en", "same", 1), ("en", "sane", 9), (None, "abcdefgh", 1), (None, "nil", 1)], "lang string, word string, n long")
    got = {(r.lang, r.word): (r.suggestion, r.cost) for r in spelling.suggest(w, index, confused=()).collect()}
    assert got == {("en", "abcdefgx"): ("abcdefgh", 10), ("en", "abcdexyh"): ("abcdefgh", 20), ("en", "abcdwxyh"): ("abcdefgh", 30), (None, "abcdefgx"): ("abcdefgh", 10), (None, "nul"): ("nil", 10)}
    assert [len(x) for x in seen] == [7, 3, 2] and seen[2] == [("en", "abcdwxyh"), ("en", "zzzzzzzz")]


def scan(tokens, cap):
    """The two lists as a loop over tokens (core, suggestion) fills them."""
    out, seen, counts = [], set(), {True: 0, False: 0}
    for i, (core, s) in enumerate(tokens):
        if core not in seen:
            seen.add(core)
            out.append((i, core, s))
            counts[s is None] += 1
            if counts[s is None] >= cap:
                break
    return out


@pytest.mark.parametrize("cap", [1, 2, 3, 50])
def test_caps_stop_the_whole_scan(spark, cap):
    import random

    random.seed(cap)
    pages_ = {p: [(w, None if ord(w[0]) % 2 else w + "!") for w in random.choices("abcdefghij", k=20)] for p in range(5)}
    df = spark.createDataFrame([(p, i, c, s) for p, t in pages_.items() for i, (c, s) in enumerate(t)], "page long, idx long, core string, suggestion string")
    got = rows(spelling.capped(df, ["page"], cap).select("page", "idx", "core", "suggestion"), "page", "idx")
    assert got == [(p, *x) for p, t in sorted(pages_.items()) for x in scan(t, cap)]


def test_flagged_keeps_one_at_cap_zero(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "b"), (1, 2, "c")], "page long, idx long, core string")
    assert rows(spelling.flagged(df, ["page"], 0).select("idx", "core")) == [(0, "b")]


def test_lexicon(spark):
    d = spark.createDataFrame([("en", "The the cat 3rd"), ("en", "cat the"), ("vi", "hóa")], "lang string, text string")
    f = lexicon.frequencies(d)
    assert rows(f, "lang", "word") == [("en", "cat", 2), ("en", "the", 3), ("vi", "hóa", 1)]
    assert rows(lexicon.scores(f), "lang", "word") == [("en", "cat", 1), ("en", "the", 2), ("vi", "hóa", 1)]
    lines = spark.createDataFrame([(0, "3"), (1, "The/AB"), (2, "x9"), (3, "it's"), (4, "")], "no int, line string")
    dic = lexicon.parse_dictionary(lines)
    assert rows(dic, "word") == [("The",), ("it's",)]
    assert rows(lexicon.word_index(dic, f.groupBy("word").agg(F.sum("n").alias("n"))), "word") == [("The", 3, 3), ("cat", 2, 3), ("hóa", 1, 3), ("it's", 0, 4), ("the", 3, 3)]


def test_job_states(spark):
    df = spark.createDataFrame([("a", 1, "completed"), ("a", 2, "completed"), ("b", 2, "failed"), ("b", 1, "failed"), ("b", 3, "completed")], "doc string, page long, status string")
    assert rows(jobs.state(df, ["doc"]), "doc") == [("a", 2, 2, [], "COMPLETED"), ("b", 3, 1, [1, 2], "COMPLETED_WITH_WARNINGS")]


def test_resume_does_only_what_failed(spark):
    p = spark.createDataFrame([("x", i) for i in range(1, 6)], "document_path string, page long")
    docs = spark.createDataFrame([("x", 5)], "document_path string, total_pages long")
    old = spark.createDataFrame([("x", 5, i, "failed" if i in (2, 4) else "completed") for i in range(1, 6)], "document_path string, total_pages long, page long, status string")
    done = jobs.usable(old, docs)
    assert rows(jobs.pending(p, done), "page") == [("x", 2), ("x", 4)]
    again = jobs.resumed(p, done)
    assert [r.how for r in again.orderBy("page").collect()] == ["reused", "processed", "reused", "processed", "reused"]
    foreign = old.withColumn("total_pages", F.lit(6).cast("long"))
    assert jobs.pending(p, jobs.usable(foreign, docs)).count() == 5
    e = jobs.events(again.withColumn("total", F.lit(5)).withColumn("status", F.lit("completed")), ["document_path"])
    assert e.count() == 3 + 4


def test_markdown_keeps_empty_pages(spark):
    df = spark.createDataFrame([("d", 2, None), ("d", 1, "one")], "doc string, page long, text string")
    assert export.markdown(df, "doc").first().markdown == "<!-- page 1 -->\n\none\n\n<!-- page 2 -->\n\n\n\n"


def test_prefixed_warnings(spark):
    df = spark.createDataFrame([(["a:x", "a:y:z", "a:x", "b:q"],)], "w array<string>")
    assert df.select(export.prefixed(F.col("w"), "a:")).first()[0] == ["x", "y"]


def test_binarise(spark):
    df = spark.createDataFrame([(1, x, y, 220 if x < 10 else 40) for x in range(20) for y in range(20)], "image_id long, x long, y long, v long")
    out = imaging.binarise(df)
    assert {r.out for r in out.collect()} <= {0, 255} and out.count() == 400
    s = {(r.x, r.y): r for r in imaging.box(df, 3).collect()}
    near = [220 if x < 10 else 40 for x in range(6, 13) for y in range(0, 4)]
    assert s[9, 0].mean == pytest.approx(sum(near) / len(near))


def test_provider_errors_stay_with_their_page(spark):
    def provider(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode(), 0.9, []

    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "page long, content binary")
    assert rows(recognition.recognise(df, ["page"], provider), "page") == [(1, "ok", 0.9, [], None), (2, "", 0.0, ["unreadable"], "unreadable")]


def test_sources(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for n in ("a10.pdf", "a2.PDF", "sub/x.png", "sub/n.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    found = pages.naturally(pages.discover(files.files(spark, str(tmp_path / "in"))))
    assert [r.path.rsplit("/in/")[1] for r in found.collect()] == ["a2.PDF", "a10.pdf", "sub/x.png"]
    (tmp_path / "en.txt").write_text("the\nof\nThe\n")
    assert rows(files.scored_lines(files.numbered(spark, str(tmp_path / "en.txt"))), "word") == [("of", 2), ("the", 1)]
    (tmp_path / "vi.tsv").write_text("hóa\t5\nbad\nx\ty\n")
    assert rows(files.counted_lines(files.numbered(spark, str(tmp_path / "vi.tsv")))) == [("hóa", 5)]
    (tmp_path / "langs").write_text("List of languages\neng\nosd\n\nvie\n")
    assert rows(files.installed_languages(files.numbered(spark, str(tmp_path / "langs"))), "lang") == [("eng",), ("vie",)]


def test_error_rates_and_headings(spark):
    df = spark.createDataFrame([("a b c d", "a x c d"), ("", "abc")], "r string, t string")
    assert [r[0] for r in df.select(structure.word_error_rate(F.col("r"), F.col("t"))).collect()] == [0.25, 1.0]
    lines = spark.createDataFrame([("Chapter 3 x",), ("Chương 2",), ("第3章",), ("1.2 Intro",), ("text",)], "l string")
    assert [r[0] for r in lines.select(structure.heading(F.col("l"))).collect()] == ["en", "vi", "ja_zh", "numbered", None]


def test_known_words_by_language_and_spelling(spark):
    freq = spark.createDataFrame([("en", "once", 1), ("vie", "hóa", 1), ("vie", "hòa", 2)], "lang string, word string, n long")
    words = lexicon.known(freq, spark.createDataFrame([("Paris",), ("NASA",)], "word string"))
    assert [r.word for r in words.orderBy("word").collect()] == ["NASA", "Paris", "hòa", "once"]
    t = spark.createDataFrame([(x,) for x in ("Once", "ONCE", "paris", "Paris", "PARIS", "nasa", "Nasa", "NASA", "hóa", "x")], "core string")
    assert {r.core for r in spelling.unknown(t, words).collect()} == {"paris", "nasa", "Nasa", "hóa"}
    f = spark.createDataFrame([("3rd",), ("123",), ("Once",), ("a",)], "core string")
    assert [r.core for r in spelling.flaggable(f, words).collect()] == ["3rd"]


def test_confusable_letters_are_cheap_in_vietnamese_alone(spark):
    w = spark.createDataFrame([("vie", "hỏa"), ("eng", "hỏa")], "lang string, word string")
    index = spark.createDataFrame([(x, y, n) for x in ("vie", "eng") for y, n in (("hòa", 1), ("hỏ", 9))], "lang string, word string, n long")
    got = {r.lang: (r.suggestion, r.cost) for r in spelling.suggest(w, index).collect()}
    assert got == {"vie": ("hòa", 4), "eng": ("hỏ", 10)}


def test_first_language_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choices("abcd", k=rng.randint(3, 7)))
    words = sorted({make() for _ in range(30)})
    stock = {lang: {make(): rng.randint(1, 4) for _ in range(25)} for lang in ("xx", "yy", "zz")}
    index = spark.createDataFrame([(lang, x, n) for lang, own in stock.items() for x, n in own.items()], "lang string, word string, n long")
    order = ["yy", "xx"]
    each = spark.createDataFrame([(lang, w) for lang in order for w in words], "lang string, word string")
    got = {r.word: (r.lang_no, r.suggestion, r.cost) for r in spelling.first_language(spelling.suggest(each, index), order).collect()}
    want = {}
    for w in words:
        most = 10 if len(w) <= 3 else 20 if len(w) <= 6 else 30
        for i, lang in enumerate(order):
            keys = [(c, -n, w[0] != x[0], abs(len(x) - len(w)), False, x) for x, n in stock[lang].items() if (c := plain_cost(w, x)) <= most]
            if keys and min(keys)[0] > 0:
                want[w] = (i, min(keys)[-1], min(keys)[0])
                break
    assert got == want


def test_page_texts_equal_lines(spark):
    rng = random.Random(1)
    w = [(d, i, 1, 1, rng.randint(0, 2), float(rng.randint(0, 99)), rng.choice("abc")) for d in range(20) for i in range(rng.randint(0, 9))]
    df = spark.createDataFrame(w, "doc long, pos long, block long, par long, line long, conf double, text string")
    every = spark.range(20).select(F.col("id").alias("doc"))
    one, two = (rows(x.select("doc", "text", F.round("confidence", 9)), "doc") for x in (pages.page_texts(df, every, ["doc"]), pages.page_result(pages.lines_of(df, ["doc"]), every, ["doc"])))
    assert one == two and len(one) == 20


PAGE = "document_path string, page long, kind string, text string, confidence double, error string"


def test_runs_isolate_failures_and_resume(spark):
    freq = spark.createDataFrame([("eng", x, 9) for x in ("simple", "plain", "words", "and", "more", "that", "stand", "here")], "lang string, word string, n long")
    known, index = lexicon.known(freq), freq
    text = "smple words and plain words that stand here xzqvvt"
    first = [("d", 1, "pdf", text, None, None), ("d", 2, "pdf", "", None, "boom"), ("d", 3, "pdf", "too short", 0.4, None), ("i", 1, "image", " ", 0.0, None)]
    run = jobs.run_documents(spark.createDataFrame(first, PAGE), known, index, ["eng", "xx"])
    got = {(r.document_path, r.page): r for r in run.records.collect()}
    assert got["d", 1].warnings == ["suggested_corrections:1", "possible_spelling_errors:1"] and got["d", 1].source == "native" and got["d", 1].confidence == 1.0
    assert [tuple(x) for x in got["d", 1].suggested_corrections] == [("smple", "simple")] and got["d", 1].flagged_words == ["xzqvvt"]
    assert (got["d", 2].status, got["d", 2].source, got["d", 2].confidence, got["d", 2].warnings) == ("failed", "ocr", 0.0, ["boom"])
    assert got["d", 3].warnings[0] == "low_confidence" and got["d", 3].confidence == 0.4
    assert got["i", 1].warnings == ["low_confidence", "no_text_detected"]
    state = {r.document_path: r for r in run.states.collect()}
    assert (state["d"].status, state["d"].failed, state["i"].status) == ("COMPLETED_WITH_WARNINGS", [2], "COMPLETED")
    assert {r.status: r.failed for r in jobs.summarise(run.states).collect()} == {"COMPLETED": 0, "COMPLETED_WITH_WARNINGS": 1}
    old = spark.createDataFrame(run.records.withColumn("total_pages", F.when(F.col("document_path") == "d", 3).otherwise(2).cast("long")).collect())
    again = [("d", 1, "pdf", "changed", None, None), ("d", 2, "pdf", text, None, None), ("d", 3, "pdf", "", None, "boom"), ("i", 1, "image", "here", 0.9, None)]
    run = jobs.run_documents(spark.createDataFrame(again, PAGE), known, index, ["eng"], old)
    got = {(r.document_path, r.page): r for r in run.records.collect()}
    assert len(got) == 4 and got["d", 1].flagged_words == ["xzqvvt"] and got["d", 2].source == "native" and got["d", 3].status == "completed"
    assert got["i", 1].confidence == 0.9  # its page count has changed
    none = jobs.run_documents(spark.createDataFrame(first, PAGE), known, index, ["xx", "yy"])
    got = {(r.document_path, r.page): r for r in none.records.collect()}
    assert got["d", 1].warnings == ["spellcheck_unavailable:xx", "spellcheck_unavailable:yy"] and got["d", 1].flagged_words == [] and got["d", 2].warnings == ["boom"]


def test_sinks_are_read_back(spark, tmp_path):
    p = spark.createDataFrame([("a", 1, "one\n\ntwo "), ("a", 2, ""), ("b", 1, "x")], "doc_id string, page long, text string")
    files.write_pages(p, f"{tmp_path}/raw")
    files.write_pages(p.where("doc_id = 'a'"), f"{tmp_path}/raw")
    assert rows(spark.read.parquet(f"{tmp_path}/raw").select("doc_id", "page", "text"), "doc_id", "page") == rows(p, "doc_id", "page")
    export.write_markdown(p, "doc_id", f"{tmp_path}/md")
    back = {r.doc_id: r.value.rstrip("\0") for r in spark.read.text(f"{tmp_path}/md", wholetext=True).collect()}
    assert back == {r.doc_id: r.markdown for r in export.markdown(p, "doc_id").collect()}
    s = spark.createDataFrame([("a", 2, [1]), ("b", 1, [])], "doc string, pages long, failed array<long>")
    export.write_metadata(s, "doc", f"{tmp_path}/meta")
    export.write_metadata(s.where("doc = 'a'").withColumn("pages", F.lit(5).cast("long")), "doc", f"{tmp_path}/meta")
    assert rows(export.read_metadata(spark, f"{tmp_path}/meta", "doc string, pages long, failed array<long>"), "doc") == [("a", 5, [1]), ("b", 1, [])]
    lines = spark.createDataFrame([("d", i, t, h) for i, (t, h) in enumerate([("intro", False), ("Chapter 1: A/b", True), ("text", False), ("***", True)])], "doc string, no long, line string, heading boolean")
    structure.write_chapters(lines, "doc", f"{tmp_path}/chapters")
    assert {(r.folder, r.value.rstrip("\0")) for r in spark.read.text(f"{tmp_path}/chapters", wholetext=True).collect()} == {("00_Front", "intro"), ("01_Chapter_1_A_b", "Chapter 1: A/b\ntext"), ("02_Chapter", "***")}


def test_readers(spark, tmp_path):
    info = spark.createDataFrame([("a", "Title: Pages: 9"), ("a", "Pages:          12"), ("b", "Pages: many"), ("b", "x")], "path string, line string")
    assert rows(files.page_counts(info), "path") == [("a", 12), ("b", None)]
    (tmp_path / "w.tsv").write_text("level\tx\n5\t1\t1\t1\t2\t0\t0\t0\t9\t9\t90\tHello\n")
    got = files.read_words(spark, str(tmp_path / "w.tsv"))
    assert [r.pos for r in got.orderBy("pos").collect()] == [0, 1, 2]
    assert rows(pages.parse_words(got.drop("path"))) == [(1, 1, 1, 2, 90.0, "Hello")]


def test_images_are_read_and_written(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (30, 41), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(imaging.png(image))
    (tmp_path / "in/bad.png").write_bytes(b"no image")
    px = imaging.read_luma(spark, str(tmp_path / "in"))
    got = np.zeros_like(image)
    for r in px.collect():
        got[r.y, r.x] = r.v
    assert (got == image).all() and px.count() == image.size
    out = imaging.binarise(px)
    want = np.zeros_like(image)
    for y in range(30):
        for x in range(41):
            w = image[max(0, y - 12) : y + 13, max(0, x - 12) : x + 13].astype(float)
            want[y, x] = 255 if image[y, x] > w.mean() * (1 + imaging.WEIGHT * (w.std() / 128 - 1)) else 0
    (tmp_path / "out").mkdir()
    (tmp_path / "out/b.png").write_bytes(imaging.as_png(out, "out").first().png)
    back = np.zeros_like(image)
    for r in imaging.read_luma(spark, str(tmp_path / "out")).collect():
        back[r.y, r.x] = r.v
    assert (back == want).all()


def test_rendering_errors_stay_with_their_page(spark):
    def renderer(content, page):
        if page == 2:
            raise ValueError("no such page")
        return content + bytes([page])

    df = spark.createDataFrame([("d", 1, bytearray(b"x")), ("d", 2, bytearray(b"x"))], "doc string, page long, content binary")
    assert rows(recognition.render(df, ["doc", "page"], renderer), "page") == [("d", 1, bytearray(b"x\1"), None), ("d", 2, None, "no such page")]


def test_host_programs(spark, tmp_path, monkeypatch):
    """Programs that stand in for the real ones say what those would."""
    def program(name, script):
        p = tmp_path / name
        p.write_text("#!/bin/sh\n" + script)
        p.chmod(p.stat().st_mode | stat.S_IXUSR)

    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    with pytest.raises(tools.ToolMissing):
        tools.page_count(b"x")
    assert tools.installed_languages() == [] and tools.dependencies(spark).where("installed").count() == 0
    program("pdfinfo", "printf 'Title: t\\nPages:   7\\n'")
    program("pdftotext", "printf ' caf\\303\\251 \\377 page %s \\n' \"$3\"")
    program("pdftoppm", 'eval out=\\${$#}; printf "page $6 at $2" > "$out.png"')
    program("tesseract", 'if [ "$1" = --list-langs ]; then printf "List\\neng\\nosd\\n\\n"; else cat "$1"; fi')
    assert tools.page_count(b"x") == 7 and tools.native_text(b"x", 3) == "café \ufffd page 3"
    assert tools.rendered(b"x", 4) == b"page 4 at 200" and tools.word_lines(b"a\tb\nc", "eng") == ["a\tb", "c"]
    assert tools.installed_languages() == ["eng"]
    (tmp_path / "en_US.aff").touch()
    (tmp_path / "en_US.dic").touch()
    got = tools.dependencies(spark, str(tmp_path))
    assert [r.installed for r in got.orderBy("no").collect()] == [True, True, False, True, True, False]
    program("pdfinfo", "echo broken >&2; exit 3")
    with pytest.raises(RuntimeError, match="broken"):
        tools.page_count(b"x")


def test_host_state(tmp_path):
    assert tools.free_space("/data/docs", {"/": 5, "/data": 3, "/dat": 9}) == 3 and tools.free_space("x", {"/a": 5, "/b": 9}) == 9 and tools.free_space("x", {}) == 0
    assert tools.runtime_state(str(tmp_path), "onnx", "linux-x64") == "missing"
    (tmp_path / "runtime/onnx/linux-x64").mkdir(parents=True)
    assert tools.runtime_state(str(tmp_path), "onnx", "linux-x64") == "installed"
    assert {"os", "arch", "cpu_cores", "ram_bytes", "disk_free_bytes"} == set(tools.hardware("/")) and tools.hardware("/")["ram_bytes"] > 0


def test_preflight_and_layout(spark):
    df = spark.createDataFrame([(5, 9, 0), (9, 5, 10)], "n long, f long, a int")
    assert [tuple(r.c) for r in df.select(structure.preflight(F.col("n"), F.col("f")).alias("c")).collect()] == [(True, 5, 9, 0), (False, 9, 5, 4)]
    assert [r[0] for r in df.select(structure.backoff(F.col("a"))).collect()] == [1.0, 60.0]
    lines = spark.createDataFrame([("d", 0, "Chapter 1", "en"), ("d", 1, "it goes on like this, and on.", None), ("d", 2, "", None), ("d", 3, "A Short Line", None)], "doc string, no long, line string, heading string")
    assert [r.route for r in structure.vote(structure.layout(lines, "doc")).orderBy("no").collect()] == ["heading", "body", "body", "ask"]


def test_word_error_rate_of_many_different_words(spark, monkeypatch):
    monkeypatch.setattr(structure, "FIRST_CODE", 0xD7F0)  # so that a few words reach past the surrogates
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(" ".join(words[:50]), " ".join([*words[:40], *words[50:]]))], "r string, t string")
    assert df.select(structure.word_error_rate(F.col("r"), F.col("t"))).first()[0] == pytest.approx(10 / 50)
    monkeypatch.setattr(structure, "FIRST_CODE", 0x110000 - 0x800 - 50)
    assert df.select(structure.word_error_rate(F.col("r"), F.col("t"))).first()[0] is None
