"""Registered queries of the document operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as fn
from leafmill.operators import export, imaging, jobs, lexicon, pages, spelling, structure
from leafmill.plans import model
from leafmill.scratch import saved
from leafmill.sources import tools

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB equivalent if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- discovery and routing

KIND = r"""case when regexp_extract(path, '[^/\\.][^/\\]*\.([A-Za-z0-9]+)$', 1) ilike 'pdf' then 'pdf'
  when lower(regexp_extract(path, '[^/\\.][^/\\]*\.([A-Za-z0-9]+)$', 1)) in ('png','jpg','jpeg','tif','tiff','bmp','webp') then 'image' end"""
KINDS = f"{model.SOURCES}, kinds as (select doc_id, path, {KIND} as kind from sources)"


@query(f"with {KINDS} select doc_id, path, kind from kinds where kind is not null")
def discover_classify(spark, d):
    return pages.discover(model.sources(spark, d))


@query(f"with {KINDS} select kind, count(*) as files from kinds where kind is not null group by kind")
def discover_kind_counts(spark, d):
    return pages.discover(model.sources(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("files"))


HOST = r"regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
NATURAL = """list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda x: struct_pack(
  k := case when regexp_full_match(x, '[0-9]+') then 1 else 0 end, t := case when regexp_full_match(x, '[0-9]+') then '' else lower(x) end,
  n := case when regexp_full_match(x, '[0-9]+') then coalesce(try_cast(x as hugeint), 18446744073709551615) else 0 end,
  l := case when regexp_full_match(x, '[0-9]+') then length(x) else 0 end))"""


@query(f"select host, url, page_id, row_number() over (partition by host order by key, url, page_id) as pos from (select {HOST} as host, url, page_id, {NATURAL} as key from pages)")
def natural_sort(spark, d):
    """Pages of each host in natural order."""
    p = model.table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "url", "page_id")
    order = Window.partitionBy("host").orderBy(fn.natural_key(F.col("url")), "url", "page_id")
    return p.withColumn("pos", long(F.row_number().over(order)))


VISIBLE = r"length(regexp_replace(text, '\s', '', 'g'))"
ROUTED = f"""{KINDS}, {model.PAGES}, routed as (select p.doc_id, p.page, p.text, k.kind,
  case when k.kind = 'pdf' and {VISIBLE} >= 20 then 'native' else 'ocr' end as source from pages_l p join kinds k using (doc_id) where k.kind is not null)"""


def routed(spark, d):
    p = model.pages(spark, d).join(pages.discover(model.sources(spark, d)).select("doc_id", "kind"), "doc_id")
    return pages.route(p)


@query(f"with {ROUTED} select doc_id, page, kind, source, case when source = 'native' then 1.0::double end as confidence from routed")
def route_pages(spark, d):
    return routed(spark, d).select("doc_id", "page", "kind", "source", "confidence")


# ---- recognised text


def words(spark, d):
    return pages.parse_words(model.word_lines(spark, d)).withColumn("page", F.lit(1).cast("long"))


@query(f"with {model.WORD_LINES} select doc_id, pos, cast(block as bigint) as block, cast(par as bigint) as par, cast(line as bigint) as line, conf, text from word_rows")
def ocr_word_filter(spark, d):
    return words(spark, d).drop("page")


LINES = f"""{model.WORD_LINES}, marked as (select *, case when lag(line) over w is distinct from line then 1 else 0 end as new from word_rows
  window w as (partition by doc_id order by pos)),
numbered as (select *, sum(new) over (partition by doc_id order by pos) as line_no from marked),
lines as (select doc_id, cast(line_no as bigint) as line_no, string_agg(text, ' ' order by pos) as text, count(*) as words, sum(conf) as conf from numbered group by all)"""
RESULT = f"""{LINES}, results as (select d.doc_id, coalesce(r.text, '') as text, coalesce(r.confidence, 0.0) as confidence from documents d left join (
  select doc_id, string_agg(text, chr(10) order by line_no) as text, least(1.0, greatest(0.0, sum(conf) / sum(words) / 100)) as confidence from lines group by doc_id) r using (doc_id))"""


@query(f"with {LINES} select doc_id, line_no, text, words from lines")
def ocr_lines(spark, d):
    return pages.lines_of(words(spark, d), ["doc_id", "page"]).select("doc_id", long("line_no").alias("line_no"), "text", "words")


def results(spark, d):
    every = model.table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page"))
    return pages.page_texts(words(spark, d), every, ["doc_id", "page"])


@query(f"with {RESULT} select doc_id, text, round(confidence, 6) as confidence from results")
def ocr_page_result(spark, d):
    return results(spark, d).select("doc_id", "text", F.round("confidence", 6).alias("confidence"))


@query(f"""with {RESULT} select doc_id, concat_ws(',', case when confidence < 0.5 then 'low_confidence' end,
  case when trim(text) = '' then 'no_text_detected' end) as warnings from results""")
def ocr_warnings(spark, d):
    return results(spark, d).select("doc_id", F.array_join(pages.warnings(F.col("text"), F.col("confidence")), ",").alias("warnings"))


@query("""select doc_id, case when sel is not null and sel not in ('', 'auto') then sel when len(installed) > 0 then array_to_string(installed, '+') else 'eng' end as lang
  from (select doc_id, case doc_id % 4 when 0 then null when 1 then 'auto' when 2 then '' else lang end as sel,
    case doc_id % 3 when 0 then [] when 1 then ['eng'] else ['eng', 'vie'] end as installed from documents)""")
def resolve_lang(spark, d):
    t = model.table(spark, d, "documents")
    sel = F.expr("case doc_id % 4 when 0 then null when 1 then 'auto' when 2 then '' else lang end")
    have = F.expr("case doc_id % 3 when 0 then cast(array() as array<string>) when 1 then array('eng') else array('eng', 'vie') end")
    return t.select("doc_id", pages.resolve_language(sel, have).alias("lang"))


@query("""select doc_id, trim(l) as lang from (select doc_id, unnest(string_split(lang || ' + ' || source || '+', '+')) as l from documents) where trim(l) <> ''""")
def split_langs(spark, d):
    t = model.table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(" + "), "source", F.lit("+")).alias("l"))
    return t.select("doc_id", F.explode(pages.split_languages(F.col("l"))).alias("lang"))


# ---- tokens

WORDS = r"regexp_extract_all(text, '\S+')"
CORE = r"regexp_replace(regexp_replace(w, '^[^\p{L}]+', ''), '[^\p{L}]+$', '')"
TRIMMED = r"regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')"


def tokens_sql(table: str, keys: str, shape: str = CORE) -> str:
    return f"(select {keys}, i as idx, {shape} as core from (select {keys}, i, ws[i + 1] as w from (select {keys}, ws, unnest(range(0, len(ws))) as i from (select {keys}, {WORDS} as ws from {table}))))"


@query(f"select doc_id, idx, core from {tokens_sql('documents', 'doc_id')} where core <> ''")
def tokens_core(spark, d):
    return spelling.tokens(model.table(spark, d, "documents"), ["doc_id"]).where("core <> ''")


@query(r"""select doc_id, cast(len(p) as bigint) as pieces, array_to_string(p, '') = text as lossless from (select doc_id, text, regexp_extract_all(text, '\s+|\S+') as p from documents)""")
def tokens_rebuild(spark, d):
    t = model.table(spark, d, "documents").withColumn("p", fn.pieces(F.col("text")))
    return t.select("doc_id", long(F.size("p")).alias("pieces"), (F.array_join("p", "") == F.col("text")).alias("lossless"))


@query(f"select core as token, count(*) as n from {tokens_sql('documents', 'doc_id', TRIMMED)} where length(core) > 1 and not regexp_full_match(core, '[0-9]+') group by core")
def tokens_flag(spark, d):
    t = spelling.tokens(model.table(spark, d, "documents"), ["doc_id"], fn.trimmed(F.col("word")))
    return t.where((F.length("core") > 1) & ~F.col("core").rlike("^[0-9]+$")).groupBy(F.col("core").alias("token")).agg(F.count(F.lit(1)).alias("n"))


# ---- lexicon

FREQ = r"""freq as (select lang, word, count(*) as n from (select lang, unnest(regexp_extract_all(lower(text), '\S+')) as word from documents)
  where regexp_full_match(word, '\p{L}+') group by lang, word)"""
LINE = """case when length(word) % 5 = 0 then word || '/AB' when length(word) % 7 = 0 then word || '9' when length(word) % 3 = 0 and regexp_matches(word, '^[a-z]')
  then upper(word[1]) || word[2:] else word end"""
ENTRY = "trim(split_part(line, '/', 1))"
LETTERS = "'[\\p{L}''-]+'"
DICT = f"""{FREQ}, dict as (select distinct {ENTRY} as word from (select {LINE} as line from (select distinct word from freq where n >= 3)) where regexp_full_match({ENTRY}, {LETTERS}))"""
KNOWN = f"""{DICT}, known as (select word from freq where n >= case lang when 'vie' then 2 else 1 end union select word from dict),
known_forms as (select lower(word) as low, bool_or(word = lower(word)) as plain, list(distinct word) as forms from known group by 1)"""


def freq(spark, d):
    return lexicon.frequencies(model.table(spark, d, "documents"))


def dictionary(spark, d, by=(), counted=None):
    """Dictionary lines (of each language, if by has lang) made of frequent words after a heading, some with affix flags, capitals or a digit."""
    w = (freq(spark, d) if counted is None else counted).where("n >= 3").select(*by, "word").distinct()
    line = F.expr("case when length(word) % 5 = 0 then concat(word, '/AB') when length(word) % 7 = 0 then concat(word, '9') when length(word) % 3 = 0 and word rlike '^[a-z]' then concat(upper(left(word, 1)), substring(word, 2)) else word end")
    head = w.select(*by).distinct() if by else spark.range(1).select()
    lines = head.select(*by, F.lit(0).alias("no"), F.lit("heading").alias("line")).unionByName(w.select(*by, F.lit(1).alias("no"), line.alias("line")))
    return lexicon.parse_dictionary(lines).distinct()


@query(f"with {FREQ} select lang, word, n from freq")
def wordfreq_build(spark, d):
    return freq(spark, d)


@query(f"with {FREQ} select lang, word, cast(count(*) over (partition by lang) - row_number() over (partition by lang order by n desc, word) + 1 as bigint) as score from freq")
def wordfreq_score(spark, d):
    return lexicon.scores(freq(spark, d))


@query(f"with {DICT} select word from dict")
def dict_parse(spark, d):
    return dictionary(spark, d)


ALL_FREQ = "all_freq as (select word, sum(n) as n from freq group by word)"
INDEX = f"""{DICT}, {ALL_FREQ}, both_words as (select d.word, coalesce(f.n, 0) as n, 0 as rank from dict d left join all_freq f on lower(d.word) = f.word
  union all select word, n, 1 from all_freq),
word_idx as (select word, cast(arg_min(n, rank) as bigint) as n, length(word) as len from both_words group by word)"""


def index(spark, d):
    return lexicon.word_index(dictionary(spark, d), freq(spark, d).groupBy("word").agg(F.sum("n").alias("n")))


@query(f"with {INDEX} select word, n, len from word_idx")
def word_index(spark, d):
    return index(spark, d)


@query(f"with {INDEX} select len, count(*) as words from word_idx group by len")
def pool_size(spark, d):
    return index(spark, d).groupBy("len").agg(F.count(F.lit(1)).alias("words"))


@query(f"with {KNOWN} select word from known")
def known_words(spark, d):
    return known(spark, d)


def unknown_sql(table: str, keys: str, shape: str = CORE) -> str:
    return f"""(select {keys}, idx, core from {tokens_sql(table, keys, shape)} t left join known_forms kf on lower(t.core) = kf.low where length(core) > 1
      and not coalesce(kf.plain or list_contains(kf.forms, core) or (upper(core) = core and list_contains(list_transform(kf.forms, lambda x: upper(x)), core)), false))"""


def known(spark, d, counted=None):
    return lexicon.known(freq(spark, d) if counted is None else counted, dictionary(spark, d, counted=counted))


@query(f"with {KNOWN} select core as word, count(*) as n from {unknown_sql('benchmark', 'item_id')} group by core")
def unknown_words(spark, d):
    n = spelling.tokens(model.table(spark, d, "benchmark"), ["item_id"]).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    return spelling.unknown(n, known(spark, d)).select(F.col("core").alias("word"), "n")


@query(f"""with {KNOWN}, {model.DIALOGUE}, firsts as (select doc_id, page, core, min(idx) as idx from {unknown_sql('dialogue', 'doc_id, page', TRIMMED)}
  where not regexp_full_match(core, '[0-9]+') group by all)
select doc_id, page, core, idx from (select *, row_number() over (partition by doc_id, page order by idx) as nth from firsts) where nth <= {spelling.CAP}""")
def flag_words_capped(spark, d):
    found = spelling.tokens(model.dialogue(spark, d), ["doc_id", "page"], fn.trimmed(F.col("word")))
    return spelling.flagged(spelling.flaggable(found, known(spark, d)), ["doc_id", "page"])


# ---- suggestions: SQL prices the words of the benchmark; those of whole conversations and documents are too many for it, and tests
# hold these against brute force

#: Cost of turning a into b, by a fold over the letters of a of the last two rows of the table.
COST = """list_last(list_reduce(range(1, length(a) + 1), lambda st, i: {'p2': st.p1, 'p1': list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, least(
    st.p1[j + 1] + 10, acc[j] + 10, st.p1[j] + case when a[i] = b[j] then 0 else 10 end,
    case when i > 1 and j > 1 and a[i] = b[j - 1] and a[i - 1] = b[j] then st.p2[j - 1] + 10 else 1000000 end)), [i * 10])},
  {'p2': [0::bigint], 'p1': list_transform(range(0, length(b) + 1), lambda x: x * 10)}).p1)"""
INDEX_L = f"""{KNOWN}, dict_l as (select distinct lang, {ENTRY} as word from (select lang, {LINE} as line from freq where n >= 3) where regexp_full_match({ENTRY}, {LETTERS})),
index_l as (select lang, word, cast(arg_min(n, rank) as bigint) as n from (select d.lang, d.word, coalesce(f.n, 0) as n, 0 as rank from dict_l d left join freq f on d.lang = f.lang and lower(d.word) = f.word
  union all select lang, word, n, 1 from freq) group by lang, word)"""


def priced_sql(words: str, languages: str) -> str:
    """The unrestricted distance in bytes, with what letters beyond ASCII may add to it, is never above the cost in edits."""
    return f"""{INDEX_L}, asked as (select lang, word, lower(word) as a, case when length(word) <= 3 then 1 when length(word) <= 6 then 2 else 3 end as k
  from (select distinct core as word from {words}), (select unnest({languages}) as lang)),
near as (select q.lang, q.word, a, k, i.word as candidate, lower(i.word) as b, n from asked q join index_l i on i.lang = q.lang and length(i.word) between length(a) - k and length(a) + k
  and damerau_levenshtein(a, lower(i.word)) <= k + (strlen(a) - length(a)) + (strlen(i.word) - length(i.word))),
priced as (select * from (select lang, word, k, candidate, cast({COST} as bigint) as cost, n, a[1] <> b[1] as other_first, abs(length(b) - length(a)) as gap, b <> candidate as caps from near) where cost <= 10 * k),
best as (select lang, word, candidate as suggestion, cost from (select *, row_number() over (partition by lang, word order by cost, n desc, other_first, gap, caps, candidate) as nth from priced) where nth = 1 and cost > 0)"""


BENCH_WORDS = unknown_sql("benchmark", "item_id")


def unknown_distinct(spark, d):
    cores = spelling.tokens(model.table(spark, d, "benchmark"), ["item_id"]).select("core").distinct()
    return spelling.unknown(cores, known(spark, d)).select(F.col("core").alias("word"))


def index_by_language(spark, d, counted=None):
    return lexicon.word_index(dictionary(spark, d, ["lang"], counted), freq(spark, d) if counted is None else counted)


def english(spark, d):
    return index_by_language(spark, d).where("lang = 'en'").select("word", "n")


@query(f"""with {priced_sql(BENCH_WORDS, "['en']")} select word, count(*) as candidates, min(cost) as least from priced group by word""")
def suggest_pairs(spark, d):
    c = spelling.candidates(unknown_distinct(spark, d), english(spark, d), "en")
    return c.groupBy("word").agg(F.count(F.lit(1)).alias("candidates"), long(F.min("cost")).alias("least"))


@query(f"""with {priced_sql(BENCH_WORDS, "['en']")} select word, suggestion, cost from best""")
def suggest_best(spark, d):
    return spelling.suggest(unknown_distinct(spark, d), english(spark, d), "en")


@query()
def suggest_confusable(spark, d):
    """The documents with every vowel's grave accent in place of its acute: a confusable change, here cheap in every language."""
    each = spelling.tokens(model.table(spark, d, "documents"), ["lang"], F.col("word")).select("lang", F.col("core").alias("word"))
    each = saved(each.distinct(), "words")  # the optimizer would do without this distinct, and cut every occurrence to its core
    cores = each.select("lang", F.lower(fn.core(F.translate("word", "áéíóú", "àèìòù"))).alias("core")).distinct()
    f = saved(freq(spark, d), "freq")
    w = spelling.unknown(cores, known(spark, d, f)).where("lang is not null").select("lang", F.col("core").alias("word"))
    return spelling.suggest(w, index_by_language(spark, d, f), confused=None)


@query(f"""with {priced_sql(BENCH_WORDS, "['en', 'fr']")}, numbered as (select word, cast(case lang when 'en' then 0 else 1 end as bigint) as lang_no, suggestion, cost from best)
select word, min(lang_no) as lang_no, arg_min(suggestion, lang_no) as suggestion, arg_min(cost, lang_no) as cost from numbered group by word""")
def suggest_multilang(spark, d):
    each = unknown_distinct(spark, d).select(F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("lang"), "word")
    return spelling.first_language(spelling.suggest(each, index_by_language(spark, d)), ["en", "fr"])


def cased_sql(core: str, s: str) -> str:
    return f"""case when regexp_matches({core}, '\\p{{L}}') and not regexp_matches({core}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') then upper({s}) when regexp_matches({core}, '^\\p{{Lu}}')
  then upper({s}[1]) || {s}[2:] else {s} end"""


@query(f"""select distinct core, {cased_sql('core', 's')} as cased from (select core, lower(core) || 'x' as s from {tokens_sql('documents', 'doc_id')} where core <> '')""")
def match_case(spark, d):
    t = spelling.tokens(model.table(spark, d, "documents"), ["doc_id"]).where("core <> ''").select("core").distinct()
    return t.withColumn("cased", fn.match_case(F.col("core"), F.concat(F.lower("core"), F.lit("x"))))


@query()
def correct_text_capped(spark, d):
    f = saved(freq(spark, d), "freq")  # all else is made of it: the documents are read once
    c = spelling.corrected(model.dialogue(spark, d), ["doc_id", "page"], known(spark, d, f), index_by_language(spark, d, f), ["en"])
    return c.withColumnRenamed("suggestion", "corrected")


# ---- jobs

RECORDS = f"""{KNOWN}, {model.DIALOGUE}, flags as (select doc_id, page, count(distinct core) as flagged from {unknown_sql('dialogue', 'doc_id, page')} group by all),
records as (select p.doc_id, p.page, p.text, case when {VISIBLE} >= 20 then 'native' else 'ocr' end as source,
  case when (p.doc_id * 7 + p.page - 1) % 5 = 0 then 'failed' else 'completed' end as status, coalesce(f.flagged, 0) as flagged
  from dialogue p left join flags f using (doc_id, page)),
states as (select doc_id, count(*) as pages, count(case when status = 'completed' then 1 end) as completed,
  coalesce(string_agg(case when status = 'failed' then cast(page as varchar) end, ',' order by page), '') as failed,
  case when count(case when status = 'failed' then 1 end) = 0 then 'COMPLETED' else 'COMPLETED_WITH_WARNINGS' end as status from records group by doc_id)"""


def plain_records(spark, d):
    status = F.expr("case when (doc_id * 7 + page - 1) % 5 = 0 then 'failed' else 'completed' end")
    return model.dialogue(spark, d).withColumn("status", status).withColumn("source", F.when(fn.native(F.col("text")), "native").otherwise("ocr"))


RUN = f"""{priced_sql(BENCH_WORDS, "['en']")}, run_pages as (select item_id, 'bench/' || item_id as document_path, text, case when item_id % 3 = 0 then 'image' else 'pdf' end as kind,
  cast(item_id % 10 as double) / 10 as read, item_id % 5 = 0 as bad, item_id % 4 <> 3 as ready from benchmark),
firsts as (select item_id, core, min(idx) as idx from {BENCH_WORDS} group by item_id, core),
items as (select item_id, idx, core, {cased_sql('core', 'b.suggestion')} as corrected from firsts f left join best b on b.word = f.core),
lists as (select item_id, count(corrected) as c, count(*) - count(corrected) as u, coalesce(string_agg(core || '>' || corrected, ';' order by idx) filter (where corrected is not null), '') as corrections,
  coalesce(string_agg(core, ';' order by idx) filter (where corrected is null), '') as flagged from items group by item_id),
page_rows as (select document_path, case when bad then 'ocr' when kind = 'pdf' and {VISIBLE} >= 20 then 'native' else 'ocr' end as source, read, bad, ready, coalesce(c, 0) as c, coalesce(u, 0) as u,
  coalesce(corrections, '') as corrections, coalesce(flagged, '') as flagged, text from run_pages left join lists using (item_id))"""


@query(f"""with {RUN} select document_path, cast(1 as bigint) as page, source, case when bad then 0.0 when source = 'native' then 1.0 else read end::double as confidence,
  case when bad then 'failed' else 'completed' end as status,
  case when bad then 'unreadable' else concat_ws(',', case when source = 'ocr' and read < 0.5 then 'low_confidence' end, case when source = 'ocr' and trim(text) = '' then 'no_text_detected' end,
    case when not ready then 'spellcheck_unavailable:xx,spellcheck_unavailable:yy' end, case when ready and c > 0 then 'suggested_corrections:' || c end,
    case when ready and u > 0 then 'possible_spelling_errors:' || u end) end as warnings,
  case when bad or not ready then '' else corrections end as corrections, case when bad or not ready then '' else flagged end as flagged from page_rows""")
def page_records(spark, d):
    """Runs over benchmark texts as documents of a page: some are images, some fail, some ask for languages that there are none of."""
    t = model.table(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("document_path"), F.lit(1).cast("long").alias("page"), F.expr("case when item_id % 3 = 0 then 'image' else 'pdf' end").alias("kind"),
        "text", (F.col("item_id") % 10 / 10).alias("confidence"), F.expr("case when item_id % 5 = 0 then 'unreadable' end").alias("error"))
    words, own = known(spark, d), index_by_language(spark, d)
    run = lambda rows, languages: jobs.run_documents(t.where(rows).drop("item_id"), words, own, languages).records
    r = run("item_id % 4 <> 3", ["en"]).unionByName(run("item_id % 4 = 3", ["xx", "yy"]))
    pair = F.transform("suggested_corrections", lambda x: F.concat(x["original"], F.lit(">"), x["corrected"]))
    return r.select("document_path", "page", "source", "confidence", "status", F.array_join("warnings", ",").alias("warnings"), F.array_join(pair, ";").alias("corrections"), F.array_join("flagged_words", ";").alias("flagged"))


def states(spark, d):
    return jobs.state(plain_records(spark, d), ["doc_id"]).withColumn("failed", F.array_join(F.transform("failed", lambda x: x.cast("string")), ","))


@query(f"with {RECORDS} select doc_id, pages, completed, failed, status from states")
def job_state(spark, d):
    return states(spark, d)


@query(f"with {RECORDS} select status, count(*) as jobs, cast(sum(pages) as bigint) as pages from states group by status")
def job_status_counts(spark, d):
    return states(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("pages").alias("pages"))


CHECKPOINT = f"""{model.DIALOGUE}, docs_p as (select 'conv/' || doc_id as document_path, count(*) as total_pages from dialogue group by doc_id),
page_p as (select 'conv/' || doc_id as document_path, page, doc_id from dialogue),
saved_p as (select 'conv/' || doc_id as document_path, page, case when (doc_id * 7 + page - 1) % 5 = 0 then 'failed' else 'completed' end as status,
  count(*) over (partition by doc_id) + case when doc_id % 4 = 0 then 1 else 0 end as total_pages from dialogue),
done_p as (select s.document_path, s.page from saved_p s join docs_p using (document_path, total_pages) where s.status = 'completed')"""


def checkpoint(spark, d):
    """Document pages, documents and an earlier run's checkpoint, every fourth with another page count."""
    p = model.dialogue(spark, d).select(F.concat(F.lit("conv/"), F.col("doc_id").cast("string")).alias("document_path"), "page", "doc_id")
    docs = p.groupBy("document_path").agg(F.count(F.lit(1)).alias("total_pages"))
    off = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    old = p.join(docs, "document_path").select("document_path", "page", F.expr("case when (doc_id * 7 + page - 1) % 5 = 0 then 'failed' else 'completed' end").alias("status"), (F.col("total_pages") + off).alias("total_pages"))
    return p.select("document_path", "page"), docs, jobs.usable(old, docs)


@query(f"with {CHECKPOINT} select document_path, page from page_p except select document_path, page from done_p")
def checkpoint_plan(spark, d):
    p, _, done = checkpoint(spark, d)
    return jobs.pending(p, done)


@query(f"with {CHECKPOINT} select p.document_path, p.page, case when d.page is null then 'processed' else 'reused' end as how from page_p p left join done_p d using (document_path, page)")
def resume_merge(spark, d):
    p, _, done = checkpoint(spark, d)
    return jobs.resumed(p, done)


@query(f"""with {RECORDS} select doc_id, count(*) as pages, count(case when status = 'completed' then 1 end) as completed,
  coalesce(string_agg(case when status = 'failed' then cast(page as varchar) end, ',' order by page), '') as failed, 'INTERRUPTED' as status from records where page <= 2 group by doc_id""")
def checkpoint_state(spark, d):
    """Job states as they stand after two pages."""
    s = jobs.state(plain_records(spark, d).where("page <= 2"), ["doc_id"], final=False)
    return s.withColumn("failed", F.array_join(F.transform("failed", lambda x: x.cast("string")), ","))


@query(f"""with {RECORDS} select status, count(*) as jobs, cast(sum(pages) as bigint) as pages, cast(sum(completed) as bigint) as completed, cast(sum(pages - completed) as bigint) as failed from states group by status""")
def run_summary(spark, d):
    return jobs.summarise(jobs.state(plain_records(spark, d), ["doc_id"]))


@query("""select user_id, count(*) as pages, round(epoch(max(ts)) - epoch(min(ts)), 6) as seconds, round((epoch(max(ts)) - epoch(min(ts))) / count(*), 6) as seconds_per_page, max(value) as peak from events group by user_id""")
def stress_report(spark, d):
    """Every user's events as the pages of a run, their value as the memory."""
    r = jobs.stress(model.table(spark, d, "events").select("user_id", "ts", F.col("value").alias("memory")), "user_id")
    return r.withColumns({c: F.round(c, 6) for c in ("seconds", "seconds_per_page")})


@query(f"""with {model.DIALOGUE}, r as (select doc_id, page, case when (doc_id * 7 + page - 1) % 5 = 0 then 'failed' else 'completed' end as status from dialogue)
select doc_id, page, count(case when status = 'completed' then 1 end) over w as completed, coalesce(string_agg(case when status = 'failed' then cast(page as varchar) end, ',') over w, '') as failed
from r window w as (partition by doc_id order by page rows between unbounded preceding and current row)""")
def checkpoint_series(spark, d):
    return jobs.series(plain_records(spark, d), "doc_id")


@query(f"with {model.PAGES} select doc_id, string_agg('<!-- page ' || page || ' -->' || chr(10) || chr(10) || text || chr(10) || chr(10), '' order by page) as markdown from pages_l group by doc_id")
def export_markdown(spark, d):
    return export.markdown(model.pages(spark, d), "doc_id")


@query(f"with {RECORDS} select doc_id, status, cast(pages as varchar) as pages, failed from states")
def export_json(spark, d):
    """Read back from the exported JSON."""
    j = export.metadata(states(spark, d)).select("json")
    return j.select(F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("status", "pages", "failed")])


EVENTS = f"""{CHECKPOINT}, run_p as (select p.document_path, p.page, d.total_pages as total, case when x.page is null then 'processed' else 'reused' end as how
  from page_p p join docs_p d using (document_path) left join done_p x using (document_path, page)),
run_events as (select document_path, page * 2 as seq, case when how = 'reused' then 'page_skipped' else 'page_started' end as type, page, total, null::varchar as status from run_p
  union all select document_path, page * 2 + 1, 'page_completed', page, total, case when page % 3 = 0 then 'failed' else 'completed' end from run_p where how = 'processed')"""


def run_events(spark, d):
    p, docs, done = checkpoint(spark, d)
    r = jobs.resumed(p, done).join(docs.withColumnRenamed("total_pages", "total"), "document_path")
    return jobs.events(r.withColumn("status", F.when(F.col("page") % 3 == 0, "failed").otherwise("completed")), ["document_path"])


@query(f"with {EVENTS} select document_path, seq, type, page, total, status from run_events")
def progress_events(spark, d):
    return run_events(spark, d)


@query(f"with {EVENTS} select document_path, page, arg_max(type || ':' || coalesce(status, ''), seq) as latest, min(seq) as first from run_events group by document_path, page")
def page_log_latest(spark, d):
    e = run_events(spark, d).withColumn("entry", F.concat_ws(":", "type", F.coalesce("status", F.lit(""))))
    return jobs.latest(e, ["document_path", "page"], "seq", "entry")


@query(f"""with {EVENTS}, n as (select document_path, max(total) as total, count(case when type <> 'page_started' then 1 end) as done from run_events where page <= 2 group by document_path)
select document_path, done, cast(floor(100 * done / total + 0.5) as bigint) as pct from n""")
def progress_pct(spark, d):
    """Progress after two pages of each document."""
    n = run_events(spark, d).where("page <= 2").groupBy("document_path").agg(F.max("total").alias("total"), F.count(F.when(F.col("type") != "page_started", 1)).alias("done"))
    return n.select("document_path", "done", jobs.percent(F.col("done"), F.col("total")).alias("pct"))


@query("select user_id, event_id, event_type, nth from (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as nth from events) where nth <= 8")
def last_log_entries(spark, d):
    return jobs.last_entries(model.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


FLAGS = f"""{KNOWN}, {model.DIALOGUE}, sightings as (select doc_id, lower(core) as original, core || '#' || page as corrected, page * 1000000 + idx as pos from {unknown_sql('dialogue', 'doc_id, page')})"""


def sightings(spark, d):
    found = spelling.unknown(spelling.tokens(model.dialogue(spark, d), ["doc_id", "page"]), known(spark, d))
    return found.select("doc_id", F.lower("core").alias("original"), F.concat("core", F.lit("#"), F.col("page").cast("string")).alias("corrected"), (F.col("page") * 1000000 + F.col("idx")).alias("pos"))


@query(f"with {FLAGS} select doc_id, original, min(pos) as pos, arg_max(corrected, pos) as corrected from sightings group by doc_id, original")
def corrections_dedupe(spark, d):
    """The place of a word's first correction with the text of its last."""
    return sightings(spark, d).groupBy("doc_id", "original").agg(F.min("pos").alias("pos"), F.max_by("corrected", "pos").alias("corrected"))


@query(f"with {FLAGS} select doc_id, original as word, min(pos) as pos from sightings group by doc_id, original")
def flagged_distinct(spark, d):
    return sightings(spark, d).groupBy("doc_id", F.col("original").alias("word")).agg(F.min("pos").alias("pos"))


@query("""with req as (select conv_id as id, turn as no, case when (conv_id + turn) % 3 = 0 then 'xx' || turn else ['en','fr','vi'][1 + turn % 3] end as lang from conversations),
have as (select distinct lang from documents)
select id, coalesce(string_agg(case when h.lang is null then r.lang end, '+' order by r.no), '') as unavailable, bool_and(h.lang is null) as none_available from req r left join have h on r.lang = h.lang group by id""")
def unavailable_langs(spark, d):
    lang = F.expr("case when (conv_id + turn) % 3 = 0 then concat('xx', turn) else element_at(array('en','fr','vi'), cast(1 + turn % 3 as int)) end")
    req = model.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("no"), lang.alias("lang"))
    return jobs.unavailable(req, model.table(spark, d, "documents").select("lang"))


# ---- images

BOX = f"""{model.PIXELS}, rows_s as (select *, sum(v) over w as s1, sum(v * v) over w as q1, count(*) over w as n1 from pixels
  window w as (partition by image_id, y order by x rows between 2 preceding and 2 following)),
box as (select image_id, x, y, v, sum(s1) over w as s, sum(q1) over w as q, sum(n1) over w as n from rows_s
  window w as (partition by image_id, x order by y rows between 2 preceding and 2 following)),
stats as (select image_id, x, y, v, cast(s as double) / n as mean, sqrt(greatest(0.0, cast(q as double) / n - (cast(s as double) / n) * (cast(s as double) / n))) as sd from box)"""


@query(f"with {BOX} select image_id, x, y, round(mean, 6) as mean, round(sd, 6) as sd from stats")
def box_stats(spark, d):
    return imaging.box(model.pixels(spark, d), 2).select("image_id", "x", "y", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"with {BOX} select image_id, x, y, cast(case when v > mean * (1 + 0.3400000035762787::double * (sd / 128 - 1)) then 255 else 0 end as bigint) as v from stats")
def binarize(spark, d):
    return imaging.binarise(model.pixels(spark, d), 2).select("image_id", "x", "y", long("out").alias("v"))


PAGE_PIXELS = """pixels as (select vec_id // 64 as image_id, i as x, vec_id % 64 as y,
  cast(greatest(0, least(255, floor(cast(embedding[i + 1] as double) * 128 + 128))) as bigint) as v
  from (select vec_id, embedding, unnest(range(0, len(embedding))) as i from embeddings))"""
PAGE_BOX = BOX.replace(model.PIXELS, PAGE_PIXELS).replace("2 preceding and 2 following", f"{imaging.HALF} preceding and {imaging.HALF} following")


def page_pixels(spark, d):
    """Images 64 pixels wide and up to 64 high: an embedding a row."""
    p = model.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image_id"), (F.col("vec_id") % 64).alias("y"), F.posexplode("embedding").alias("x", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("e").cast("double") * 128 + 128))).cast("long")
    return p.select("image_id", long("x").alias("x"), "y", v.alias("v"))


@query(f"with {PAGE_BOX} select image_id, x, y, round(mean, 6) as mean, round(sd, 6) as sd from stats")
def box_stats_page(spark, d):
    return imaging.box(page_pixels(spark, d)).select("image_id", "x", "y", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"with {PAGE_BOX} select image_id, x, y, cast(case when v > mean * (1 + {imaging.WEIGHT}::double * (sd / 128 - 1)) then 255 else 0 end as bigint) as v from stats")
def binarize_page(spark, d):
    """With the window of 25 pixels."""
    return imaging.binarise(page_pixels(spark, d)).select("image_id", "x", "y", long("out").alias("v"))


# ---- host and report

PACKAGES = tools.PACKAGES
PACK_SQL = "packs(no, name, package) as (values " + ", ".join(f"({n}, '{a}', '{b}')" for n, a, b in PACKAGES) + ")"
MISSING = f"{PACK_SQL}, missing as (select user_id, no, package from (select distinct user_id from events) cross join packs where (user_id + no) % 3 <> 0)"


def missing(spark, d):
    """A host for each user, which lacks some packages."""
    p = F.array(*[F.struct(F.lit(n).alias("no"), F.lit(b).alias("package")) for n, _, b in PACKAGES])
    hosts = model.table(spark, d, "events").select("user_id").distinct()
    return hosts.select("user_id", F.explode(p).alias("p")).select("user_id", "p.*").where("(user_id + no) % 3 <> 0")


@query(f"with {MISSING} select user_id, cast(no as bigint) as no, package from missing")
def missing_packages(spark, d):
    return missing(spark, d).select("user_id", long("no").alias("no"), "package")


@query(f"with {PACK_SQL} select user_id, cast(no as bigint) as no, name, package, (user_id + no) % 3 = 0 as installed from (select distinct user_id from events) cross join packs")
def dependency_report(spark, d):
    """The six packages with their state on every host."""
    p = F.array(*[F.struct(F.lit(n).cast("long").alias("no"), F.lit(a).alias("name"), F.lit(b).alias("package")) for n, a, b in PACKAGES])
    hosts = model.table(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(p).alias("p")).select("user_id", "p.*")
    return hosts.withColumn("installed", (F.col("user_id") + F.col("no")) % 3 == 0)


@query(f"""{"with " + model.DIALOGUE} select doc_id, coalesce(string_agg(distinct w, ',' order by w), '') as langs from (select doc_id, case when page % 2 = 0 then 'l' || (page % 4) end as w from dialogue) group by doc_id""")
def warning_prefix(spark, d):
    """Languages named by the pages' warnings of one prefix."""
    w = F.array(F.lit("low_confidence"), F.when(F.col("page") % 2 == 0, F.concat(F.lit("spellcheck_unavailable:l"), (F.col("page") % 4).cast("string"), F.lit(":x"))).otherwise("possible_spelling_errors:3"))
    all_ = model.dialogue(spark, d).groupBy("doc_id").agg(F.flatten(F.collect_list(w)).alias("w"))
    return all_.select("doc_id", F.array_join(F.array_sort(export.prefixed(F.col("w"), "spellcheck_unavailable:")), ",").alias("langs"))


@query(f"with {MISSING} select user_id, 'sudo apt-get install -y ' || string_agg(package, ' ' order by no) as command from missing group by user_id")
def install_command(spark, d):
    packs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "package"))), lambda x: x["package"]), " ")
    return missing(spark, d).groupBy("user_id").agg(F.concat(F.lit("sudo apt-get install -y "), packs).alias("command"))


# Supported platforms.
PLATFORMS = {"windows/x86_64": "windows-x64", "macos/aarch64": "macos-arm64", "macos/x86_64": "macos-x64", "linux/x86_64": "linux-x64", "linux/aarch64": "linux-arm64"}
OS_ARCH = "select distinct c_custkey % 4 as o, c_custkey % 3 as a from customer"
HOSTS_SQL = f"hosts as (select ['windows','macos','linux','bsd'][cast(o + 1 as int)] as os, ['x86_64','aarch64','riscv64'][cast(a + 1 as int)] as arch from ({OS_ARCH}))"


@query(f"with {HOSTS_SQL} select os, arch, case os || '/' || arch " + " ".join(f"when '{k}' then '{v}'" for k, v in PLATFORMS.items()) + " else 'unsupported' end as target from hosts")
def platform_target(spark, d):
    h = model.table(spark, d, "customer").selectExpr("c_custkey % 4 as o", "c_custkey % 3 as a").distinct()
    h = h.selectExpr("element_at(array('windows','macos','linux','bsd'), cast(o + 1 as int)) as os", "element_at(array('x86_64','aarch64','riscv64'), cast(a + 1 as int)) as arch")
    known_ = F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv])
    return h.withColumn("target", F.coalesce(F.try_element_at(known_, F.concat_ws("/", "os", "arch")), F.lit("unsupported")))


@query("""with m as (select p_partkey as host, unnest(['/', '/data', '/data/docs', '/srv']) as mount, unnest([100, 40, 70, 900]) + p_partkey % 50 as space from part),
t as (select p_partkey as host, case p_partkey % 3 when 0 then '/data/docs/in' when 1 then '/srv/x' else 'relative' end as dir from part)
select host, cast(coalesce(arg_max(case when starts_with(dir, mount) then space end, case when starts_with(dir, mount) then length(mount) end), max(space), 0) as bigint) as space from m join t using (host) group by host""")
def disk_pick(spark, d):
    """Free space of the mount with the longest prefix of the data folder, else the greatest."""
    m = model.table(spark, d, "part").selectExpr(
        "p_partkey as host", "case p_partkey % 3 when 0 then '/data/docs/in' when 1 then '/srv/x' else 'relative' end as dir",
        "explode(array(named_struct('mount', '/', 'base', 100), named_struct('mount', '/data', 'base', 40), named_struct('mount', '/data/docs', 'base', 70), named_struct('mount', '/srv', 'base', 900))) as m")
    m = m.selectExpr("host", "dir", "m.mount as mount", "m.base + host % 50 as space")
    fits = F.startswith("dir", "mount")
    return m.groupBy("host").agg(F.coalesce(F.max_by(F.when(fits, F.col("space")), F.when(fits, F.length("mount"))), F.max("space"), F.lit(0)).cast("long").alias("space"))


@query("select o_orderkey, printf('%.1f GB', (cast(floor(o_totalprice) as double) * 65536.0) / 1073741824.0) as size from orders")
def format_bytes(spark, d):
    return model.table(spark, d, "orders").select("o_orderkey", fn.gigabytes(F.floor("o_totalprice").cast("double") * 65536.0).alias("size"))


STEM = r"coalesce(nullif(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', ''), ''), 'document')"


@query(f"select {STEM} as stem, count(distinct url) as paths, min(url) as first from pages group by 1 having count(distinct url) > 1")
def output_collisions(spark, d):
    return export.collisions(model.table(spark, d, "pages").select(F.col("url").alias("path")), fn.stem(F.col("path")))


@query(f"""with {KNOWN}, {model.SOURCES}, kinds as (select doc_id, path, {KIND} as kind from sources), {model.PAGES},
flags as (select doc_id, page, count(distinct core) as flagged from {unknown_sql('pages_l', 'doc_id, page')} group by all)
select p.doc_id, k.kind, count(*) as pages, count(case when k.kind = 'pdf' and {VISIBLE} >= 20 then 1 end) as native, cast(sum(coalesce(f.flagged, 0)) as bigint) as flagged,
  case when sum(coalesce(f.flagged, 0)) = 0 then 'COMPLETED' else 'COMPLETED_WITH_WARNINGS' end as status
from pages_l p join kinds k using (doc_id) left join flags f using (doc_id, page) where k.kind is not null group by p.doc_id, k.kind""")
def job_summary(spark, d):
    """Scan, route, tokenize, look up and roll up every supported document."""
    p = routed(spark, d)
    found = spelling.unknown(spelling.tokens(p, ["doc_id", "page"]), known(spark, d))
    flags = found.groupBy("doc_id", "page").agg(F.countDistinct("core").alias("flagged"))
    n = F.sum(F.coalesce("flagged", F.lit(0)))
    return p.join(flags, ["doc_id", "page"], "left").groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("source") == "native", 1)).alias("native"), n.alias("flagged"),
        F.when(n == 0, "COMPLETED").otherwise("COMPLETED_WITH_WARNINGS").alias("status"),
    )


# ---- extensions that the reference plans

TITLED = """titled as (select doc_id, i as no, case when i % 7 = 3 then 'Chapter ' || (i // 7 + 1) || ' ' || l[i + 1] when i % 11 = 5 then (i // 11 + 1) || '. ' || l[i + 1] else l[i + 1] end as line
  from (select doc_id, l, unnest(range(0, len(l))) as i from (select doc_id, string_split(text, chr(10)) as l from documents)))"""
HEAD = r"case when regexp_matches(line, '^(CHAPTER|Chapter|Part|PART) +([0-9]+|[IVXLC]+)\b') then 'en' when regexp_matches(line, '^[0-9]+(\.[0-9]+)*\.? +\p{Lu}') then 'numbered' end"


def titled(spark, d):
    """Lines of documents, some with a heading put before them."""
    t = model.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    line = F.expr("case when i % 7 = 3 then concat('Chapter ', i div 7 + 1, ' ', l) when i % 11 = 5 then concat(i div 11 + 1, '. ', l) else l end")
    return t.select("doc_id", long("i").alias("no"), line.alias("line")).withColumn("heading", structure.heading(F.col("line")))


@query(f"with {TITLED} select doc_id, no, {HEAD} as heading from titled where {HEAD} is not null")
def heading_signals(spark, d):
    return titled(spark, d).where("heading is not null").select("doc_id", "no", "heading")


@query(f"""with {TITLED}, c as (select doc_id, no, sum(case when {HEAD} is not null then 1 else 0 end) over (partition by doc_id order by no) as chapter from titled)
select doc_id, cast(chapter as bigint) as chapter, count(*) as lines from c group by doc_id, chapter""")
def chapter_split(spark, d):
    t = titled(spark, d).withColumn("heading", F.col("heading").isNotNull())
    return structure.chapters(t, "doc_id").groupBy("doc_id", long("chapter").alias("chapter")).agg(F.count(F.lit(1)).alias("lines"))


@query("""select item_id, round(levenshtein(a, t) / cast(greatest(1, length(t)) as double), 6) as cer from (
  select item_id, regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g') as t, replace(regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g'), 'th', 'tl') as a from benchmark)""".replace("\\\\", "\\"))
def cer_score(spark, d):
    """Benchmark texts in ASCII against a reading that takes th for tl."""
    t = model.table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x20-\x7E]", "?").alias("t"))
    return t.select("item_id", F.round(structure.character_error_rate(F.replace(F.col("t"), F.lit("th"), F.lit("tl")), F.col("t")), 6).alias("cer"))


WORD_COST = """list_last(list_reduce(range(1, len(a) + 1), lambda st, i: list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(
  st[j + 1] + 1, acc[j] + 1, st[j] + case when a[i] = b[j] then 0 else 1 end)), [i]), range(0, len(b) + 1)))"""


@query(rf"""select item_id, round({WORD_COST} / cast(greatest(1, len(b)) as double), 6) as wer from (
  select item_id, regexp_extract_all(regexp_replace(text, '\bof\b', 'on', 'g'), '\S+') as a, regexp_extract_all(text, '\S+') as b from benchmark)""")
def wer_score(spark, d):
    """Benchmark texts against a reading that takes of for on."""
    t = model.table(spark, d, "benchmark").select("item_id", "text")
    return t.select("item_id", F.round(structure.word_error_rate(F.regexp_replace("text", r"\bof\b", "on"), F.col("text")), 6).alias("wer"))


TITLE = r"substring(regexp_replace(regexp_replace(line, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60)"


@query(rf"""with {TITLED}, c as (select doc_id, no, line, sum(case when {HEAD} is not null then 1 else 0 end) over (partition by doc_id order by no) as chapter from titled)
select doc_id, cast(chapter as bigint) as chapter, printf('%02d_%s', cast(chapter as int), case when chapter = 0 then 'Front' when arg_min({TITLE}, no) = '' then 'Chapter' else arg_min({TITLE}, no) end) as folder,
  string_agg(line, chr(10) order by no) as text from c group by doc_id, chapter""")
def chapter_export(spark, d):
    t = titled(spark, d).withColumn("heading", F.col("heading").isNotNull())
    return structure.chapter_names(t, "doc_id").withColumn("chapter", long("chapter"))


@query(rf"""with {TITLED}, l as (select doc_id, no, {HEAD} is not null as said, (cast(length(line) <= 60 as int) + cast(not regexp_matches(line, '[.,;:!?]\s*$') as int)
  + cast(trim(coalesce(lag(line) over (partition by doc_id order by no), '')) = '' as int) + cast(regexp_matches(line, '^\s*[\p{{Lu}}\p{{N}}]') as int)) / 4.0 as layout from titled)
select doc_id, no, round(0.6 * cast(said as int) + 0.4 * layout, 6)::double as vote, case when round(0.6 * cast(said as int) + 0.4 * layout, 6) >= 0.8 then 'heading' when not said and layout >= 0.75 then 'ask' else 'body' end as route from l""")
def layout_vote(spark, d):
    v = structure.vote(structure.layout(titled(spark, d), "doc_id"))
    return v.select("doc_id", "no", F.round("vote", 6).alias("vote"), "route")


@query("""select p_partkey as host, need <= free as ok, need as required, free as available, greatest(0, need - free) as short, least(60.0, pow(2.0, p_partkey % 8))::double as wait
  from (select p_partkey, cast(p_size as bigint) * 20 as need, (p_partkey * 37) % 1000 as free from part)""")
def disk_preflight(spark, d):
    """Whether an artifact fits a host's disk, and how long to wait before a further try."""
    p = model.table(spark, d, "part").select("p_partkey", (long("p_size") * 20).alias("need"), (F.col("p_partkey") * 37 % 1000).alias("free"))
    return p.select(F.col("p_partkey").alias("host"), structure.preflight(F.col("need"), F.col("free")).alias("c"), structure.backoff(F.col("p_partkey") % 8).alias("wait")).select("host", "c.*", "wait")


@query("""select c_custkey, case when c_custkey % 12 >= 8 then 'Large' when c_custkey % 40 >= 16 then 'Medium' else 'Small' end as tier from customer""")
def model_tier(spark, d):
    return model.table(spark, d, "customer").select("c_custkey", structure.model_tier(F.col("c_custkey") % 40, F.col("c_custkey") % 12).alias("tier"))


@query("""with a as (select s_suppkey as artifact, s_suppkey % 5 as component, ['linux-x64','macos-arm64'][cast(1 + s_suppkey % 2 as int)] as target, sha256(s_name) as digest from supplier),
w as (select s_suppkey as id, s_suppkey % 5 as component, 'linux-x64' as target, case when s_suppkey % 4 = 0 then 'bad' else sha256(s_name) end as digest from supplier)
select id, artifact, w.digest = a.digest as intact from w join a on w.component = a.component and w.target = a.target and w.id = a.artifact""")
def manifest_match(spark, d):
    """Files on disk met with the manifest's artifacts of their component and target; whether the digest holds."""
    s = model.table(spark, d, "supplier")
    a = s.selectExpr("s_suppkey as artifact", "s_suppkey % 5 as component", "element_at(array('linux-x64','macos-arm64'), cast(1 + s_suppkey % 2 as int)) as target", "sha2(s_name, 256) as digest")
    w = s.selectExpr("s_suppkey as id", "s_suppkey % 5 as component", "'linux-x64' as target", "case when s_suppkey % 4 = 0 then 'bad' else sha2(s_name, 256) end as found")
    return w.join(a, ["component", "target"]).where("id = artifact").select("id", "artifact", (F.col("found") == F.col("digest")).alias("intact"))
