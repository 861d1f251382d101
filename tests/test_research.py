"""Chunks, sections, admission, status sentences, measures and settings of corpus research."""

from pyspark.sql import functions as F

from foliolens import queries_research
from foliolens.functions import text as T
from foliolens.operators import corpus, profiles, research
from foliolens.sources import files

SOURCE = "---\nt: 1\n---\n# Title\n\nSome text\nmore <!-- gone\n\nhidden -->text\n```sh\na\n\nb\n```\n- one\n- two\n\n| a | b |\n\n{{< note >}}\n\n1) x\n\n~~~\n```\nopen"


def test_chunks(spark):
    d = spark.createDataFrame([(1, SOURCE), (2, None), (3, ""), (4, "   \n\n"), (5, "x\n" * 30_000)], "k int, s string")
    out = {r.k: [(c.kind, c.text) for c in r.c] for r in d.select("k", research.chunks(F.col("s")).alias("c")).collect()}
    assert [k for k, _ in out[1]] == ["heading", "prose", "code", "list", "table", "shortcode", "list", "prose", "code"]
    assert out[1][1][1] == "Some text\nmore text" and out[1][2][1] == "```sh\na\n\nb\n```" and out[1][-1][1] == "```\nopen"
    assert out[2] == out[3] == out[4] == [] and len(out[5]) == 1
    shared = d.where("k = 1").select(research.without_shortcodes(research.chunks(F.col("s"))).alias("c")).first().c
    assert [c.idx for c in shared] == list(range(8)) and "shortcode" not in {c.kind for c in shared}


def test_sections_and_headings(spark):
    d = spark.createDataFrame([("## A [b](c) `d` ☀ ##\ntext\n- x\n```\ncode\n```\n### Sub\n| t |\n## Last\n",)], "s string")
    s = d.select(research.readme_sections(F.col("s")).alias("s")).first().s
    assert [x.heading for x in s] == ["A [b](c) `d` ☀", "Sub", "Last"]
    row = d.select(research.clean_heading(F.lit(s[0].heading)).alias("h"), research.composition(F.lit(s[0].body)).alias("c"), research.norm_lemma(F.lit("カード-card")).alias("l")).first()
    assert row.h == "a b d" and (row.c.code, row.c.bullets, row.c.tables, row.c.prose) == (1, 1, 0, 1) and row.l == "カード"


def test_markup_of_other_kinds(spark):
    d = spark.createDataFrame([("@chapter X\n@code{a} text\n@example\nno\n@end example\nend", "Title\n=====\n::\n\n    code\n\nUse ``x`` now\n", "# H\nA `b` **c** <i>d</i> https://x.y e\n- item\n> q\n    ---\n")], "t string, r string, m string")
    row = d.select(*(research.markup_free(F.col(c), k)[0].alias(c) for c, k in (("t", "texi"), ("r", "rst"), ("m", "md")))).first()
    assert row.t.split() == ["a", "text", "end"] and row.r.split() == ["Title", "Use", "x", "now"] and row.m.split()[:4] == ["A", "c", "d", "e"]


def test_admission_and_status(spark):
    d = spark.createDataFrame([(1, "漢" * 300), (2, "かな" * 150), (3, "latin " * 60), (4, None), (5, "TODO TODO NNNN " + "x" * 3000)], "k int, s string")
    s = F.coalesce("s", F.lit(""))
    out = {r.k: (r.a, r.b) for r in d.select("k", research.in_target_language(s).alias("a"), research.is_written(s).alias("b")).collect()}
    assert [out[k][0] for k in range(1, 6)] == [False, True, True, False, True] and not out[5][1]
    text = "## Roadmap\nIt is planned.\n## Use\nThis is not yet done. If you can, it is planned. We tried it, for now. Nothing here.\n"
    got = spark.createDataFrame([(text,)], "s string").select(research.status_sentences(research.readme_sections(F.col("s"))).alias("x")).first().x
    assert [x["class"] for x in got] == ["signposted", "plain", "addressed", "about_work"]


def test_measures_without_a_parser(spark):
    d = spark.createDataFrame([(1, "It is currently so — like a fox, **bold** in two ways.\n\nUse the following:\n\n- a\n\nConsider it:\n- b\n"), (2, None)], "k int, s string")
    out = {(r.k, r.metric): r.value for r in research.research_en(d, "s", "k", excess=("fox",)).collect()}
    assert out[1, "bad_list_lead"] == out[1, "good_list_lead"] == out[1, "count_declaration"] == 1 and out[1, "emdash_1k"] == out[1, "excess_1k"] == out[1, "timeless_violation_1k"] > 0
    assert all(out[2, m] == 0 for m in research.EN_RESEARCH)


def test_choices_of_pivots_and_forms(spark):
    dice = spark.createDataFrame([("p", "サーバ", 9, 0.9), ("p", "機械", 3, 0.5), ("p", "装置", 3, 0.4), ("q", "ア", 3, 0.5), ("q", "亜", 2, 0.9)], "pivot string, word string, hits long, dice double")
    kind = F.when(F.col("word").rlike(r"\A[ァ-ヶー]+\z"), "kata").otherwise("kango")
    assert [tuple(r) for r in corpus.pivot_choices(dice, kind).collect()] == [("p", "サーバ", 9, "機械", 3)]
    pairs = spark.createDataFrame([("the cat", "the dog"), ("The cat", "a dog"), ("a", "the")], "a string, b string")
    out = {(r.ours_form, r.theirs_form): r.n for r in research.term_agreement(pairs, "a", "b", {"t": ["the", "The"]}).collect()}
    assert out == {("the", "the"): 1, ("The", None): 1}
    heads = spark.createDataFrame([(1, "Known"), (1, "*Odd*"), (2, "odd"), (3, "Rare")], "k int, text string")
    assert [tuple(r) for r in research.unmatched_headings(heads, "k", F.col("text") == "Known", 1).collect()] == [("odd", 2)]


def test_quantiles_by_rank_equal_gathered_ones(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9, 3, 7)] + [("b", 1.0), ("c", 2.0), ("c", 4.0), ("c", None)], "g string, v double")
    out = {r.g: (r.n, r.q1, r.q2) for r in profiles.ranked_quantiles(d, "v", {"q1": 0.25, "q2": 0.5}, "g").collect()}
    want = d.where("v is not null").groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("v")).where("size(v) > 1").select("g", T.quantile_exclusive(F.col("v"), 0.25), T.quantile_exclusive(F.col("v"), 0.5)).collect()
    assert {g: (a, b) for g, a, b in want} == {g: x[1:] for g, x in out.items()} and out["a"][0] == 6


def test_settings(spark, tmp_path):
    config = files.settings('allow = ["a"]\n[[term]]\nword = "x"\nlang = "en"\ncount = 2\n[paths]\n"docs/" = "howto"')
    assert files.allowed_words(config) == ("a",) and files.path_types(config) == {"docs/": "howto"} and files.term_rows(spark, config).first().word == "x"
    files.write_terms(spark.createDataFrame([('a"b\\c', "en", 1)], "word string, lang string, count long"), f"{tmp_path}/t")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/t").collect())
    assert files.settings(text)["term"][0]["word"] == 'a"b\\c'


def test_words_are_as_by_splitting_and_trimming(spark):
    import re
    import unicodedata

    texts = ["", " ", "a", "--a--b..", "don't  STOP\u3000x\u00a0y\u0085z\u180ew", "12 1a a1 _1_ (é)’s", "\U0001d400\U0001f600 x\U0001f600y \u200b", "ǅ İ ΑΣ, Σ", "\x1cq\x1fr s\x0bt", "9" * 30_000 + "-" * 30_000]
    white = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    held = lambda c: unicodedata.category(c)[0] in "LN"
    trimmed = lambda w: w[min((k for k, c in enumerate(w) if held(c)), default=len(w)) : max((k + 1 for k, c in enumerate(w) if held(c)), default=0)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.words(F.col("t")).alias("w")).collect()
    for r in got:
        assert [w.lower() for w in r.w] == [w.lower() for w in map(trimmed, re.split(white, texts[r.k])) if w], texts[r.k][:50]


def test_counts_of_pairs_and_words_read_the_texts_once(spark, tmp_path):
    def scans(d):
        return d._jdf.queryExecution().executedPlan().toString().count("Scan parquet") - d._jdf.queryExecution().executedPlan().toString().count("ReusedExchange")

    rows = [(1, "the der the", "a"), (2, "und x", "b"), (3, "y y y", None), (4, "...", "c"), (5, None, "a"), (6, "z", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.col("source")).write.parquet(f"{tmp_path}/documents.parquet")
    d = queries_research.source_pairs(spark, str(tmp_path))
    assert scans(d) == 1
    got = {(r.ours, r.source): (r.ours_n, r.theirs_n) for r in d.collect()}
    assert len(got) == 12 and got["the", "a"] == (2, 1) and got["and", "b"] == (0, 1) and got["zzz", "d"] == (0, 0)
    assert scans(queries_research.word_adoption(spark, str(tmp_path))) <= 2
    counts = corpus.word_counts(spark.createDataFrame([("g", ["b", "a", "b"]), ("g", ["b"]), ("h", [])], "g string, w array<string>"), F.col("w"), "g")
    assert {tuple(r) for r in counts.collect()} == {("g", "a", 1, 1), ("g", "b", 3, 2)}
