import json

import pytest
from pyspark.sql import functions as F

from foliolens.functions.morphology import Dictionary, tokenizer
from foliolens.functions.text import hinges, quantile_exclusive, sentence_count
from foliolens.operators import corpus, profiles, rules, terms
from foliolens.operators.metrics import measured_ja
from foliolens.operators.parse import parse
from foliolens.plans import brief, report
from foliolens.sources import files
from foliolens.streaming import service

WORDS = Dictionary.of("利用者|名詞|普通名詞|*|漢|利用者 書き|動詞|*|連用形-一般|和|書く て|助詞|接続助詞 これ|代名詞|*|*|和 こと|名詞|*|*|和 を|助詞|格助詞 使う|動詞|*|終止形|和|使う 三|名詞|数詞 者|接尾辞")


@pytest.fixture(scope="module")
def ja(spark):
    source = "利用者を使う。これ書き、使う。書きて、使うこと。\n- サーバの版\n- 枝分かれと外す、除外する、取り外す\n- 日本語版\n現在の使う\n使う使う"
    return tokenizer(WORDS)(parse(spark.createDataFrame([(1, source)], "doc_id long, source string"))).cache()


def test_japanese_metrics(ja):
    row = measured_ja(ja).first()
    assert row.demonstrative_per_1k > 0 and row.keishiki_meishi_per_1k > 0 and row.renyo_per_1k == row.te_per_1k > 0 and row.renyo_te_ratio == 1
    assert 0 < row.kango_ratio < 1 and row.n_sentences == 4


def test_japanese_rules(ja, spark):
    kata, variant, aging = ja.select(rules.prefer_katakana("block_tokens"), rules.glossary_variant(), rules.time_dependent("ja")).first()
    assert [(p.line, p.column, p.text.split("｜")[0]) for p in kata] == [(1, 1, "利用者→ユーザー")]
    assert [(p.line, p.column, p.text.split("｜")[0]) for p in variant] == [(2, 1, "サーバ→サーバー"), (3, 6, "外す→除外する")]
    assert [(p.line, p.column) for p in aging] == [(5, 1)]
    rare = rules.rare_wago(ja, "block_tokens", spark.createDataFrame([("書く", 500)], "lemma string, n long")).first().rare_wago
    assert {p.text.split("｜")[0] for p in rare} == {"使う"} and len(rare) == 6
    assert rules.rare_wago(ja, "block_tokens", spark.createDataFrame([("使う", 90000)], "lemma string, n long")).first().rare_wago == []


def test_terms(spark):
    d = parse(spark.createDataFrame([(1, "The JSON API is good. The Http Gateway. We use Http Gateway, Foo\nuse `a_b` and `a b`\n| Table Word |")], "doc_id long, source string"))
    found = {r.word: r["count"] for r in terms.terms(d, "en", 1).collect()}
    assert found == {"JSON API": 1, "Http Gateway": 2, "Foo": 1, "a_b": 1}


def test_sentence_count_and_quartiles(spark):
    d = spark.createDataFrame([("A b c. D. E f g! h i j", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])], "t string, v array<double>")
    q1, q3 = hinges(F.col("v"))
    assert tuple(d.select(sentence_count(F.col("t"), "en"), q1, q3, quantile_exclusive(F.col("v"), 0.25), quantile_exclusive(F.col("v"), 0.75)).first()) == (3, 2.0, 6.0, 2.0, 6.0)


def test_profile_layers(spark):
    base = profiles.builtin(spark)
    patch, off = files.profile_patch(spark, files.settings('disable = ["ja.mattr100"]\n[thresholds."en.mattr100"]\nvalue = 0.5\n[thresholds."en.new"]\nvalue = 1\ndirection = "above"'))
    rows = {(r.doctype, r.metric): r for r in profiles.by_doctype(profiles.overlay(base, patch, off)).collect()}
    assert rows["", "en.mattr100"].threshold == 0.5 and rows["readme", "en.mattr100"].threshold == 0.87 and ("", "ja.mattr100") not in rows
    assert rows["", "en.new"].severity == "info" and ("decision", "en.prose_ratio") not in rows
    with pytest.raises(Exception, match="needs value and direction"):
        profiles.overlay(base, spark.createDataFrame([("x", None, None, None, None)], profiles.SCHEMA)).collect()


def test_calibration(spark):
    d = spark.createDataFrame([("en.mattr100", float(x)) for x in (1, 2, 3, 4, 5, 6, 7)] + [("en.prose_ratio", 0.5)] * 5 + [("en.simile_marker_per_1k", 1.0)], "metric string, value double")
    kept, rejected = profiles.calibrate(d, profiles.builtin(spark))
    assert {(r.metric, r.threshold) for r in kept.collect()} == {("en.mattr100", 12.0), ("en.prose_ratio", 0.5)}
    assert [(r.metric, r.reason) for r in rejected.collect()] == [("en.simile_marker_per_1k", "too few")]
    assert "value = 12.0" in files.profile_toml(kept, "own")


def test_reports(spark):
    docs = spark.createDataFrame([(1, "# T\n" + "It is soon so.\n" * 30, None), (2, "fine", None)], "doc_id long, source string, doctype string")
    out, found = report.check(docs, "doc_id")
    whole = report.reports(docs, out, found, "doc_id").cache()
    text = {r[0]: r[1] for r in whole.select("doc_id", report.markdown()).collect()}
    assert "- ほか10件" in text[1] and "maint/time-dependent（30件）" in text[1] and "- L2:7 soon｜" in text[1]
    assert whole.agg(report.exit_status(whole)).first()[0] == 1
    cut = {r[0]: r[1] for r in report.trim_reports(whole, 100).select("doc_id", report.markdown()).collect()}
    assert len(cut[1]) // 3 <= 100 and "（30件）" in cut[1]
    assert report.text_lines(found, "doc_id").count() > 20


def test_corpus(spark):
    chunks = spark.createDataFrame([("p", "en", 0, "prose", "a"), ("p", "ja", 0, "prose", "b"), ("q", "en", 0, "prose", "a"), ("q", "ja", 0, "code", "b"), ("r", "en", 0, "prose", "x")], "page string, variant string, idx int, kind string, text string")
    assert [tuple(r) for r in corpus.aligned(chunks).collect()] == [("p", 0, "a", "b")]
    pairs = spark.createDataFrame([("x", "y"), ("u", "v")], "old string, new string")
    assert [r.old for r in corpus.adoption(pairs, spark.createDataFrame([("y", 30), ("u", 30), ("v", 10)], "word string, n long")).collect()] == ["x"]
    picks = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "item long, choice string")
    assert corpus.convergence(picks, "item", "choice").first().top_share == 2 / 3


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "k8s__a.en.md").write_text("It is soon so.")
    (tmp_path / "in" / "no.txt").write_text("soon")
    docs = files.with_names(files.documents(spark, f"{tmp_path}/in"))
    assert [(r.domain, r.stem, r.variant, r.kind) for r in docs.collect()] == [("k8s", "k8s__a", "en", "md")]
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{tmp_path}/in").select(F.lit(1).alias("doc_id"), F.col("value").alias("source"))
    service.check_stream(stream, "doc_id", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["maint/time-dependent"]


def test_requests(spark):
    ask = lambda **x: json.loads(service.respond(spark, json.dumps({"jsonrpc": "2.0", "id": 1, **x})))
    assert service.respond(spark, " ") is None and service.respond(spark, '{"method": "ping"}') is None
    assert json.loads(service.respond(spark, "{"))["error"]["code"] == -32700
    assert ask(method="x")["error"]["code"] == -32601 and ask(method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert ask(method="tools/call", params={"name": "check", "arguments": {}})["result"]["isError"]
    assert "maint/time-dependent" in ask(method="tools/call", params={"name": "check", "arguments": {"text": "It is soon so."}})["result"]["content"][0]["text"]
    assert "## Decision" in brief.brief(spark, "en", doctype="decision") and brief.outlines(spark).count() == 6


def test_tokens_are_held_in_batches_of_bounded_size():
    import pyarrow as pa

    from foliolens.functions.morphology import token_batches

    texts = pa.array([["利用者を確認", "x" * 97], [], None, ["る る", ""]] * 250)
    dictionary = Dictionary.of("利用者|名詞 確認|名詞 を|助詞")
    out = list(token_batches(dictionary, iter([texts, texts.slice(0, 0), texts]), most=1000))
    size = lambda x: sum(len(t) for row in x.to_pylist() for t in row)
    assert max(map(size, out)) < 1000 + 100 + 2 and len(out) > 40
    rows = [row for x in out for row in x.to_pylist()]
    assert len(rows) == 2000 and rows[0][0] == [t._asdict() for t in dictionary.tokenize("利用者を確認")] and rows[1] == rows[2] == [] and [len(t) for t in rows[3]] == [2, 0]
