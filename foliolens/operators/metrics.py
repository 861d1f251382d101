"""Metrics of whole documents, as rows (doc_id, lang, metric, value); a metric that does not apply has no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T


def mattr(df: DataFrame, tokens: str, name: str, window: int = V.MATTR_WINDOW) -> DataFrame:
    """Adds the mean share of distinct tokens over all windows; of fewer tokens than a window, over all of them.

    In closed form: token p, last seen at position q, is the first of its kind in the windows
    that begin in (q, p], so each token adds its number of windows. One sort, no sets.
    """
    df = T.bound(df, _o=F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), _n=F.size(tokens))
    w, n = F.lit(window), F.col("_n")

    def gain(x, k):
        last = F.get("_o", k - 1)
        q = F.when(last["w"] == x["w"], last["i"]).otherwise(-1)
        return F.greatest(F.lit(0), F.least(x["i"], n - w) - F.greatest(F.lit(0), x["i"] - w + 1, q + 1) + 1).cast("long")

    total = F.aggregate(F.transform("_o", gain), F.lit(0).cast("long"), lambda a, b: a + b)
    value = F.when(n == 0, 0.0).when(n < w, F.size(F.array_distinct(tokens)) / n).otherwise(total / w / (n - w + 1))
    return T.bound(df, **{name: value}).drop("_o", "_n")


def _kind_share(blocks: str, kind: str) -> Column:
    n = F.size(blocks)
    return F.when(n == 0, 0.0).otherwise(F.size(F.filter(blocks, lambda b: b["kind"] == kind)) / n)


def _prose_ratio() -> Column:
    body = T.count_chars(F.col("body"))
    return F.when(body == 0, 0.0).otherwise(T.count_chars(F.col("prose")) / body)


def _pairs(lang: str, metrics: dict[str, Column]) -> Column:
    """array<struct<metric, value>> of those that apply."""
    return F.filter(F.array(*(F.struct(F.lit(f"{lang}.{n}").alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items())), lambda x: x["value"].isNotNull())


def measured_en(parsed: DataFrame) -> DataFrame:
    """Adds words, n_words, mattr100, similes, prose_ratio, list_ratio and n_sentences to parsed English documents."""
    d = T.bound(parsed, words=T.words(F.col("body")), _low=F.lower("body"))
    similes = sum((T.count_of(F.col("_low"), m) for m in V.SIMILE_MARKERS[1:]), T.count_of(F.col("_low"), V.SIMILE_MARKERS[0]))
    d = T.bound(d, n_words=F.size("words").cast("long"), similes=similes, prose_ratio=_prose_ratio(), list_ratio=_kind_share("blocks", "ListItem"), n_sentences=T.sentence_count(F.replace("prose", F.lit("\n"), F.lit(" ")), "en").cast("long"))
    return mattr(d, "words", "mattr100").drop("_low")


def with_metrics(parsed: DataFrame, lang: str) -> DataFrame:
    """parsed with measured: array<struct<metric, value>>; similes only of English documents with enough words."""
    if lang == "ja":
        d = measured_ja(parsed)
        return d.select(*parsed.columns, _pairs(lang, {n: F.col(n) for n in JA_METRICS}).alias("measured"))
    d = measured_en(parsed)
    simile = F.when(F.col("n_words") >= V.MIN_WORDS_FOR_SIMILE, T.per_1k(F.col("similes"), F.col("n_words")))
    return d.select(*parsed.columns, _pairs(lang, {"mattr100": F.col("mattr100"), "prose_ratio": F.col("prose_ratio"), "list_ratio": F.col("list_ratio"), "simile_marker_per_1k": simile}).alias("measured"))


def metrics_en(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, lang, metric, value)"""
    return with_metrics(parsed, "en").select(*keys, F.lit("en").alias("lang"), F.inline("measured"))


def measured_ja(parsed: DataFrame, prose_tokens: str = "prose_tokens", body_tokens: str = "body_tokens") -> DataFrame:
    """Adds the Japanese measures to parsed documents that carry tokens of their prose and of their body."""
    prose, body = F.col(prose_tokens), F.col(body_tokens)
    count = lambda tokens, test: F.size(F.filter(tokens, test))
    before_comma = lambda test: F.size(F.filter(prose, lambda t, i: test(t) & F.coalesce(F.get(prose, i + 1)["surface"] == "、", F.lit(False))))
    content = F.filter(body, lambda t: t["pos1"].isin(*V.CONTENT_POS))
    d = T.bound(parsed, _pc=T.count_chars(F.col("prose")), _bc=T.count_chars(F.col("body")), _g=F.transform(content, lambda t: t["goshu"]), _s=F.transform(body, lambda t: t["surface"]))
    kinds = F.filter("_g", lambda g: g.isin("和", "漢", "外", "混"))
    kanji, kana = F.length(F.regexp_replace("body", r"[^\x{4E00}-\x{9FFF}]+", "")), F.length(F.regexp_replace("body", r"[^\x{3040}-\x{30FF}]+", ""))
    d = T.bound(
        d,
        renyo_per_1k=T.per_1k(before_comma(lambda t: (t["pos1"] == "動詞") & t["cform"].startswith("連用形")), F.col("_pc")),
        te_per_1k=T.per_1k(before_comma(lambda t: t["surface"].isin("て", "で") & (t["pos2"] == "接続助詞")), F.col("_pc")),
        keishiki_meishi_per_1k=T.per_1k(count(body, lambda t: (t["pos1"] == "名詞") & t["surface"].isin(*V.FORMAL_NOUNS)), F.col("_bc")),
        demonstrative_per_1k=T.per_1k(count(body, lambda t: t["surface"].isin(*V.DEMONSTRATIVES)), F.col("_bc")),
        kango_ratio=F.when(F.size(kinds) == 0, 0.0).otherwise(F.size(F.filter("_g", lambda g: g == "漢")) / F.size(kinds)),
        kanji_ratio=F.when(kanji + kana == 0, 0.0).otherwise(kanji / (kanji + kana)),
        prose_ratio=_prose_ratio(), list_ratio=_kind_share("blocks", "ListItem"), n_sentences=F.size(T.sentences_ja(F.col("prose"))).cast("long"),
    )
    d = T.bound(d, renyo_te_ratio=F.when(F.col("te_per_1k") >= V.MIN_TE_FOR_RATIO, F.try_divide("renyo_per_1k", "te_per_1k")))
    return mattr(d, "_s", "mattr100").drop("_pc", "_bc", "_g", "_s")


JA_METRICS = ("mattr100", "prose_ratio", "renyo_te_ratio", "renyo_per_1k", "te_per_1k", "keishiki_meishi_per_1k", "demonstrative_per_1k", "kango_ratio", "kanji_ratio", "list_ratio")


def metrics_ja(parsed: DataFrame, *keys: str) -> DataFrame:
    return with_metrics(parsed, "ja").select(*keys, F.lit("ja").alias("lang"), F.inline("measured"))


def extra_ja(parsed: DataFrame) -> DataFrame:
    """Measures of research: sentence length and its spread, commas, loan words, polite and noun endings, runs of three like endings."""
    d = T.bound(parsed, _s=T.sentences_ja(F.col("prose")))
    d = T.bound(d, _n=F.size("_s"), _len=F.transform("_s", lambda s: F.length(s).cast("double")), _end=F.transform("_s", lambda s: F.regexp_extract(s, "(.{1,2})[。！？]?$", 1)))
    mean = F.aggregate("_len", F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    d = T.bound(d, mean_sentence=F.when(F.col("_n") > 0, mean))
    spread = F.sqrt(F.aggregate("_len", F.lit(0.0), lambda a, x: a + (x - F.col("mean_sentence")) ** 2) / F.col("_n"))
    commas = T.count_of(F.col("prose"), "、")
    same = lambda i: F.get("_end", i - 1) == F.get("_end", i)
    three = F.size(F.filter("_end", lambda e, i: F.coalesce(same(i) & same(i - 1) & ~F.coalesce(same(i - 2), F.lit(False)), F.lit(False))))
    share = lambda pattern: F.when(F.col("_n") > 0, F.size(F.filter("_s", lambda s: s.rlike(pattern))) / F.col("_n"))
    return T.bound(
        d, sentence_cv=F.when(F.col("mean_sentence") > 0, spread / F.col("mean_sentence")), commas_per_sentence=F.when(F.col("_n") > 0, commas / F.col("_n")),
        chars_per_comma=F.try_divide(T.count_chars(F.col("prose")), commas), desumasu_rate=share("(です|ます|ました|ません|でしょう|ください)。$"), dearu_rate=share("(である|だ|た)。$"), like_endings=three,
    ).drop("_s", "_n", "_len", "_end")


def out_of_range(metrics: DataFrame, thresholds: DataFrame, *keys: str) -> DataFrame:
    """Metrics beyond their threshold, strictly; thresholds are a small table, joined on metric (and on keys)."""
    joined = metrics.join(F.broadcast(thresholds), ["metric", *keys])
    return joined.where(F.when(F.col("direction") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")))
