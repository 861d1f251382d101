"""Domain terms of a corpus: runs of capitalised words, identifiers in code spans, runs of Japanese nouns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T

WORD = r"[A-Za-z][A-Za-z0-9'’-]*"
CODE_SPAN = r"`([^`\n]+)`"
IDENTIFIER = r"\A[A-Za-z][A-Za-z0-9_:.\-]*\z"
_CAPS = r"\A[A-Z0-9-]{2,}\z"
_CAPITAL = r"(?s)\A[A-Z].+\z"


def _runs(text: Column) -> Column:
    """Terms of one block, by one pass over its words.

    A word qualifies in capitals, or capitalised unless it begins a sentence. Punctuation
    between words ends a run. Until something ends the leading capitals, words count as initial.
    """
    pairs = F.zip_with(F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), 0), lambda g, w: F.struct(T.trim(g).alias("g"), w.alias("w")))
    start = F.struct(F.lit(True).alias("leading"), F.lit("").alias("run"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        broken = x["g"] != ""
        caps = x["w"].rlike(_CAPS) & x["w"].rlike("[A-Z]")
        initial = s["leading"] | x["g"].rlike(r"[.!?]\z")
        fits = caps | (x["w"].rlike(_CAPITAL) & ~initial)
        out = F.when((broken | ~fits) & (s["run"] != ""), F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"])
        run = F.when(~fits, "").when(broken | (s["run"] == ""), x["w"]).otherwise(F.concat(s["run"], F.lit(" "), x["w"]))
        return F.struct((s["leading"] & ~broken & caps).alias("leading"), run.alias("run"), out.alias("out"))

    done = lambda s: F.when(s["run"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["run"])))
    return F.aggregate(F.filter(pairs, lambda x: x["w"].isNotNull()), start, step, done)


def terms_of_en() -> Column:
    """All terms of a parsed document, repeats included."""
    spans = lambda b: F.filter(F.transform(F.regexp_extract_all(b["raw"], F.lit(CODE_SPAN), 1), T.trim), lambda x: x.rlike(IDENTIFIER))
    texts = F.filter("blocks", lambda b: b["kind"].isin("Prose", "ListItem", "Heading") & b["text"].rlike("[A-Z]"))
    coded = F.filter("blocks", lambda b: F.contains(b["raw"], F.lit("`")))
    return F.concat(F.flatten(F.transform(coded, spans)), F.flatten(F.transform(texts, lambda b: _runs(b["text"]))))


def terms_of_ja(tokens: str = "body_tokens") -> Column:
    """All runs of nouns (no numerals) and the suffixes after them; formal nouns by themselves and single characters are left out."""
    latin = lambda s: s.rlike(r"\A[A-Za-z0-9]+\z")
    start = F.struct(F.lit("").alias("run"), F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    kept = lambda s: (F.length(s["run"]) >= 2) & ~((s["n"] == 1) & s["run"].isin(*V.FORMAL_NOUNS))
    flushed = lambda s: F.when(kept(s), F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"])

    def step(s, t):
        fits = ((t["pos1"] == "名詞") & (t["pos2"] != "数詞")) | ((t["pos1"] == "接尾辞") & (s["n"] > 0))
        gap = F.when((s["n"] > 0) & latin(s["last"]) & latin(t["surface"]), " ").otherwise("")
        longer = F.struct(F.concat(s["run"], gap, t["surface"]).alias("run"), t["surface"].alias("last"), (s["n"] + 1).alias("n"), s["out"].alias("out"))
        ended = F.struct(F.lit("").alias("run"), F.lit("").alias("last"), F.lit(0).alias("n"), flushed(s).alias("out"))
        return F.when(fits, longer).otherwise(ended)

    return F.aggregate(tokens, start, step, flushed)


def terms(parsed: DataFrame, lang: str = "en", min_count: int = 2, tokens: str = "body_tokens") -> DataFrame:
    """(word, lang, count) of terms that stand min_count times or more in the corpus; counted per task, then shuffled."""
    found = terms_of_en() if lang == "en" else terms_of_ja(tokens)
    return parsed.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count).select("word", F.lit(lang).alias("lang"), "count")
