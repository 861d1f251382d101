"""Corpus research: chunks, README sections, markup of other kinds, admission, status sentences, measures without a parser.

All of it is narrow: columns of one document, with built-in functions. Regular expressions take runs of
lines lazily, so that long texts do not nest calls. Only the last functions aggregate, always partially.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T

_W = T.UWS


def clean_heading(h: Column) -> Column:
    """A heading without images, links, tags, marks and pictures, in lower case."""
    for pattern, new in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"[*_`~#:]", ""), (r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]", "")):
        h = F.regexp_replace(h, pattern, new)
    return F.lower(T.trim(h))


def norm_lemma(lemma: Column) -> Column:
    """A lemma without what an analyser adds behind a hyphen."""
    return F.substring_index(lemma, "-", 1)


# --- chunks and sections ------------------------------------------------------------------------

_FENCE = rf"[{_W}&&[^\n]]*```"
_CHUNK = rf"(?sm)^{_FENCE}[^\n]*$.*?(?:^{_FENCE}[^\n]*$|\z)|^[{_W}&&[^\n]]*[^{_W}].*?(?=\n[{_W}&&[^\n]]*(?:\n|\z)|\n{_FENCE}|\z)"


def chunks(source: Column) -> Column:
    """array<struct<idx, kind, text>>: fenced code, or lines up to an empty one; without front matter and comments.

    A null source has none. A fence that nothing closes runs to the end.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?s)\A---\n.*?\n---\n", ""), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(_CHUNK), 0)
    return F.transform(found, lambda c, i: F.struct(i.alias("idx"), chunk_kind(c).alias("kind"), c.alias("text")))


def chunk_kind(chunk: Column) -> Column:
    s = T.trim_start(chunk)
    return F.when(s.startswith("```"), "code").when(s.startswith("#"), "heading").when(s.startswith("{{"), "shortcode").when(s.startswith("|"), "table").when(s.rlike(rf"\A([-*+]|\p{{Nd}}+[.)])[{_W}]"), "list").otherwise("prose")


def without_shortcodes(chunked: Column) -> Column:
    """Chunks as translations share them: shortcodes come and go."""
    kept = F.filter(chunked, lambda c: c["kind"] != "shortcode")
    return F.transform(kept, lambda c, i: F.struct(i.alias("idx"), c["kind"].alias("kind"), c["text"].alias("text")))


_HEAD = r"(?m)^(#{2,3})\s+(.+?)\s*#*$"


def readme_sections(source: Column) -> Column:
    """array<struct<heading, body>> at headings of level two and three, comments left out."""
    s = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?s)<!--.*?-->", "")
    bodies = F.split(s, _HEAD, -1)
    return F.transform(F.regexp_extract_all(s, F.lit(_HEAD), 2), lambda h, i: F.struct(h.alias("heading"), F.get(bodies, i + 1).alias("body")))


def composition(body: Column) -> Column:
    """struct<chars, code, bullets, tables, prose, subheadings>: what a section is made of, in lines but for chars and code blocks."""
    plain = F.regexp_replace(body, "(?s)```.*?```", "")
    lines = F.filter(F.split(plain, "\n", -1), lambda x: x.rlike(f"[^{_W}]"))
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return F.struct(
        F.length(plain).alias("chars"), F.floor(F.regexp_count(body, F.lit("(?m)^```")) / 2).cast("int").alias("code"), n(rf"\A[{_W}]*(?:[-*+][{_W}]|[0-9]+[.)][{_W}])").alias("bullets"),
        n(rf"\A[{_W}]*\|").alias("tables"), (F.size(lines) - n(rf"\A[{_W}]*(?:[-*+][{_W}]|[0-9]+[.)][{_W}]|\||#|>)")).alias("prose"), F.regexp_count(body, F.lit(r"(?m)^#{3,4}\s")).alias("subheadings"),
    )


def markup_free(text: Column, kind: str) -> tuple[Column, Column]:
    """(prose, text with its line marks) of md, rst or texi."""
    for pattern, new in V.MARKUP[kind]:
        text = F.regexp_replace(text, pattern, new)
    skipped = rf"\A(#{{1,6}}[{_W}]|([-*+]|\p{{Nd}}+[.)])[{_W}]|\||>)"
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("x"), T.trim(x).alias("s"))), lambda l: (l["s"] != "") & ~l["s"].rlike(skipped) & ~T.trim_start(l["x"]).rlike(skipped))
    prose = F.array_join(F.transform(lines, lambda l: l["s"]), "\n")
    for pattern, new in V.MARKUP_INLINE:
        prose = F.regexp_replace(prose, pattern, new)
    return prose, text


# --- admission and status -----------------------------------------------------------------------


def _count(text: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))


def in_target_language(source: Column) -> Column:
    """Is it English or Japanese? Many kanji with few kana are neither."""
    kana, han, latin = (_count(source, x) for x in (r"\x{3040}-\x{30FF}", r"\x{4E00}-\x{9FFF}", "A-Za-z"))
    return ~((han > 200) & (kana * 10 < han)) & ((latin > 200) | (kana > 200))


def is_written(source: Column, least: int = 2000) -> Column:
    """Has somebody filled the template in? Few comments and marks of the template, enough text beside code."""
    marks = sum((T.count_of(source, m) for m in V.TEMPLATE_MARKS[1:]), T.count_of(source, V.TEMPLATE_MARKS[0]))
    rest = F.regexp_replace(F.regexp_replace(source, r"(?s)<!--.*?-->", ""), "(?s)```.*?```", "")
    return (T.count_of(source, "<!--") <= 8) & (marks <= 2) & (F.length(rest) >= least)


def is_analysable_en(prose: Column, n_words: Column, n_sentences: Column) -> Column:
    return (F.length(prose) >= 1500) & (n_words >= 400) & (n_sentences >= 20)


def is_analysable_ja(n_sentences: Column) -> Column:
    return n_sentences >= 8


def status_sentences(sections: Column) -> Column:
    """array<struct<class, sentence>> of sentences that tell a state of work: under a heading that announces it (signposted), addressed to the reader, about the work, or plain."""

    def of(s):
        parts = F.split(s["body"], rf"(?<=[.!?])[{_W}]+|\n[{_W}]*\n|\n[{_W}]*[-*+][{_W}]+", -1)
        told = F.filter(F.transform(parts, lambda x: T.trim(F.regexp_replace(x, f"[{_W}]+", " "))), lambda x: T.fits(x, V.STATUS_MARKERS))
        kind = lambda x: F.when(T.fits(s["heading"], V.SIGNPOST), "signposted").when(T.fits(x, V.ADDRESSED), "addressed").when(T.fits(x, V.ABOUT_THE_WORK), "about_work").otherwise("plain")
        return F.transform(told, lambda x: F.struct(kind(x).alias("class"), x.alias("sentence")))

    return F.flatten(F.transform(sections, of))


# --- measures -----------------------------------------------------------------------------------

EN_RESEARCH = ("timeless_violation_1k", "emdash_1k", "bold_1k", "excess_1k", "simile_marker_1k", "count_declaration", "bad_list_lead", "good_list_lead", "list_ratio")


def research_en(docs: DataFrame, source: str, *keys: str, kind: str = "md", excess: tuple[str, ...] = ()) -> DataFrame:
    """(keys, metric, value): measures of English that need no parser. excess: words to count, a parameter. Texts without words have rates of zero."""
    prose, raw = markup_free(F.coalesce(F.col(source), F.lit("")), kind)
    d = T.bound(docs, _prose=prose, _raw=raw)
    d = T.bound(d, _w=T.words(F.col("_prose")), _l=F.filter(F.split("_raw", "\n", -1), lambda x: x.rlike(f"[^{_W}]")))
    per = lambda c: T.per_1k(c.cast("double"), F.size("_w"))
    among = lambda words: F.size(F.filter("_w", lambda w: w.isin(*words))) if words else F.lit(0)
    n = lambda column, p: F.regexp_count(column, F.lit(T.unicode(p)))
    leads = F.regexp_extract_all("_raw", F.lit(rf"(?m)^([^\n]{{6,}}):[{_W}]*\n[{_W}]*(?:[-*+]|\p{{Nd}}+[.)])[{_W}]"), 1)
    d = T.bound(d, _leads=leads)
    good = F.size(F.filter("_leads", lambda x: T.fits(x, V.GOOD_LEAD)))
    values = {
        "timeless_violation_1k": per(among(V.TIMELESS) + n("_prose", V.TIMELESS_PHRASE)), "emdash_1k": per(n("_prose", r"—|(?<=\w)--(?=\w)| -- ")), "bold_1k": per(n("_raw", r"\*\*[^*]+\*\*")), "excess_1k": per(among(excess)),
        "simile_marker_1k": per(n("_prose", V.SIMILE_RESEARCH)), "count_declaration": n("_prose", V.COUNT_DECLARATION), "bad_list_lead": F.size("_leads") - good, "good_list_lead": good,
        "list_ratio": F.size(F.filter("_l", lambda x: x.rlike(rf"\A[{_W}]*([-*+]|\p{{Nd}}+[.)])[{_W}]"))) / F.greatest(F.size("_l"), F.lit(1)),
    }
    return d.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), values[m].cast("double").alias("value")) for m in EN_RESEARCH))))


def led_to_lists(parsed: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """(groups, with_list, without, share): how often a block of prose that fits a pattern has a list right after it."""
    at = F.transform("blocks", lambda b, i: F.when((b["kind"] == "Prose") & T.fits(b["raw"], pattern), F.coalesce(F.get("blocks", i + 1)["kind"] == "ListItem", F.lit(False))))
    d = parsed.select(*groups, F.explode(F.filter(at, lambda x: x.isNotNull())).alias("led"))
    d = d.groupBy(*groups).agg(F.count(F.when(F.col("led"), 1)).alias("with_list"), F.count(F.when(~F.col("led"), 1)).alias("without"))
    return d.withColumn("share", F.col("with_list") / (F.col("with_list") + F.col("without")))


def pair_counts(counts: DataFrame, pairs: DataFrame, domain: str) -> DataFrame:
    """(ours, theirs, domain, ours_n, theirs_n) for every pair of words (ours, theirs) in every domain of (domain, word, n).

    counts is read once: a domain becomes one row with the counts of the pairs' words.
    """
    pairs = pairs.select("ours", "theirs").distinct()
    words = pairs.select(F.explode(F.array("ours", "theirs")).alias("word")).where("word is not null").distinct().withColumn("_held", F.lit(True))
    own = counts.join(F.broadcast(words), "word", "left").select(domain, F.when(F.col("_held"), F.col("word")).alias("word"), "n").groupBy(domain, "word").agg(F.sum("n").alias("n"))
    held = own.groupBy(domain).agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "n")))).alias("_n"))
    n = lambda side: F.coalesce(F.try_element_at("_n", F.col(side)), F.lit(0)).cast("long").alias(f"{side}_n")
    return held.join(F.broadcast(pairs), how="cross").select("ours", "theirs", domain, n("ours"), n("theirs"))  # a row for each domain


def picked(text: Column, forms: list[str]) -> Column:
    """The longest of the forms that a text holds; of equals the first given."""
    found = F.lit(None).cast("string")
    for form in sorted(forms, key=len):
        found = F.when(F.contains(text, F.lit(form)), form).otherwise(found)
    return found


def term_agreement(pairs: DataFrame, ours: str, theirs: str, terms: dict[str, list[str]]) -> DataFrame:
    """(term, ours_form, theirs_form, n): which form of a term two translations took, where ours has one; theirs is null if it has none."""
    rows = F.array(*(F.struct(F.lit(t).alias("term"), picked(F.col(ours), f).alias("ours_form"), picked(F.col(theirs), f).alias("theirs_form")) for t, f in terms.items()))
    return pairs.select(F.inline(rows)).where("ours_form is not null").groupBy("term", "ours_form", "theirs_form").agg(F.count(F.lit(1)).alias("n"))


def unmatched_headings(headings: DataFrame, key: str, known: Column, top: int = 12) -> DataFrame:
    """(heading, docs): cleaned headings that are none of the known sections, in how many documents; the most frequent first."""
    h = T.bound(headings, _h=clean_heading(F.col("text")))
    d = h.where(~known & (F.col("_h") != "")).groupBy(F.col("_h").alias("heading")).agg(F.countDistinct(key).alias("docs"))
    return d.orderBy(F.desc("docs"), "heading").limit(top)
