"""Text made from the dimensions: writing briefs, outlines to fill in, and the list of document types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V

_RULES = {
    "en": {
        "concise": ["Say one thing in a paragraph, in {n} sentences at most.", "Do not write how many items a list has.", "Do not number headings or items by hand."],
        "balanced": ["Let all items of a list end alike.", "Let a list follow a whole sentence, or a line with a colon that points at it.", "Begin with what the subject is."],
        "detailed": ["Do not end a list with etc.; say in its introduction that it is not complete.", "Give every section a body, or remove its heading.", "Do not tell how the work went; say what the reader can use."],
        "words": "Words that date a text, not to be used without a date, a version or a numbered document: ",
    },
    "ja": {
        "concise": ["一段落に一つのことを書き、{n}文までとする。", "箇条書きの項目の数を地の文に書かない。", "見出しや項目に手で番号を付けない。"],
        "balanced": ["箇条書きの項目の終わりの形を揃える。", "箇条書きの前の文は、文として閉じる。", "主題が何であるかから書き始める。"],
        "detailed": ["列挙を「など」で終えない。", "節には本文を書く。書かない節の見出しは消す。", "作業の経緯を書かない。"],
        "words": "時点に依存する語: ",
    },
}
_DETAILS = ("concise", "balanced", "detailed")


def brief(spark: SparkSession, lang: str = "ja", detail: str = "balanced", doctype: str | None = None, profile: DataFrame | None = None) -> str:
    """What to keep to while writing: sections of a type first if one is named, then rules, words, and guidance of the profile."""
    lang = "ja" if lang == "auto" else lang
    if detail not in _DETAILS or lang not in _RULES:
        raise ValueError(f"unknown detail or language: {detail}, {lang}")
    out = [outline(doctype, lang), ""] if doctype else []
    for level in _DETAILS[: _DETAILS.index(detail) + 1]:
        out += [f"- {x.format(n=V.MAX_SENTENCES)}" for x in _RULES[lang][level]]
    out.append("- " + _RULES[lang]["words"] + ", ".join(V.TIME_DEPENDENT[lang]))
    rows = profile.select("metric", "guidance").collect() if profile is not None else [(m, g) for m, _, _, _, g in V.THRESHOLDS]  # a dozen rows
    return "\n".join(out + [f"- {g}" for m, g in sorted(map(tuple, rows)) if m.startswith(f"{lang}.") and g]) + "\n"


def outline(doctype: str, lang: str = "ja") -> str:
    """The sections of a type as headings; what is optional is marked."""
    if doctype not in V.DOCTYPES:
        raise ValueError(f"unknown doctype: {doctype}")
    optional = {"ja": "（任意）", "en": " (optional)"}[lang]
    names = [(ja if lang == "ja" else en)[0] + ("" if required else optional) for _, required, _, ja, en in V.DOCTYPES[doctype]]
    return "\n\n".join([f"<!-- plan:doctype {doctype} -->", *(f"## {n}" for n in names)])


def sections(spark: SparkSession) -> DataFrame:
    """(doctype, ord, id, required, lead_ok, ja, en)."""
    rows = [(d, k, *s) for d, found in V.DOCTYPES.items() for k, s in enumerate(found)]
    return spark.createDataFrame(rows, "doctype string, ord int, id string, required boolean, lead_ok boolean, ja array<string>, en array<string>")


def outlines(spark: SparkSession, lang: str = "en") -> DataFrame:
    """(doctype, outline): for every type, built as a query over sections()."""
    name = F.concat(F.lit("## "), F.get(lang, F.lit(0)), F.when(F.col("required"), "").otherwise({"ja": "（任意）", "en": " (optional)"}[lang]))
    return sections(spark).groupBy("doctype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", name.alias("line")))), lambda x: x["line"]), "\n\n").alias("outline"))


def selftest(spark: SparkSession) -> bool:
    """Whether one small document is judged as it should be."""
    from foliolens.plans.report import check

    docs = spark.createDataFrame([(1, "# T\nIt is so currently.\n", None)], "doc_id long, source string, doctype string")
    _, found = check(docs, "doc_id")
    return [r.rule_id for r in found.collect()] == ["maint/time-dependent"]
