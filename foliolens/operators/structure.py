"""Structure rules: paragraphs, sections, leads, and what a type of document asks for.

Types are a dimension of a few dozen rows; they are literals of the plan, not a join, so a
document is judged where it is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T
from foliolens.operators.parse import field, front_matter
from foliolens.operators.rules import NONE, position


def long_paragraphs(lang: str) -> Column:
    counted = F.transform("paragraphs", lambda p: F.struct(p.alias("p"), T.sentence_count(p["text"], lang).alias("n")))
    return F.transform(F.filter(counted, lambda x: x["n"] > V.MAX_SENTENCES), lambda x: position(x["p"]["line"], 1, F.concat(x["n"].cast("string"), F.lit("文｜"), F.substring(x["p"]["text"], 1, 40))))


def empty_sections() -> Column:
    return F.transform(F.filter("outline", lambda o: ~o["has_body"] & ~o["has_child"]), lambda o: position(o["line"], 1, o["text"]))


def lead_opener(lang: str, k: int) -> Column:
    """The k-th pattern of openings, where it is the first that fits the lead."""
    head = T.trim_start(F.col("lead.text"))
    fits = [T.fits(head, p) for p, _ in V.LEAD_OPENERS[lang]]
    first = fits[k]
    for earlier in fits[:k]:
        first = first & ~earlier
    return F.when(first, F.array(position(F.col("lead.line"), 1, F.substring(head, 1, 40)))).otherwise(F.array().cast(NONE))


def work_note(lang: str, k: int) -> Column:
    pattern = V.WORK_NOTES[lang][k][0]
    held = F.filter("paragraphs", lambda p: T.fits(p["text"], pattern))

    def at(p):
        start = F.get(T.find_iter(p["text"], pattern), F.lit(0))["start"]
        return position(p["line"], 1, F.substring(p["text"], start + 1, F.lit(36)))

    return F.when(F.col("doctype").isNotNull() & ~F.col("doctype").isin(*V.WORK_NOTES_OK), F.transform(held, at)).otherwise(F.array().cast(NONE))


def _sections_of(lang: str, asks: dict[tuple[str, str], str] | None = None) -> Column:
    """What the declared type asks for, as array<struct>; one literal, whatever the number of types. Null if none is declared."""
    table = {
        doctype: [{"required": need, "lead_ok": lead, "name": (ja if lang == "ja" else en)[0], "ask": (asks or {}).get((doctype, section_id), ""), "names": [n.lower() for n in ja + en]} for section_id, need, lead, ja, en in sections]
        for doctype, sections in V.DOCTYPES.items()
    }
    kind = "map<string,array<struct<required:boolean,lead_ok:boolean,name:string,ask:string,names:array<string>>>>"
    return F.try_element_at(F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), kind), F.col("doctype"))


def _places(asked: str) -> Column:
    """Of the asked sections, in their order: the first heading that fits among the sections, and if any does in the outline.

    A heading fits if it contains one of the names, in lower case.
    """
    fits = lambda d, o: F.exists(d["names"], lambda n: F.contains(F.lower(o["text"]), n))

    def place(d):
        at = F.filter(F.transform("sections", lambda o, i: F.when(fits(d, o), i)), lambda x: x.isNotNull())
        return F.struct(d.alias("d"), F.array_min(at).alias("at"), F.exists("outline", lambda o: fits(d, o)).alias("nested"))

    return F.transform(asked, place)


def missing_sections() -> Column:
    """Required sections that are nowhere; the lead may stand for the first one, where that allows it."""
    gone = lambda p, k: p["d"]["required"] & p["at"].isNull() & ~p["nested"] & ~((k == 0) & p["d"]["lead_ok"] & F.col("lead").isNotNull())
    return F.transform(F.filter("places", gone), lambda p: position(F.lit(1), 1, F.concat(p["d"]["name"], F.lit("｜"), p["d"]["ask"])))


def section_order() -> Column:
    """Sections that stand before one that should come earlier, of those found, pair by pair."""
    found = F.filter("places", lambda p: p["at"].isNotNull())
    wrong = F.transform(F.array(found), lambda s: F.filter(s, lambda p, i: F.coalesce(p["at"] < F.get(s, i - 1)["at"], F.lit(False))))[0]

    def at(p):
        h = F.get("sections", p["at"])
        return position(h["line"], 1, F.concat(h["text"], F.lit("｜" + V.SECTION_ORDER_NOTE)))

    return F.transform(wrong, at)


def plot_mismatch(plot: str) -> Column:
    """Headings of an agreed plan that are missing, then sections that the plan does not have; null plans give none."""
    texts = F.transform("sections", lambda o: o["text"])
    missing = F.transform(F.filter(plot, lambda h: ~F.array_contains(texts, h)), lambda h: position(F.lit(1), 1, F.concat(F.lit(V.PLOT_ONLY + "｜"), h)))
    extra = F.transform(F.filter("sections", lambda o: ~F.array_contains(plot, o["text"])), lambda o: position(o["line"], 1, F.concat(F.lit(V.BODY_ONLY + "｜"), o["text"])))
    return F.when(F.col(plot).isNotNull(), F.concat(missing, extra)).otherwise(F.array().cast(NONE))


def resolve_doctype(docs: DataFrame, source: str = "source", path: str | None = None, foreign_field: str = "", foreign: dict[str, str] | None = None, paths: dict[str, str] | None = None, plot_doctype: str | None = None) -> DataFrame:
    """Adds doctype: declared in front matter, by a foreign field, by the longest path prefix, or by the plan.

    An unknown name fails the query.
    """
    d = T.bound(docs, _m=front_matter(F.col(source)))
    options = [field(F.col("_m"), "doctype")]
    if foreign_field and foreign:
        value = field(F.col("_m"), foreign_field)
        mapped = F.lit(None).cast("string")
        for old, new in foreign.items():
            mapped = F.when(value == old, new).otherwise(mapped)
        options.append(mapped)
    if paths and path:
        longest = F.when(F.lit(False), "")
        for prefix in sorted(paths, key=len, reverse=True):
            longest = longest.when(F.col(path).startswith(prefix), paths[prefix])
        options.append(longest)
    if plot_doctype:
        options.append(F.col(plot_doctype))
    found = F.coalesce(*options)
    checked = F.when(found.isNull() | found.isin(*V.DOCTYPES), found).otherwise(F.raise_error(F.concat(F.lit("unknown doctype: "), found)))
    return T.bound(d, doctype=checked).drop("_m")


def structure(parsed: DataFrame, lang: str, plot: str | None = None, asks: dict[tuple[str, str], str] | None = None) -> tuple[DataFrame, list]:
    """Adds columns of positions for the structure rules; parsed needs doctype (null: none declared).

    asks may say, by (doctype, section id), what a missing section has to answer.
    """
    d = T.bound(parsed, _asked=_sections_of(lang, asks))
    d = T.bound(d, places=_places("_asked"))
    columns = {"s_long": long_paragraphs(lang), "s_empty": empty_sections()}
    rules = [(V.LONG_PARAGRAPH, "s_long"), (V.EMPTY_SECTION, "s_empty")]
    for k, (_, message) in enumerate(V.LEAD_OPENERS[lang]):
        columns[f"s_lead{k}"] = lead_opener(lang, k)
        rules.append(((*V.LEAD_OPENER, message), f"s_lead{k}"))
    columns |= {"s_missing": missing_sections(), "s_order": section_order()}
    rules += [(V.MISSING_SECTION, "s_missing"), (V.SECTION_ORDER, "s_order")]
    for k, (_, message) in enumerate(V.WORK_NOTES[lang]):
        columns[f"s_note{k}"] = work_note(lang, k)
        rules.append(((*V.WORK_NOTE, message), f"s_note{k}"))
    if plot:
        columns["s_plot"] = plot_mismatch(plot)
        rules.append((V.PLOT_MISMATCH, "s_plot"))
    return T.bound(d, **columns), rules
