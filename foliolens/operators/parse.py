"""Markdown to blocks, paragraphs, list groups and outlines; a narrow operation per document.

A document's blocks are one array of structs, so that neighbours are looked up by index
and no shuffle is needed, however many rules look at them. blocks_of() and the like turn
them into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions.text import UWS, bound, heading_level, let, trim

FRONT_MATTER = r"(?s)\A(---\n.*?\n---\n)"
HEADING = rf"(?s)\A {{0,3}}#{{1,6}}[{UWS}]+(.*)\z"
LIST_ITEM = rf"(?s)\A([{UWS}]*)([-*+]|\p{{Nd}}+[.)])[{UWS}]+(.*)\z"
TAG = r"<[^>]+>"
_SPANS = "array<struct<a:int,b:int>>"


def _lines(text: Column) -> Column:
    """Lines without their ends; what follows the last \\n is a line too (blank, as a rule)."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("x")))


def fence_spans(lines: Column) -> Column:
    """Fenced code as array<struct<a, b>> of first and last lines; what is never closed runs to the end.

    Only lines that begin with a fence's characters are folded over.
    """
    rows = F.filter(_numbered(lines), lambda r: r["x"].rlike(rf"\A[{UWS}]*[`~]"))

    def seen(r):
        t = trim(r["x"])
        n = F.length(F.regexp_extract(t, r"\A(`+|~+)", 1))
        indent = F.octet_length(r["x"]) - F.octet_length(F.regexp_replace(r["x"], rf"\A[{UWS}]+", ""))
        return F.struct(r["line"].alias("line"), F.substring(t, 1, 1).alias("c"), n.alias("n"), ((n >= 3) & (indent <= 3)).alias("opens"), (n == F.length(t)).alias("pure"))

    state = lambda c, n, at, out: F.struct(c.alias("c"), n.alias("n"), at.alias("at"), out.alias("out"))
    start = state(F.lit(""), F.lit(0), F.lit(0), F.array().cast(_SPANS))

    def step(s, r):
        closes = (s["c"] == r["c"]) & r["pure"] & (r["n"] >= s["n"])
        closed = state(F.lit(""), F.lit(0), F.lit(0), F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), r["line"].alias("b")))))
        opened = state(r["c"], r["n"], r["line"], s["out"])
        return F.when((s["c"] == "") & r["opens"], opened).when((s["c"] != "") & closes, closed).otherwise(s)

    return F.aggregate(F.transform(rows, seen), start, step, lambda s: F.when(s["c"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), F.size(lines).alias("b"))))))


def shortcode_spans(lines: Column) -> Column:
    """Code shortcodes from their opening line to the first later line with their end; others are ignored."""
    return let(F.filter(_numbered(lines), lambda r: F.contains(r["x"], F.lit("{{<"))), _shortcodes)


def _shortcodes(rows: Column) -> Column:
    opener = rf"\A[{UWS}]*\{{\{{<[{UWS}]*"

    def name(x):
        return F.when(x.rlike(rf"(?s){opener}tab .*codelang"), "tab").otherwise(F.regexp_extract(x, f"{opener}({'|'.join(V.CODE_SHORTCODES)})", 1))

    names = [*V.CODE_SHORTCODES, "tab"]
    at = lambda n: F.transform(F.filter(rows, lambda r: r["x"].rlike(rf"\{{\{{<[{UWS}]*/[{UWS}]*{n}")), lambda r: r["line"])

    def spans(ends):
        def seen(r):
            return let(name(r["x"]), lambda own: F.struct(r["line"].alias("a"), F.when(own != "", F.array_min(F.filter(F.try_element_at(ends, own), lambda e: e > r["line"]))).alias("b")))

        found = F.filter(F.transform(rows, seen), lambda r: r["b"].isNotNull())
        step = lambda out, r: F.when(r["a"] > F.coalesce(F.get(out, F.size(out) - 1)["b"], F.lit(0)), F.concat(out, F.array(r))).otherwise(out)
        return F.aggregate(found, F.array().cast(_SPANS), step)

    return let(F.create_map(*(x for n in names for x in (F.lit(n), at(n)))), spans)


def _blanked(lines: Column, spans: Column) -> Column:
    """Lines with those of spans, which follow each other, empty; put together from slices, so that no line is held against each span."""

    def piece(s, i):
        done = F.coalesce(F.get(spans, i - 1)["b"], F.lit(0))
        return F.concat(F.slice(lines, done + 1, s["a"] - 1 - done), F.array_repeat(F.lit(""), s["b"] - s["a"] + 1))

    rest = F.slice(lines, F.get(spans, F.size(spans) - 1)["b"] + 1, F.size(lines))
    return F.when(F.size(spans) == 0, lines).otherwise(F.concat(F.flatten(F.transform(spans, piece)), rest))


def _newlines(x: Column) -> Column:
    return F.repeat(F.lit("\n"), F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))


def strip_html(text: Column) -> Column:
    """Tags are taken out; line ends within them stay."""
    parts = F.zip_with(F.split(text, TAG, -1), F.regexp_extract_all(text, F.lit(TAG), 0), lambda g, m: F.concat(g, _newlines(F.coalesce(m, F.lit("")))))
    return F.when(F.contains(text, F.lit("<")), F.array_join(parts, "")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([.\-+*_#`\[\]()<>|])", "$1")).otherwise(text)


def strip_inline(line: Column) -> Column:
    """Links and images to their text, code spans to nothing, emphasis to its text; trimmed."""
    held = lambda c, mark, new: F.when(F.contains(c, F.lit(mark)), new(c)).otherwise(c)
    links = lambda c: F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    spans = lambda c: F.regexp_replace(c, r"`[^`]*`", "")
    marks = lambda c: F.regexp_replace(c, r"\*\*([^*]*)\*\*|\*([^*]*)\*", "$1$2")
    return trim(let(let(held(line, "](", links), lambda x: held(x, "`", spans)), lambda x: held(x, "*", marks)))


def _expanded(spans: Column) -> Column:
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))


def runs(blocks: Column, member, broken=None) -> Column:
    """Maximal runs of adjacent blocks as array<struct<first, last>> of seq; broken(b): b begins a new one."""
    broken = broken or (lambda b: F.lit(False))
    inside = lambda i: F.coalesce(member(F.get(blocks, i)), F.lit(False))
    first = F.filter(blocks, lambda b, i: member(b) & (~inside(i - 1) | broken(b)))
    last = F.filter(blocks, lambda b, i: member(b) & (~inside(i + 1) | F.coalesce(broken(F.get(blocks, i + 1)), F.lit(True))))
    return F.zip_with(F.transform(first, lambda b: b["seq"]), F.transform(last, lambda b: b["seq"]), lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def is_kind(*kinds: str):
    return lambda b: b["kind"].isin(*kinds)


PARTS = ("blocks", "code_lines", "non_empty_lines", "prose", "body", "lists", "paragraphs", "outline", "sections", "lead")


def parse(docs: DataFrame, source: str = "source", *parts: str) -> DataFrame:
    """docs with blocks, code_lines, non_empty_lines, prose and body, lists, paragraphs and outline, and their sections.

    Order: front matter, fences, code shortcodes, escapes, tags, lines, inline markup. What is
    removed keeps its line ends, so numbers of lines are those of the source. A null source has no blocks.
    Of parts (all by default) only what they need is computed: the columns are bound, so Spark cannot leave one out by itself.
    """
    need = set(parts or PARTS)
    need |= {"paragraphs", "sections"} if "lead" in need else set()
    need |= {"outline"} if "sections" in need else set()
    need |= {"code_lines"} if "outline" in need else set()
    d = bound(docs, _src=F.coalesce(F.col(source), F.lit("")))
    d = bound(d, _front=F.regexp_extract("_src", FRONT_MATTER, 1))
    d = bound(d, _raw=_lines(F.col("_src")), _l=_lines(F.concat(_newlines(F.col("_front")), F.substring("_src", F.length("_front") + 1, F.length("_src")))))
    fenced = F.col("_src").rlike("```|~~~")
    none = F.array().cast(_SPANS)
    d = bound(d, _f=F.when(fenced, fence_spans(F.col("_l"))).otherwise(none), _fr=F.when(fenced & (F.col("_front") != ""), fence_spans(F.col("_raw"))))
    short = F.contains("_src", F.lit("{{<"))
    d = bound(d, _l2=_blanked(F.col("_l"), F.col("_f")))
    d = bound(d, _c=F.when(short, shortcode_spans(F.col("_l2"))).otherwise(none), _cr=F.when(short, shortcode_spans(F.col("_raw"))).otherwise(none))
    d = bound(d, _t=F.array_join(_blanked(F.col("_l2"), F.col("_c")), "\n"))
    d = bound(d, _t2=unescape(F.col("_t")))
    d = bound(d, _n=F.split(strip_html(F.col("_t2")), "\n", -1))
    none_or = lambda c, mark, found: F.contains(c, F.lit(mark)) & found
    lines = F.transform("_n", lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw"), trim(x).alias("t")))
    rows = F.filter(F.transform("_b", lambda r, i: F.struct(r["line"].alias("line"), r["raw"].alias("raw"), r["t"].alias("t"), F.coalesce(F.get("_b", i - 1)["t"] == "", F.lit(True)).alias("blank_before"))), lambda r: r["t"] != "")

    def kinds(r):
        raw, t = r["raw"], r["t"]
        heading = none_or(raw, "#", raw.rlike(HEADING))
        kind = F.when(heading, "Heading").when(raw.rlike(LIST_ITEM), "ListItem").when(t.startswith("|"), "Table").when(t.startswith(">"), "Quote").otherwise("Prose")
        return F.struct(r["line"].alias("line"), raw.alias("raw"), t.alias("t"), r["blank_before"].alias("blank_before"), kind.alias("kind"))

    def block(r, i):
        raw, kind = r["raw"], r["kind"]
        item = kind == "ListItem"
        text = F.when(kind == "Heading", F.regexp_extract(raw, HEADING, 1)).when(item, F.regexp_extract(raw, LIST_ITEM, 3)).otherwise(r["t"])

        def depth(indent):
            return F.when(indent == "", 0).otherwise(F.floor((F.length(F.regexp_replace(indent, "[^ ]", "")) + 2 * F.length(F.regexp_replace(indent, "[^\t]", ""))) / 2)).cast("int")

        return F.struct(
            (i + 1).alias("seq"), kind.alias("kind"), r["line"].alias("line"), strip_inline(text).alias("text"), F.when(item, let(F.regexp_extract(raw, LIST_ITEM, 1), depth)).otherwise(0).alias("depth"),
            F.when(item, ~F.regexp_extract(raw, LIST_ITEM, 2).isin("-", "*", "+")).otherwise(False).alias("ordered"), raw.alias("raw"), r["blank_before"].alias("blank_before"),
        )

    d = bound(d, _b=lines)
    d = bound(d, _rows=F.transform(rows, kinds))
    code = F.array_sort(F.array_distinct(F.concat(_expanded(F.coalesce("_fr", "_f")), _expanded(F.col("_cr")))))
    d = bound(d, blocks=F.transform("_rows", block), **({"code_lines": code} if "code_lines" in need else {}))
    b = F.col("blocks")
    joined = lambda *kinds: F.array_join(F.transform(F.filter(b, is_kind(*kinds)), lambda x: x["text"]), "\n")
    columns = {
        "non_empty_lines": lambda: F.size(b), "prose": lambda: joined("Prose"), "body": lambda: joined("Prose", "ListItem"), "lists": lambda: runs(b, is_kind("ListItem")),
        "paragraphs": lambda: runs(b, is_kind("Prose"), lambda x: x["blank_before"]), "outline": lambda: F.filter(b, is_kind("Heading")),
    }
    inner = {"paragraphs": "_p", "outline": "_h"}
    if wanted := {inner.get(n, n): c() for n, c in columns.items() if n in need}:
        d = bound(d, **wanted)
    items = lambda r: F.slice("blocks", r["first"], r["last"] - r["first"] + 1)
    paragraphs = lambda: F.transform("_p", lambda r: F.struct(F.get("blocks", r["first"] - 1)["line"].alias("line"), F.array_join(F.transform(items(r), lambda x: x["text"]), " ").alias("text")))

    def entry(h, i):
        later = F.get("_h", i + 1)
        end = F.coalesce(later["seq"], F.size("blocks") + 1)
        code = F.exists("code_lines", lambda c: (c > h["line"]) & (c < F.coalesce(later["line"], F.lit(2**31 - 1))))
        level = heading_level(h["raw"])
        return F.struct(h["seq"].alias("seq"), h["line"].alias("line"), level.alias("level"), h["text"].alias("text"), ((end - h["seq"] > 1) | code).alias("has_body"), F.coalesce(heading_level(later["raw"]) > level, F.lit(False)).alias("has_child"))

    later = {"paragraphs": paragraphs, "outline": lambda: F.transform("_h", entry)}
    if wanted := {n: c() for n, c in later.items() if n in need}:
        d = bound(d, **wanted)
    if "sections" in need:
        rest = F.when(F.get("outline", F.lit(0))["level"] == 1, F.slice("outline", 2, F.greatest(F.size("outline") - 1, F.lit(0)))).otherwise(F.col("outline"))
        d = bound(d, _o=rest)
        d = bound(d, _top=F.array_min(F.transform("_o", lambda o: o["level"])))
        d = bound(d, sections=F.filter("_o", lambda o: o["level"] == F.col("_top")))
    if "lead" in need:
        first = F.get("sections", F.lit(0))["line"]
        d = bound(d, lead=F.get(F.filter("paragraphs", lambda p: first.isNull() | (p["line"] < first)), F.lit(0)))
    return d.drop("_src", "_front", "_raw", "_l", "_f", "_fr", "_l2", "_c", "_cr", "_t", "_t2", "_n", "_b", "_rows", "_p", "_h", "_o", "_top")


def rows_of(parsed: DataFrame, array: str, *keys: str) -> DataFrame:
    """One row for each element of an array of structs."""
    return parsed.select(*keys, F.inline(array))


def front_matter(source: Column) -> Column:
    """What stands between the first line --- and the next one; null if there is none."""
    found = F.regexp_extract(source, r"(?s)\A---\n(.*?)\n---", 1)
    return F.when(source.rlike(r"(?s)\A---\n.*?\n---"), found)


def field(matter: Column, name: str) -> Column:
    """A field of front matter, without its quotes; null if it is not there."""
    line = rf"(?m)^{name}:(.*)$"
    return F.when(matter.rlike(line), F.regexp_replace(trim(F.regexp_extract(matter, line, 1)), r'\A"+|"+\z', ""))
