"""Column functions on text: white space, words, sentences, matches with their places, numerics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V

#: The Unicode white space, inside a class of a Java (or RE2) regular expression.
UWS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same for trimming by character, and as a class that Java looks up; patterns with it begin with (?U).
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
JAPANESE = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}"


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once each.

    Plain projections are merged by the optimizer, which copies their expressions to every
    place of use, also into lambdas. A generator of one row is not merged, and costs no shuffle.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def unicode(pattern: str) -> str:
    """The Java form of a pattern: \\s, \\d, \\w, \\b and (?i) know Unicode; . fits all, $ the very end only."""
    flags = "(?sU)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?siuU)", pattern[4:]
    return flags + (pattern[:-1] + r"\z" if pattern.endswith("$") else pattern)


def may_hold(text: Column, parts: tuple[str, ...]) -> Column:
    """False only for ASCII texts without any of the parts, which are in lower case: a cheap test before a pattern that needs one of them.

    Beyond ASCII a letter may be the same as one of ASCII but for its case, so such texts always pass.
    """
    return (F.octet_length(text) != F.length(text)) | let(F.lower(text), lambda low: any_of(F.contains(low, F.lit(x)) for x in parts))


def fits(text: Column, pattern: str) -> Column:
    found = text.rlike(unicode(pattern))
    return may_hold(text, V.NEEDED[pattern]) & found if pattern in V.NEEDED else found


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def let(value: Column, use) -> Column:
    """use(x) with x bound to the value, which is then evaluated once, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_chars(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def count_of(text: Column, part: str) -> Column:
    """Places of a fixed string, not overlapping."""
    return F.when(F.contains(text, F.lit(part)), F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(part), F.lit(""))), F.lit(len(part))).cast("long")).otherwise(F.length(text) * 0)


def words(text: Column) -> Column:
    """Lower-case words: split at white space, trimmed to letters and digits; found in one pass over the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"), 0), F.lower)


def reference_words(text: Column) -> Column:
    """Words for frequency tables: those with a letter."""
    return F.filter(words(text), lambda w: w.rlike(r"\p{L}"))


def per_1k(count: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(count / total * 1000)


def detect_lang(source: Column) -> Column:
    """ja if over a twentieth of the characters are kana or kanji, else en."""
    ja = F.length(F.regexp_replace(source, f"[^{JAPANESE}]+", ""))
    return F.when(ja * 20 > F.length(source), "ja").otherwise("en")


def detect_style(text: Column) -> Column:
    """desumasu, dearu or unknown, by how sentences end."""
    polite = F.regexp_count(text, F.lit("(?:です|ます|ました|ません|でしょう|ください)。"))
    plain = F.regexp_count(text, F.lit("(?:である|だ|た)。")) - F.regexp_count(text, F.lit("ました。"))
    return F.when((polite == 0) & (plain == 0), "unknown").when(polite > plain, "desumasu").otherwise("dearu")


def find_iter(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start int, text string>>, leftmost first, not overlapping; start counts from 0.

    The pattern must not match the empty string.
    """
    p = unicode(pattern)
    kind = "array<struct<start:int,text:string>>"
    empty = F.array().cast(kind)
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["g"])).alias("start"), x["m"].alias("text")))).alias("out"))
    found = F.zip_with(F.regexp_extract_all(text, F.lit(f"{p}"), 0), F.split(text, p, -1), lambda m, g: F.struct(g.alias("g"), m.alias("m")))
    return F.when(fits(text, pattern), F.aggregate(F.filter(found, lambda x: x["m"].isNotNull()), first, step, lambda s: s["out"])).otherwise(empty)


def context(text: Column, start: Column, n: Column, lang: str) -> Column:
    """A match with some characters around it, and … where more are left out."""
    around = V.CONTEXT[lang]
    a = F.greatest(start - around, F.lit(0))
    b = F.least(start + n + around, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "…").otherwise(""))


def enclosing_sentence(text: Column, start: Column, lang: str) -> Column:
    """The sentence that the character at start stands in; any full stop ends one."""
    ends = "。！？" if lang == "ja" else ".!?"
    before = F.regexp_replace(F.substring(text, F.lit(1), start), rf"(?s)\A.*[{ends}]", "")
    return F.concat(before, F.regexp_extract(F.substring(text, start + 1, F.length(text)), rf"(?s)\A[^{ends}]*[{ends}]?", 0))


def sentences_ja(text: Column) -> Column:
    """Sentences of Japanese text: five characters or more, one of them Japanese."""
    parts = F.transform(F.flatten(F.transform(F.split(text, r"\r?\n"), lambda p: F.split(p, r"(?<=[。！？])"))), trim)
    return F.filter(parts, lambda s: (F.length(s) >= 5) & s.rlike(f"[{JAPANESE}]"))


def sentence_count(text: Column, lang: str) -> Column:
    """English: a stop before white space or the end counts once two white spaces stood since the last one."""
    if lang == "ja":
        return F.size(sentences_ja(text))
    # Cut after each stop that white space or the end follows; white space belongs to what follows it.
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])(?=\s|\z)"), lambda x: F.regexp_count(x, F.lit(r"(?U)\s")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
    # The last part's rest counts by itself if no stop ends it; a part that a stop ends counts if it has two.
    step = lambda s, x: F.when(s["w"] + x >= 2, F.struct((s["n"] + 1).alias("n"), F.lit(0).alias("w"))).otherwise(F.struct(s["n"].alias("n"), (s["w"] + x).alias("w")))
    return F.aggregate(parts, start, step, lambda s: s["n"])


def heading_level(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, rf"\A[{UWS}]*(#*)", 1))


def g2(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    """Dunning's log-likelihood of a in n1 against b in n2."""
    e1, e2 = n1 * (a + b) / (n1 + n2), n2 * (a + b) / (n1 + n2)
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    return 2 * (part(a, e1) + part(b, e2))


def log_ratio(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    return F.log2(((a + 0.5) / n1) / ((b + 0.5) / n2))


def over_used(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    return (a / n1 > b / n2) & (g2(a, b, n1, n2) >= V.G2_CRITICAL) & (log_ratio(a, b, n1, n2) >= V.LOG_RATIO_MIN)


def median_of(ordered: Column) -> Column:
    """The median of a sorted array; null if it is empty."""
    n = F.size(ordered)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)


def hinges(ordered: Column) -> tuple[Column, Column]:
    """Medians of the lower and the upper half; of an odd number the middle one is in neither."""
    n = F.size(ordered)
    half = F.floor(n / 2).cast("int")
    return median_of(F.slice(ordered, F.lit(1), half)), median_of(F.slice(ordered, n - half + 1, half))


def quantile_exclusive(ordered: Column, p: float) -> Column:
    """Interpolated at (n + 1) p, counted from 1; at least two values."""
    n = F.size(ordered)
    at = (n + 1) * F.lit(p)
    low = F.greatest(F.lit(1), F.least(F.floor(at), n - 1)).cast("int")
    part = at - low
    return F.get(ordered, low - 1) * (1 - part) + F.get(ordered, low) * part


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def exact_log2(x: float) -> float:
    return math.log2(x)
