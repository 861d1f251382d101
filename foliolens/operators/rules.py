"""Rules with positions, as array columns over the blocks of a parsed document.

Each rule gives array<struct<line, column, text>> in its order of emission; findings()
turns rules into rows with at most twenty positions and the number left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T

POSITION = "struct<line:int,column:int,text:string>"
NONE = f"array<{POSITION}>"
B = "blocks"


def position(line: Column, column: Column | int, text: Column) -> Column:
    column = F.lit(column) if isinstance(column, int) else column
    return F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"), text.alias("text"))


def at_block(b: Column) -> Column:
    return position(b["line"], 1, F.substring(b["text"], 1, V.EXCERPT))


def finding(order: int, rule: tuple, positions: Column) -> Column:
    rule_id, severity, message = rule
    return F.struct(
        F.lit(order).alias("rule_ord"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"),
        F.slice(positions, 1, V.MAX_POSITIONS).alias("positions"), F.greatest(F.size(positions) - V.MAX_POSITIONS, F.lit(0)).cast("long").alias("truncated"),
    )


def findings(df: DataFrame, rules: list[tuple[tuple, str]], *keys: str) -> DataFrame:
    """(keys, rule_ord, rule_id, severity, message, positions, truncated): a row for each rule with positions."""
    return df.select(*keys, F.inline(found_of(rules)))


def found_of(rules: list[tuple[tuple, str]]) -> Column:
    """The same as an array of structs."""
    all_of = F.array(*(finding(k, rule, F.coalesce(F.col(column), F.array().cast(NONE))) for k, (rule, column) in enumerate(rules)))
    return F.filter(all_of, lambda f: F.size(f["positions"]) > 0)


def positions(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule_ord, rule_id, severity, n, line, column, text): a row for each position kept."""
    return found.select(*keys, "rule_ord", "rule_id", "severity", "message", F.posexplode("positions").alias("n", "p")).select(*keys, "rule_ord", "rule_id", "severity", "message", "n", "p.*")


def _before(run: Column) -> Column:
    return F.get(B, run["first"] - 2)


def lead_in_en(text: Column) -> Column:
    """ok, ng or other: a colon needs a marker of what follows; a full stop is fine."""
    marked = T.any_of(F.contains(F.lower(text), F.lit(m)) for m in V.LEAD_IN_MARKERS)
    t = T.trim(text)
    return F.when(t.endswith(":"), F.when(marked, "ok").otherwise("ng")).when(t.rlike(r"[.!?]\z"), "ok").otherwise("other")


def last_token(tokens: Column) -> Column:
    return F.get(tokens, F.size(tokens) - 1)


def is_taigen(t: Column) -> Column:
    return t["pos1"].isin("名詞", "代名詞", "接尾辞", "形状詞")


def lead_in_ja(text: Column, tokens: Column) -> Column:
    """By the last token before a colon, or the last one: particles and continuative verbs bind to the items."""
    t = T.trim(text)
    core = F.filter(tokens, lambda x: ~x["surface"].isin(":", "："))
    end = last_token(core)
    bound = (end["pos1"] == "助詞") | (end["pos1"].isin("動詞", "助動詞") & end["cform"].startswith("連用形"))
    colon = F.when(end.isNull(), "other").when(is_taigen(end), "ok").otherwise("ng")
    return F.when(t == "", "other").when(t.rlike(r"[。！？]\z"), "ok").when(t.rlike(r"[:：]\z"), colon).when(bound, "ng").otherwise("other")


def ending_en(text: Column) -> Column:
    return F.when(T.trim(text).rlike(r"[.!?]\z"), "period").otherwise("none")


def ending_ja(text: Column, tokens: Column) -> Column:
    t, end = T.trim(text), last_token(tokens)
    return F.when(t == "", "other").when(t.rlike(r"[。！？]\z"), "kuten").when(end.isNull(), "other").when(is_taigen(end), "taigen").otherwise("yougen")


def _tokens_at(tokens: str | None, seq: Column) -> Column:
    return F.get(tokens, seq - 1)


def list_lead_in(lang: str, tokens: str | None = None) -> Column:
    """Prose right before a list that the items are bound to."""
    kind = (lambda b: lead_in_en(b["text"])) if lang == "en" else (lambda b: lead_in_ja(b["text"], _tokens_at(tokens, b["seq"])))
    before = F.filter(F.transform("lists", _before), lambda b: b.isNotNull() & (b["kind"] == "Prose"))
    return F.transform(F.filter(before, lambda b: kind(b) == "ng"), at_block)


def _forward(b: Column, here: Column, after: Column, lang: str) -> Column:
    """Whether a count announces something: a pointing word, or what the next block is."""
    deeper = F.coalesce(T.heading_level(after["raw"]) > here, F.lit(True))
    announces = F.when(after["kind"].isin("ListItem", "Table"), True).when(after["kind"] == "Heading", deeper).when(after["kind"] == "Prose", T.fits(after["text"], V.ENUMERATION[lang])).otherwise(False)
    return T.fits(b["text"], V.FORWARD[lang]) | F.coalesce(announces, F.lit(False))


def matches_in(b: Column, pattern: str, lang: str) -> Column:
    def at(m):
        return position(b["line"], m["start"] + 1, F.concat(m["text"], F.lit("｜"), T.context(b["text"], m["start"], F.length(m["text"]), lang)))

    return F.transform(T.find_iter(b["text"], pattern), at)


def item_count(lang: str) -> Column:
    """Numbers of items in prose that announces them. Heading levels are looked up in the outline."""

    def hits(b):
        above = F.filter("outline", lambda o: o["seq"] < b["seq"])
        here = F.get(above, F.size(above) - 1)["level"]
        return F.when(_forward(b, here, F.get(B, b["seq"]), lang), matches_in(b, V.ITEM_COUNT[lang], lang)).otherwise(F.array().cast(NONE))

    held = F.filter(B, lambda b: (b["kind"] == "Prose") & T.fits(b["text"], V.ITEM_COUNT[lang]))
    return F.flatten(F.transform(held, hits))


def numbered_heading() -> Column:
    heads = F.filter(B, lambda b: b["kind"] == "Heading")
    return F.transform(F.filter(heads, lambda b, i: T.fits(T.trim(b["raw"]), V.NUMBERED_HEADING) & ~((i == 0) & T.trim_start(b["raw"]).startswith("# "))), at_block)


def manual_number() -> Column:
    return F.transform(F.filter(B, lambda b: (b["kind"] == "ListItem") & T.fits(b["raw"], V.MANUAL_NUMBER)), at_block)


def parallel_items(lang: str, tokens: str | None = None) -> Column:
    """Lists whose items end in more than one way, whatever their depth."""
    ending = (lambda b: ending_en(b["text"])) if lang == "en" else (lambda b: ending_ja(b["text"], _tokens_at(tokens, b["seq"])))
    mixed = lambda r: F.size(F.array_distinct(F.transform(F.slice(B, r["first"], r["last"] - r["first"] + 1), ending))) > 1
    return F.transform(F.filter("lists", mixed), lambda r: at_block(F.get(B, r["first"] - 1)))


def time_dependent(lang: str) -> Column:
    """Words and periods that age, in every block, unless their sentence names a date, a version or a numbered document."""
    words = "|".join(V.TIME_DEPENDENT[lang])
    patterns = [words if lang == "ja" else rf"(?i)\b({words})\b", V.RELATIVE_PERIOD[lang]]

    def hits(b):
        free = lambda p: F.filter(T.find_iter(b["text"], p), lambda m: ~T.fits(T.enclosing_sentence(b["text"], m["start"], lang), V.ANCHOR))
        at = lambda m: position(b["line"], m["start"] + 1, F.concat(m["text"], F.lit("｜"), T.context(b["text"], m["start"], F.length(m["text"]), lang)))
        tagged = F.concat(*(F.transform(free(p), lambda m: F.struct((m["start"] + 1).alias("column"), F.lit(k).alias("k"), at(m).alias("p"))) for k, p in enumerate(patterns)))
        # Of two hits at one place the words' counts.
        ordered = F.array_sort(tagged, lambda x, y: F.when(x["column"] != y["column"], x["column"] - y["column"]).otherwise(x["k"] - y["k"]))
        return F.transform(F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["column"] != x["column"], F.lit(True))))[0], lambda x: x["p"])

    held = F.filter(B, lambda b: T.any_of(T.fits(b["text"], p) for p in patterns))
    return F.flatten(F.transform(held, hits))


def trailing_etc(lang: str) -> Column:
    """Enumerations that end openly: those of list items first, then those of prose."""
    of = lambda kind: F.filter(B, lambda b: (b["kind"] == kind) & T.fits(T.trim(b["text"]), V.TRAILING_ETC[lang]))
    return F.transform(F.concat(of("ListItem"), of("Prose")), at_block)


def maintainability(parsed: DataFrame, lang: str, tokens: str | None = None) -> tuple[DataFrame, list]:
    """Adds a column of positions for each maintainability rule; ja needs tokens: an array of tokens for each block."""
    columns = [list_lead_in(lang, tokens), item_count(lang), numbered_heading(), manual_number(), parallel_items(lang, tokens), time_dependent(lang), trailing_etc(lang)]
    names = [f"m{k}" for k in range(1, 8)]
    return T.bound(parsed, **dict(zip(names, columns, strict=True))), list(zip(V.MAINT_RULES, names, strict=True))


# --- register and glossary (Japanese) -----------------------------------------------------------


def _body_blocks() -> Column:
    return F.filter(B, lambda b: b["kind"].isin("Prose", "ListItem"))


def _lemma(t: Column) -> Column:
    return F.when(t["lemma"] == "", t["surface"]).otherwise(t["lemma"])


def _marked(b: Column, t: Column, label: Column) -> Column:
    return position(b["line"], t["start"] + 1, F.concat(label, F.lit("｜"), T.context(b["text"], t["start"], F.length(t["surface"]), "ja")))


def prefer_katakana(tokens: str, allow: tuple[str, ...] = (), pairs: dict[str, str] | None = None) -> Column:
    """Chinese-style nouns for which documents of professionals use a loan word, unless a noun stands before."""
    table = F.create_map(*(F.lit(x) for kv in (V.KATAKANA_PAIRS if pairs is None else pairs).items() for x in kv))

    def hits(b):
        own = _tokens_at(tokens, b["seq"])
        fits = lambda t, i: (t["pos1"] == "名詞") & (t["goshu"] == "漢") & F.coalesce(F.get(own, i - 1)["pos1"] != "名詞", F.lit(True)) & F.try_element_at(table, _lemma(t)).isNotNull() & ~_lemma(t).isin(*allow) & ~t["surface"].isin(*allow)
        return F.transform(F.filter(own, fits), lambda t: _marked(b, t, F.concat(_lemma(t), F.lit("→"), F.try_element_at(table, _lemma(t)))))

    return F.flatten(F.transform(_body_blocks(), hits))


#: A reference of more lemmas than this is joined by lemma, a smaller one is one map of a few MB.
SMALL_REFERENCE = 50_000


def rare_wago(parsed: DataFrame, tokens: str, reference: DataFrame, content_words: int = V.REFERENCE_CONTENT_WORDS, allow: tuple[str, ...] = ()) -> DataFrame:
    """Adds rare_wago: native words that a document uses far more often than the reference (lemma, n).

    Occurrences are counted within the row. A reference of bounded size comes as one row with a map, so documents
    do not move; a larger one meets one row for each distinct set of counts and lemma, by a hash of their contents.
    """
    content = lambda t: t["pos1"].isin(*V.CONTENT_POS)
    target = lambda t: content(t) & (t["goshu"] == "和") & (t["pos2"] != "数詞") & ~t["surface"].rlike(r"\A[ァ-ヶー]\z") & ~_lemma(t).isin(*allow) & ~t["surface"].isin(*allow)
    found = F.flatten(F.transform(_body_blocks(), lambda b: F.transform(F.filter(_tokens_at(tokens, b["seq"]), target), lambda t: F.struct(_lemma(t).alias("lemma"), _marked(b, t, _lemma(t)).alias("p")))))
    total = F.aggregate(F.transform(_body_blocks(), lambda b: F.size(F.filter(_tokens_at(tokens, b["seq"]), content))), F.lit(0), lambda a, x: a + x)
    d = T.bound(parsed, _hits=found, _n1=F.greatest(total, F.lit(1)).cast("double"))
    d = T.bound(d, _lemmas=F.transform("_hits", lambda h: h["lemma"]))
    counted = F.transform(F.array_distinct("_lemmas"), lambda x: F.struct(x.alias("lemma"), F.size(F.filter("_lemmas", lambda y: y == x)).cast("double").alias("a")))
    d = T.bound(d, _often=F.filter(counted, lambda x: x["a"] >= V.MIN_OCCURRENCES))
    n2 = F.lit(float(max(content_words, 1)))
    if reference.limit(SMALL_REFERENCE + 1).count() <= SMALL_REFERENCE:
        one = reference.groupBy("lemma").agg(F.max("n").cast("double").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("lemma", "n"))).alias("_known"))
        d = d.join(F.broadcast(one), how="cross")  # one row
        over = F.filter("_often", lambda x: T.over_used(x["a"], F.coalesce(F.try_element_at("_known", x["lemma"]), F.lit(0.0)), F.col("_n1"), n2))
        d = T.bound(d, _over=F.transform(over, lambda x: x["lemma"])).drop("_known")
    else:
        d = T.bound(d, _id=F.sha2(F.to_json(F.struct("_often", "_n1")), 256))
        rows = d.select("_id", "_n1", F.inline("_often")).distinct().join(reference.select("lemma", "n"), "lemma", "left")
        held = rows.where(T.over_used(F.col("a"), F.coalesce("n", F.lit(0)).cast("double"), F.col("_n1"), n2)).groupBy("_id").agg(F.collect_set("lemma").alias("_over"))
        d = d.join(held, "_id", "left").drop("_id")
    return d.withColumn("rare_wago", F.transform(F.filter("_hits", lambda h: F.coalesce(F.array_contains("_over", h["lemma"]), F.lit(False))), lambda h: h["p"])).drop("_hits", "_lemmas", "_often", "_n1", "_over")


def glossary_entries(terms=None, orthography=None, project: list[tuple[str, str, list[str]]] = ()) -> list[tuple[str, str, list[str], bool]]:
    """(from, to, keep, guard): built-in forms, then the project's, which replace any that meet or reverse them."""
    out = [(v, p, [], p.startswith(v)) for p, v in (V.ORTHOGRAPHY if orthography is None else orthography)]
    out += [(r, p, keep, False) for p, rejected, keep in (V.TERMS if terms is None else terms) for r in rejected if len(r) > 1]
    for a, b, keep in project:
        out = [e for e in out if e[0] not in (a, b) and e[1] not in (a, b)] + [(a, b, keep, False)]
    return out


def occurrences(text: Column, part: str) -> Column:
    """Starts (from 0) of a fixed string, not overlapping."""
    gaps = F.split(text, rf"\Q{part}\E", -1)
    starts = F.aggregate(gaps, F.struct(F.lit(-len(part)).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, g: F.struct((s["at"] + F.length(g) + len(part)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(g) + len(part))).alias("out")), lambda s: s["out"])
    return F.when(F.contains(text, F.lit(part)), F.slice(starts, F.lit(1), F.size(starts) - 1)).otherwise(F.array().cast("array<int>"))


def glossary_variant(entries=None, allow: tuple[str, ...] = ()) -> Column:
    """Rejected forms, unless they stand in their replacement, in a context that keeps them, or before ー."""
    entries = [e for e in (glossary_entries() if entries is None else entries) if e[0] not in allow]

    def hits(b):
        t = b["text"]
        parts = []
        for k, (old, new, keep, guard) in enumerate(entries):
            inside = [c for c in [*([new] if old in new else []), *keep] if old in c]

            def free(at):
                held = F.lit(False)
                for c in inside:
                    held = held | F.exists(occurrences(t, c), lambda s: (s <= at) & (at + len(old) <= s + len(c)))
                if guard:
                    held = held | (F.substring(t, at + len(old) + 1, F.lit(1)) == "ー")
                return ~held

            at = F.transform(F.filter(occurrences(t, old), free), lambda s: F.struct((s + 1).alias("column"), F.lit(k).alias("k"), position(b["line"], s + 1, F.concat(F.lit(f"{old}→{new}｜"), F.substring(t, 1, 40))).alias("p")))
            parts.append(F.when(F.contains(t, F.lit(old)), at).otherwise(F.array().cast(f"array<struct<column:int,k:int,p:{POSITION}>>")))
        ordered = F.sort_array(F.concat(*parts))
        return F.transform(F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["column"] != x["column"], F.lit(True))))[0], lambda x: x["p"])

    held = F.filter(B, lambda b: b["kind"].isin("Prose", "ListItem") & T.any_of(F.contains(b["text"], F.lit(e[0])) for e in entries))
    return F.flatten(F.transform(held, hits)) if entries else F.array().cast(NONE)


def defined_names(names: list[tuple[str, list[str], str]]) -> Column:
    """Other forms of defined names (name, instead of, note); not part of check(), but to be called by itself."""
    parts = []
    for name, others, note in names:
        for other in others:
            parts.append(F.flatten(F.transform(F.filter(B, lambda b: b["kind"].isin("Prose", "ListItem") & F.contains(b["text"], F.lit(other))), lambda b: F.transform(occurrences(b["text"], other), lambda s: position(b["line"], s + 1, F.lit(f"{other}→{name}（{note}）"))))))
    if not parts:
        return F.array().cast(NONE)
    return F.array_sort(F.concat(*parts))
