"""Statistics over corpora: frequency tables, keyness, substitution, adoption, rates, presence.

All of it is partial aggregation by word or by group; per-document sets are taken before any
shuffle, so a frequent word costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators.research import clean_heading


def word_counts(docs: DataFrame, words: Column, *groups: str, documents: bool = True) -> DataFrame:
    """(groups, word, n, docs): occurrences and documents of each word, in one pass; without documents no docs."""
    if not documents:
        return docs.select(*groups, F.explode(words).alias("word")).groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("n"))
    # In order, the first of equal words stands for the document.
    d = T.bound(docs, _words=F.sort_array(words)).select(*groups, "_words")
    first = F.transform("_words", lambda w, i: F.struct(w.alias("word"), F.when(F.get("_words", i - 1) == w, 0).otherwise(1).alias("first")))
    return d.select(*groups, F.inline(first)).groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))


def reference_table(counts: DataFrame, domain: str, domains: tuple[str, ...] | None = None, least_domains: int = 2, least: int = 1) -> DataFrame:
    """(word, n, domains): words that enough of the domains have."""
    held = counts.where(F.col(domain).isin(*domains)) if domains else counts
    return held.groupBy("word").agg(F.sum("n").alias("n"), F.countDistinct(domain).alias("domains")).where((F.col("domains") >= least_domains) & (F.col("n") >= least))


def keyness(a: DataFrame, b: DataFrame, least_docs: int = 3, critical: float = 15.13) -> DataFrame:
    """(word, a, b, g2, log_ratio, side): words that one of two (word, n, docs) tables uses far more, by log-likelihood.

    Totals are two rows and are broadcast as such.
    """
    total = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    j = a.select("word", F.col("n").alias("a"), F.col("docs").alias("da")).join(b.select("word", F.col("n").alias("b"), F.col("docs").alias("db")), "word", "full_outer").na.fill(0)
    j = j.join(F.broadcast(total(a, "n1").join(total(b, "n2"), how="cross")), how="cross")  # one row
    x, y, n1, n2 = F.col("a").cast("double"), F.col("b").cast("double"), F.col("n1"), F.col("n2")
    j = j.where("n1 > 0 and n2 > 0").withColumns({"g2": T.g2(x, y, n1, n2), "log_ratio": T.log_ratio(x, y, n1, n2), "over": x / n1 > y / n2})
    held = (F.col("g2") >= critical) & (F.when(F.col("over"), F.col("da")).otherwise(F.col("db")) >= least_docs)
    return j.where(held).select("word", "a", "b", "g2", "log_ratio", F.when(F.col("over"), "over").otherwise("under").alias("side"))


def substitutes(pairs: DataFrame, ours: str, theirs: str, least: int = 2, lift: float = 2.0, top: int = 3) -> DataFrame:
    """(word, instead, support, lift): of aligned pairs with word sets, what the other side says where only ours has a word."""
    n = pairs.agg(F.count(F.lit(1)).cast("double").alias("total"))
    base = pairs.select(F.explode(F.array_distinct(theirs)).alias("instead")).groupBy("instead").agg(F.count(F.lit(1)).cast("double").alias("df"))
    only = pairs.select(F.explode(F.array_except(ours, theirs)).alias("word"), F.array_except(theirs, ours).alias("rest"))
    of = only.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = only.select("word", F.explode("rest").alias("instead")).groupBy("word", "instead").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    j = c.join(of, "word").join(base, "instead").join(F.broadcast(n), how="cross")  # one row
    j = j.withColumn("lift", (F.col("support") / F.col("n")) / (F.col("df") / F.col("total"))).where(F.col("lift") >= lift)
    w = Window.partitionBy("word").orderBy((F.col("support") * F.ln("lift")).desc(), "instead")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("word", "instead", "support", "lift", "rank")


def dice_pairs(pairs: DataFrame, pivot: str, words: str, least: int = 3, dice: float = 0.25) -> DataFrame:
    """(pivot, word, hits, dice): words that go with a word of the other side, by Dice's coefficient."""
    both = pairs.select(F.explode(F.array_distinct(pivot)).alias("pivot"), F.array_distinct(words).alias("w"))
    dp = both.groupBy("pivot").agg(F.count(F.lit(1)).alias("dp"))
    dw = pairs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("dw"))
    hits = both.select("pivot", F.explode("w").alias("word")).groupBy("pivot", "word").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    j = hits.join(dp, "pivot").join(dw, "word").withColumn("dice", 2 * F.col("hits") / (F.col("dp") + F.col("dw")))
    return j.where(F.col("dice") >= dice).select("pivot", "word", "hits", "dice")


def adoption(pairs: DataFrame, counts: DataFrame, least: int = 20, most_old: int = 60, ratio: float = 2.0) -> DataFrame:
    """(old, new, old_n, new_n): pairs of words of which the new one is clearly in use; counts is (word, n)."""
    j = pairs.join(counts.select(F.col("word").alias("old"), F.col("n").alias("old_n")), "old", "left").join(counts.select(F.col("word").alias("new"), F.col("n").alias("new_n")), "new", "left").na.fill(0, ["old_n", "new_n"])
    return j.where((F.col("old_n") + F.col("new_n") >= least) & (F.col("old_n") <= most_old) & ((F.col("old_n") == 0) | (F.col("new_n") >= ratio * F.col("old_n")))).select("old", "new", "old_n", "new_n")


def rare_everywhere(counts: DataFrame, domain: str, per_million: float = 5.0) -> DataFrame:
    """(word, most): words under a rate in every domain of (domain, word, n); a domain without it counts as zero."""
    totals = counts.groupBy(domain).agg(F.sum("n").alias("total"))
    rate = F.col("n") * 1e6 / F.col("total")
    return counts.join(F.broadcast(totals), domain).groupBy("word").agg(F.max(rate).alias("most")).where(F.col("most") < per_million)  # a row for each domain


def pattern_rates(docs: DataFrame, text: str, patterns: dict[str, str], *groups: str, per: float = 10_000.0) -> DataFrame:
    """(groups, pattern, hits, chars, rate): matches for so many characters."""
    counts = F.array(*(F.struct(F.lit(n).alias("pattern"), F.regexp_count(text, F.lit(p)).cast("long").alias("hits")) for n, p in patterns.items()))
    rows = docs.select(*groups, F.length(text).cast("long").alias("chars"), F.inline(counts))
    d = rows.groupBy(*groups, "pattern").agg(F.sum("hits").alias("hits"), F.sum("chars").alias("chars"))
    return d.withColumn("rate", F.when(F.col("chars") > 0, F.col("hits") * per / F.col("chars")).otherwise(0.0))


def rate_ratio(rates: DataFrame, group: str, ours: str, theirs: str) -> DataFrame:
    """(pattern, ours, theirs, ratio): null where both are zero, infinite where only theirs is."""
    d = rates.groupBy("pattern").pivot(group, [ours, theirs]).agg(F.first("rate")).na.fill(0.0)
    a, b = F.col(ours), F.col(theirs)
    return d.select("pattern", a.alias("ours"), b.alias("theirs"), F.when(b > 0, a / b).when(a > 0, F.lit(float("inf"))).alias("ratio"))


def firing_rates(docs: DataFrame, positions: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, rule_id, docs, fired, share, findings): how often rules speak. positions: (key, rule_id, n) with counts."""
    totals = docs.groupBy(*groups).agg(F.count(F.lit(1)).alias("docs"))
    hits = positions.groupBy(key, "rule_id").agg(F.sum("n").alias("n"))
    by = docs.select(key, *groups).join(hits, key).groupBy(*groups, "rule_id").agg(F.count(F.lit(1)).alias("fired"), F.sum("n").alias("findings"))
    joined = by.join(F.broadcast(totals), list(groups)) if groups else by.join(F.broadcast(totals), how="cross")  # totals: a row for each group
    return joined.select(*groups, "rule_id", "docs", "fired", (F.col("fired") / F.col("docs")).alias("share"), "findings")


def in_all(counts: DataFrame, model: str, least: int = 3) -> DataFrame:
    """Words that every model has often enough."""
    held = counts.where(F.col("n") >= least)
    models = counts.select(F.countDistinct(F.when(F.col("n") >= 0, F.col(model))).alias("models"))  # with n, so that both sides share one shuffle
    return held.groupBy("word").agg(F.countDistinct(model).alias("k"), F.sum("n").alias("n")).join(F.broadcast(models), F.col("k") == F.col("models")).select("word", "n")


def aligned(chunks: DataFrame, page: str = "page", left: str = "en", right: str = "ja") -> DataFrame:
    """(page, idx, left, right): chunks of two variants of a page, where both have the same number and kinds of chunks."""
    a = chunks.where(F.col("variant") == left).select(page, "idx", F.col("kind").alias("lk"), F.col("text").alias("left"))
    b = chunks.where(F.col("variant") == right).select(page, "idx", F.col("kind").alias("rk"), F.col("text").alias("right"))
    j = a.join(b, [page, "idx"], "full_outer")
    whole = j.groupBy(page).agg(F.min(F.coalesce(F.col("lk") == F.col("rk"), F.lit(False))).alias("same")).where("same").select(page)
    return j.join(whole, page).select(page, "idx", "left", "right")


def section_presence(outline: DataFrame, key: str, names: dict[str, list[str]], total: DataFrame) -> DataFrame:
    """(name, docs, share, mean_place, first): how many documents have a section, and its mean rank of first appearance.

    A heading is a section if it equals one of its names, begins with it and a space, or ends with a space and it.
    """
    h = clean_heading(F.col("text"))
    which = F.when(F.lit(False), "")
    for name, forms in names.items():
        which = which.when(T.any_of((h == f) | h.startswith(f + " ") | h.endswith(" " + f) for f in map(str.lower, forms)), name)
    first = outline.select(key, which.alias("name"), "line").where("name is not null").groupBy(key, "name").agg(F.min("line").alias("line"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("line", "name")))
    d = placed.groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.avg("place").alias("mean_place"), F.count(F.when(F.col("place") == 1, 1)).alias("first"))
    return d.join(F.broadcast(total.agg(F.count(F.lit(1)).alias("total"))), how="cross").select("name", "docs", (F.col("docs") / F.col("total")).alias("share"), "mean_place", "first")  # one row


def collocations(sides: DataFrame, tokens: str, side: str, least: int = 2, top: int = 12) -> DataFrame:
    """(side, noun, verb, n): noun, を and verb in a row; those that other sides lack, the most frequent first."""
    d = noun_verbs(sides, tokens, side).groupBy(side, "noun", "verb").agg(F.count(F.lit(1)).alias("n"))
    own = d.groupBy("noun", "verb").agg(F.countDistinct(side).alias("sides")).where("sides = 1").select("noun", "verb")
    w = Window.partitionBy(side).orderBy(F.desc("n"), "noun", "verb")
    return d.where(F.col("n") >= least).join(own, ["noun", "verb"], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(side, "noun", "verb", "n")


def pivot_choices(dice: DataFrame, kind: Column, least_ratio: float = 2.0) -> DataFrame:
    """(pivot, kata, kata_hits, kango, kango_hits): of each pivot's words the best of either kind, where the first has least_ratio times the hits of the second.

    dice: as dice_pairs() gives it; kind: kata, kango or null, by word. Of equals the first word.
    """
    best = dice.withColumn("kind", kind).where("kind is not null").groupBy("pivot", "kind").agg(F.min(F.struct((-F.col("dice")).alias("d"), "word", "hits")).alias("b"))
    k, g = (best.where(F.col("kind") == x).select("pivot", F.col("b.word").alias(x), F.col("b.hits").alias(f"{x}_hits")) for x in ("kata", "kango"))
    return k.join(g, "pivot").where(F.col("kata_hits") >= least_ratio * F.col("kango_hits"))


def verb_breadth(sides: DataFrame, tokens: str, side: str, least: int = 20) -> DataFrame:
    """(side, verb, n, nouns, breadth): how many different nouns a verb takes by を, of verbs with enough of them."""
    d = noun_verbs(sides, tokens, side).groupBy(side, "noun", "verb").agg(F.count(F.lit(1)).alias("n"))
    d = d.groupBy(side, "verb").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nouns")).where(F.col("n") >= least)
    return d.withColumn("breadth", F.col("nouns") / F.col("n"))


def noun_verbs(sides: DataFrame, tokens: str, side: str) -> DataFrame:
    """(side, noun, verb): noun, を and verb in a row."""
    tri = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("a"), F.get(tokens, i + 1).alias("b"), F.get(tokens, i + 2).alias("c"))), lambda x: (x["a"]["pos1"] == "名詞") & (x["b"]["surface"] == "を") & (x["c"]["pos1"] == "動詞"))
    return sides.select(side, F.explode(tri).alias("x")).select(side, F.col("x.a.surface").alias("noun"), F.col("x.c.lemma").alias("verb"))


def convergence(choices: DataFrame, item: str, choice: str) -> DataFrame:
    """(item, n, kinds, top_share): how far independent answers to one item agree."""
    c = choices.groupBy(item, choice).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(item).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), (F.max("c") / F.sum("c")).alias("top_share"))
