"""Quality rules: a learned decision list, run as Spark conditional expressions.

Everything that touches documents is a built-in Spark function: a narrow projection,
without a shuffle. The list is learned by sequential covering (grow by FOIL's gain,
prune by precision on rows held back) from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import hash_sample, table, words
from foliolens.sources.files import spread

#: About so many labelled rows at most are learned from, chosen by a hash of their id.
SAMPLE = 4000
SYMBOLS = "#*$%&|<>"
FEATURES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "bang_rate": "n_bangs / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}


def _count_of(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts and rates to docs. A null text has no words, and zero everywhere.

    n_repeat_words compares 64-bit hashes of three-word windows. Only texts in which two
    windows share a hash are sorted.
    """
    docs = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t")))
    n = F.size("_w")
    symbols = sum((_count_of(F.col("_t"), x) for x in SYMBOLS[1:]), _count_of(F.col("_t"), SYMBOLS[0]))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    )
    docs = docs.withColumns({"_h": window, "_l": lines, "_j": F.array_join("_w", "")})
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    # The outer transform binds the sorted array once; a lambda would evaluate it for each element.
    twice = F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)))[0]
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    repeated = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), 0).otherwise(covered)
    # A filter above would be pushed below the projections, with their expressions put inside its
    # lambdas; an expression that is not deterministic keeps it where it stands.
    here = F.greatest(n, F.least(F.spark_partition_id(), F.lit(0)))
    return docs.withColumns({
        "n_words": here.cast("long"), "word_chars": F.length("_j").cast("long"), "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_repeat_words": repeated.cast("long"), "n_lines": F.size("_l").cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long"), "n_upper": (F.length("_j") - F.length(F.regexp_replace("_j", r"\p{Lu}+", ""))).cast("long"),
        "n_bangs": _count_of(F.col("_t"), "!").cast("long"),
    }).drop("_t", "_w", "_h", "_l", "_j")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions: (feature, '>=' or '<=', threshold)."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    wrong: int

    def sql(self) -> str:
        return " and ".join(f"{FEATURES[f]} {op} {v!r}D" for f, op, v in self.conditions)

    def fits(self, row: dict) -> bool:
        return all(row[f] >= v if op == ">=" else row[f] <= v for f, op, v in self.conditions)


def _cuts(rows: list[dict], feature: str, most: int = 40) -> list[float]:
    values = sorted({r[feature] for r in rows})
    if len(values) > most:
        values = [values[len(values) * k // most] for k in range(most)] + values[-1:]
    return sorted({(a + b) / 2 for a, b in zip(values, values[1:])})


def _grow(bad: list[dict], good: list[dict]) -> list[tuple[str, str, float]]:
    found: list[tuple[str, str, float]] = []
    while good and len(found) < 4:
        p0, n0 = len(bad), len(good)
        best = (1e-9, None, None, None)
        for f in FEATURES:
            for v in _cuts(bad + good, f):
                for op in (">=", "<="):
                    keep = (lambda r, f=f, v=v: r[f] >= v) if op == ">=" else (lambda r, f=f, v=v: r[f] <= v)
                    p = sum(map(keep, bad))
                    if not p:
                        continue
                    n = sum(map(keep, good))
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > best[0]:
                        best = (gain, (f, op, v), keep, n)
        if best[1] is None:
            break
        found.append(best[1])
        bad, good = [r for r in bad if best[2](r)], [r for r in good if best[2](r)]
    return found


def learn(rows: list[dict], precision: float = 0.9, least: int = 4) -> list[Rule]:
    """The decision list: rows have the features, good (bool) and held (bool, kept for pruning)."""
    grow, prune = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
    found: list[Rule] = []
    while len(found) < 20:
        bad = [r for r in grow if not r["good"]]
        conditions = _grow(bad, [r for r in grow if r["good"]]) if len(bad) >= least else []
        best = None
        for k in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:k]), 0, 0)
            p = sum(rule.fits(r) for r in prune if not r["good"])
            n = sum(rule.fits(r) for r in prune if r["good"])
            if p + n and (best is None or p / (p + n) > best[0]):
                best = (p / (p + n), rule, p, n)
        if best is None or best[0] < precision or best[2] < least // 2:
            break
        rule = Rule(best[1].conditions, best[2], best[3])
        found.append(rule)
        grow, prune = [r for r in grow if not rule.fits(r)], [r for r in prune if not rule.fits(r)]
    return found


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, remainder: Column | None = None) -> DataFrame:
    """A bounded sample: docs' id and text, with good. An id that is labelled both ways counts as not good."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    if remainder is not None:
        known = known.where(remainder)
    return docs.select("doc_id", "text").join(F.broadcast(hash_sample(known, limit, "doc_id")), "doc_id")


def learn_rules(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[Rule]:
    sample = measured(labelled(docs, labels, limit)).where(~base_failed()).select("doc_id", "good", *(F.expr(x).cast("double").alias(f) for f, x in FEATURES.items()), (F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(3)) == 0).alias("held"))
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(2 * limit).collect()
    return learn([r.asDict() for r in rows])


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a measured row, from 1 on; 0 if none does."""
    chain = None
    for k, rule in enumerate(rules, 1):
        chain = F.when(F.expr(rule.sql()), k) if chain is None else chain.when(F.expr(rule.sql()), k)
    return F.lit(0) if chain is None else chain.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with counts, base_failed, rule and kept. Names of docs' own columns are kept, but for these.

    Null and empty texts fail the base rule. Repeated rows are judged alike. With no
    labels the list is empty, and the base rule alone decides.
    """
    out = measured(docs).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judge(spread(docs.select("doc_id", "text")), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


BASE_SQL = r"""
with w as (select doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
h as (select doc_id, ws, ls, text, unnest(range(0, len(ws) - 2)) as i from w where len(ws) > 2),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) as c from h),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where c > 1) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
  len(ws) < 50 or 100 * coalesce(r.n, 0) > 50 * len(ws) as base_failed
from w left join r using (doc_id)
"""
