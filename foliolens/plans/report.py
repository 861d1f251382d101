"""check(): metrics against thresholds and all rules, and reports of a document's findings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T
from foliolens.operators import metrics, parse, profiles, rules, structure

_RANK = {"error": 3, "warning": 2, "info": 1}


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 3).when(c == "warning", 2).when(c == "info", 1)


def check(docs: DataFrame, key: str, source: str = "source", lang: str = "en", profile: DataFrame | None = None, tokenize=None, reference: DataFrame | None = None, allow: tuple[str, ...] = (), silenced: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(document metrics out of range, findings) for docs of one language with a key, a source and, if declared, a doctype.

    Both come from one pass over the texts: what a document gives is one array, shuffled by key, and that shuffle is read for both.
    Japanese needs tokenize (see functions.morphology) and fails without it.
    """
    if "doctype" not in docs.columns:
        docs = structure.resolve_doctype(docs, source)
    parsed = parse.parse(docs.select(key, source, "doctype"), source)
    if lang == "ja":
        if tokenize is None:
            raise ValueError("Japanese needs a tokenizer")
        parsed = tokenize(parsed)
    profile = profiles.builtin(docs.sparkSession) if profile is None else profile
    table = profiles.by_doctype(profile).withColumnRenamed("doctype", "_type")
    tokens = None if lang == "en" else "block_tokens"
    d = T.bound(parsed, _type=F.coalesce("doctype", F.lit("")))
    d, found = rules.maintainability(metrics.with_metrics(d, lang), lang, tokens)
    if lang == "ja":
        d = T.bound(d, katakana=rules.prefer_katakana(tokens, allow), variant=rules.glossary_variant(allow=allow))
        found = [*found, (V.PREFER_KATAKANA, "katakana"), (V.VARIANT, "variant")]
        if reference is not None:
            d = rules.rare_wago(d, tokens, reference, allow=allow)
            found = [*found[:7], (V.RARE_WAGO, "rare_wago"), *found[7:]]
    d, more = structure.structure(d, lang)
    local = rules.found_of([r for r in found + more if r[0][0] not in silenced])
    d = T.bound(d, _local=local, _measured=F.transform("measured", lambda m: F.struct(m["metric"].alias("metric"), m["value"].alias("value"), F.col("_type").alias("_type"))))
    kinds = dict(d.dtypes)
    entry = f"struct<m:{kinds['_measured'][6:-1]},f:{kinds['_local'][6:-1]}>"
    said = F.concat(F.transform("_measured", lambda m: F.struct(m.alias("m"), F.lit(None).alias("f")).cast(entry)), F.transform("_local", lambda f: F.struct(F.lit(None).alias("m"), f.alias("f")).cast(entry)))
    d = d.select(key, said.alias("_said")).repartition(F.col(key))  # both sides need both columns, or there would be two shuffles
    of = lambda part: F.transform(F.filter("_said", lambda x: x[part].isNotNull()), lambda x: x[part])
    out = metrics.out_of_range(d.select(key, F.lit(lang).alias("lang"), F.inline(of("m"))), table, "_type").drop("_type")
    return out, d.select(key, F.inline(of("f")))


def reports(docs: DataFrame, out: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, document, local): one row for each document, with its metrics in order of name and its findings in order of rule."""
    m = out.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("metric", "value", "threshold", "direction", "severity", "guidance"))).alias("document"))
    f = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rule_ord", "rule_id", "severity", "message", "positions", "truncated"))).alias("local"))
    d = docs.select(key).join(m, key, "left").join(f, key, "left")
    kinds = dict(d.dtypes)
    return d.select(key, *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("document", "local")))


def markdown(document: str = "document", local: str = "local") -> Column:
    """A report as Markdown: what to do about the whole, then places to mend by rule."""
    guidance = F.concat(F.lit(f"{V.REPORT_GUIDANCE}\n\n"), F.array_join(F.transform(document, lambda m: F.concat(F.lit("- "), m["guidance"], F.lit("\n"))), ""), F.lit("\n"))

    def place(p):
        column = F.when(p["column"] > 1, F.concat(F.lit(":"), p["column"].cast("string"))).otherwise("")
        return F.concat(F.lit("- L"), p["line"].cast("string"), column, F.lit(" "), p["text"], F.lit("\n"))

    def rule(f):
        n = (F.size(f["positions"]) + f["truncated"]).cast("string")
        more = F.when(f["truncated"] > 0, F.concat(F.lit("- ほか"), f["truncated"].cast("string"), F.lit("件\n"))).otherwise("")
        return F.concat(F.lit("### "), f["message"], F.lit(" — "), f["rule_id"], F.lit("（"), n, F.lit("件）\n\n"), F.array_join(F.transform(f["positions"], place), ""), more, F.lit("\n"))

    findings = F.concat(F.lit(f"{V.REPORT_FINDINGS}\n\n"), F.array_join(F.transform(local, rule), ""))
    return F.concat(F.when(F.size(document) > 0, guidance).otherwise(""), F.when(F.size(local) > 0, findings).otherwise(""))


def text_lines(found: DataFrame, path: str, out: DataFrame | None = None) -> DataFrame:
    """path: metric guidance for each metric out of range (rule_ord -1), then path:line:column: message [rule] for each position."""
    p = rules.positions(found, path)
    at = F.col(path).cast("string")
    lines = p.select(path, "rule_ord", "n", F.concat(at, F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(": "), "message", F.lit(" ["), "rule_id", F.lit("]")).alias("value"))
    if out is None:
        return lines
    names = sorted(r[0] for r in V.THRESHOLDS)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("metric")), F.lit(0)).cast("int")
    return out.select(path, F.lit(-1).alias("rule_ord"), order.alias("n"), F.concat(at, F.lit(": "), "metric", F.lit(" "), "guidance").alias("value")).unionByName(lines)


def check_any(docs: DataFrame, key: str, source: str = "source", lang: str = "auto", **more) -> tuple[DataFrame, DataFrame]:
    """check() for documents of both languages: auto looks at each document, ja and en hold for all."""
    if lang not in ("auto", "ja", "en"):
        raise ValueError(f"unknown language: {lang}")
    if lang != "auto":
        return check(docs, key, source, lang, **more)
    found = T.detect_lang(F.coalesce(F.col(source), F.lit("")))
    en = check(docs.where(found == "en"), key, source, "en", **{k: v for k, v in more.items() if k in ("profile", "silenced")})
    ja = check(docs.where(found == "ja"), key, source, "ja", **more)
    return tuple(a.unionByName(b) for a, b in zip(en, ja, strict=True))


def worst(document: str = "document", local: str = "local") -> Column:
    """error, warning, info, or null if there is nothing to say."""
    rank = F.array_max(F.concat(F.transform(document, lambda m: severity_rank(m["severity"])), F.transform(local, lambda f: severity_rank(f["severity"]))))
    return F.when(rank == 3, "error").when(rank == 2, "warning").when(rank == 1, "info")


def exit_status(reported: DataFrame) -> Column:
    """1 if any report has an error, else 0: an aggregate over reports."""
    return F.max(F.when(worst() == "error", 1).otherwise(0))


def _estimate(report: dict) -> int:
    n = 0
    if report["document"]:
        n += len(V.REPORT_GUIDANCE) + 3 + sum(len(m["guidance"]) + 3 for m in report["document"])
    if report["local"]:
        n += len(V.REPORT_FINDINGS) + 2
        for f in report["local"]:
            n += len(f"### {f['message']} — {f['rule_id']}（{len(f['positions']) + f['truncated']}件）\n\n") + 1
            n += sum(len(f"- L{p['line']}{':' + str(p['column']) if p['column'] > 1 else ''} {p['text']}\n") for p in f["positions"])
            n += len(f"- ほか{f['truncated']}件\n") if f["truncated"] else 0
    return n // V.CHARS_PER_TOKEN


def trimmed(report: dict, budget: int) -> dict:
    """A report within a budget of tokens, if it can be: what is least severe goes first, rules keep their counts."""
    for level in ("info", "warning", "error"):
        if _estimate(report) <= budget:
            break
        report["document"] = [m for m in report["document"] if m["severity"] != level]
        while _estimate(report) > budget:
            held = [f for f in report["local"] if f["severity"] == level and f["positions"]]
            if not held:
                break
            f = max(reversed(held), key=lambda x: len(x["positions"]))  # of equals the last
            f["positions"].pop()
            f["truncated"] += 1
    return report


def trim_reports(reported: DataFrame, budget: int) -> DataFrame:
    """Reports cut to a budget; sequential within a document, so an Arrow-batched function over their JSON."""
    kinds = dict(reported.dtypes)

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: json.dumps(trimmed(json.loads(x), budget), ensure_ascii=False))

    schema = f"document {kinds['document']}, local {kinds['local']}"
    out = F.from_json(cut(F.to_json(F.struct("document", "local"))), schema)
    return reported.withColumn("_r", out).select(*(c for c in reported.columns if c not in ("document", "local")), "_r.document", "_r.local")
