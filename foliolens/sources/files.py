"""Sources and sinks: Markdown trees, paired and domain-prefixed files, TOML settings, plans, reports and term lists."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V

_COMMENT = r"<!-- plan:doctype ([a-z]+) -->"


def documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, source) of every file under a folder whose name fits; read by executors, whole."""
    d = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def spread(df: DataFrame, times: int = 2) -> DataFrame:
    """df over twice as many partitions as there are cores, where a scan has fewer.

    A file of one row group is read by one task, however many cores wait. Large inputs have more splits than that
    and are not shuffled.
    """
    least = times * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def require_some(docs: DataFrame) -> DataFrame:
    if docs.isEmpty():
        raise ValueError("no documents found")
    return docs


def with_names(docs: DataFrame) -> DataFrame:
    """Adds name, kind (md, rst, texi, by the suffix), domain (before __), stem and variant (x.en.md: x, en)."""
    name = F.element_at(F.split("path", "/"), -1)
    d = docs.withColumn("name", name)
    base = F.regexp_replace("name", r"\.[^.]*$", "")
    kind = F.when(F.col("name").endswith(".texi"), "texi").when(F.col("name").rlike(r"\.(rst|txt)$"), "rst").otherwise("md")
    variant = F.regexp_extract(base, r"\.([^.]+)$", 1)
    return d.withColumns({"kind": kind, "domain": F.when(F.contains("name", F.lit("__")), F.split("name", "__")[0]), "variant": F.when(variant != "", variant), "stem": F.regexp_replace(base, r"\.[^.]+$", "")})


def settings(text: str) -> dict:
    """A TOML text; small, so it is read where the plan is made."""
    return tomllib.loads(text)


def profile_patch(spark: SparkSession, config: dict) -> tuple[DataFrame, tuple[str, ...]]:
    """A profile override: ([thresholds] as rows, with null for what is not given; disabled metrics)."""
    rows = [(m, *(t.get(k) for k in ("value", "direction", "severity", "guidance"))) for m, t in config.get("thresholds", {}).items()]
    rows = [(m, None if v is None else float(v), *rest) for m, v, *rest in rows]
    return spark.createDataFrame(rows, "metric string, threshold double, direction string, severity string, guidance string"), tuple(config.get("disable", ()))


def allowed_words(config: dict) -> tuple[str, ...]:
    """The words of an allow-list for rules of register: [[allow]] tables with a word, or a list of words."""
    return tuple(x["word"] if isinstance(x, dict) else x for x in config.get("allow", ()))


def term_rows(spark: SparkSession, config: dict) -> DataFrame:
    """(word, lang, count) of [[term]] tables, as write_terms() writes them."""
    return spark.createDataFrame([(t["word"], t.get("lang"), t.get("count")) for t in config.get("term", ())], "word string, lang string, count long")


def path_types(config: dict) -> dict[str, str]:
    """Types of documents by path prefix: the [paths] table of structure settings."""
    return dict(config.get("paths", {}))


def plans(spark: SparkSession, path: str, comment: str = _COMMENT) -> DataFrame:
    """(path, plot_doctype, plot): the type and the agreed headings of each plan, without marks of what is optional.

    comment: the pattern of the mark that names the type, in its first group.
    """
    d = documents(spark, path)
    heads = F.transform(F.regexp_extract_all("source", F.lit(r"(?m)^## (.*)$"), 1), lambda h: F.trim(F.regexp_replace(h, r"(（任意）|\(optional\))\s*$", "")))
    kind = F.regexp_extract("source", comment, 1)
    return d.select("path", F.when(kind != "", kind).alias("plot_doctype"), heads.alias("plot"))


def write_reports(reported: DataFrame, path: str) -> None:
    reported.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines of text in global order, in as many files as there are partitions."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def profile_toml(profile: DataFrame, name: str) -> str:
    """A calibrated profile as TOML: a dozen rows, in order of metric."""
    out = [f'name = "{name}"']
    for r in profile.orderBy("metric").collect():
        guidance = r.guidance.replace("\\", "\\\\").replace('"', '\\"')
        out += ["", f'[thresholds."{r.metric}"]', f"value = {r.threshold}", f'direction = "{r.direction}"', f'severity = "{r.severity}"', f'guidance = "{guidance}"']
    return "\n".join(out) + "\n"


def write_terms(terms: DataFrame, path: str) -> None:
    """Terms as TOML tables, the most frequent first; written by executors."""
    word = F.replace(F.replace(F.col("word"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    line = F.format_string('[[term]]\nword = "%s"\nlang = "%s"\ncount = %d\n', word, "lang", "count")
    terms.orderBy(F.desc("count"), "word").select(line.alias("value")).write.mode("overwrite").text(path)


def glossary_rows(spark: SparkSession) -> DataFrame:
    """(kind, preferred, avoid, keep): the built-in glossary, to be written as CSV."""
    rows = [("orthography", p, v, "") for p, v in V.ORTHOGRAPHY] + [("term", p, r, "|".join(keep)) for p, rejected, keep in V.TERMS for r in rejected]
    return spark.createDataFrame(rows, "kind string, preferred string, avoid string, keep string")


def glossary_yaml() -> str:
    """The glossary as rules of a proofreading tool: expected forms and patterns."""
    out = ["version: 1", "rules:"]
    for p, v in [*V.ORTHOGRAPHY, *((p, r) for p, rejected, _ in V.TERMS for r in rejected)]:
        out += [f"  - expected: {p}", f"    pattern: {v}"]
    return "\n".join(out) + "\n"
