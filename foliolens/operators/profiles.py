"""Threshold profiles in layers, and their calibration from a corpus.

Profiles are tables of a dozen rows, so overlays are joins of small tables; what they are
compared with is the large side and never moves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens import fixed_values as V
from foliolens.functions import text as T

SCHEMA = "metric string, threshold double, direction string, severity string, guidance string"


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of strings, doubles and booleans; by Arrow, so that no Python worker has to give them out again on executors."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names))


def builtin(spark: SparkSession, name: str = "oss") -> DataFrame:
    """(metric, threshold, direction, severity, guidance) of a built-in profile."""
    if name not in V.PROFILES:
        raise ValueError(f"unknown profile: {name}")
    return small_frame(spark, V.THRESHOLDS, SCHEMA)


def overlay(profile: DataFrame, patch: DataFrame, disable: tuple[str, ...] = (), may_add: bool = True) -> DataFrame:
    """A profile with a patch of the same columns on it; nulls in the patch leave a value as it is.

    Metrics that the profile lacks are added (with severity info and no guidance unless given; value
    and direction are needed) if may_add, else ignored. What is disabled goes last.
    """
    p = patch.select("metric", *(F.col(c).alias(f"_{c}") for c in ("threshold", "direction", "severity", "guidance")))
    d = profile.withColumn("_own", F.lit(True)).join(p, "metric", "full_outer")
    d = d.select(
        "metric", "_own", F.coalesce("_threshold", "threshold").alias("threshold"), F.coalesce("_direction", "direction").alias("direction"),
        F.coalesce("_severity", "severity", F.lit("info")).alias("severity"), F.coalesce("_guidance", "guidance", F.lit("")).alias("guidance"),
    )
    if may_add:
        whole = F.col("threshold").isNotNull() & F.col("direction").isNotNull()
        d = d.withColumn("threshold", F.when(whole, F.col("threshold")).otherwise(F.raise_error(F.concat(F.lit("a new metric needs value and direction: "), "metric")).cast("double")))
    else:
        d = d.where("_own")
    return d.where(~F.col("metric").isin(*disable)).drop("_own") if disable else d.drop("_own")


def doctype_patches(spark: SparkSession) -> DataFrame:
    """(doctype, metric, value, disabled) of the built-in document types."""
    return small_frame(spark, [(d, m, v, v is None) for d, m, v in V.DOCTYPE_THRESHOLDS], "doctype string, metric string, value double, disabled boolean")


def by_doctype(profile: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """(doctype, metric, threshold, ...): the profile for every document type, and '' for none declared.

    A patch of a type comes after the project's own values, so it overrides them.
    """
    spark = profile.sparkSession
    types = small_frame(spark, [("",), *((d,) for d in V.DOCTYPES)], "doctype string")
    patches = doctype_patches(spark) if patches is None else patches
    d = types.join(F.broadcast(profile), how="cross").join(F.broadcast(patches), ["doctype", "metric"], "left")  # a dozen rows by ten
    return d.where(~F.coalesce("disabled", F.lit(False))).select("doctype", "metric", F.coalesce("value", "threshold").alias("threshold"), "direction", "severity", "guidance")


def samples(metrics: DataFrame, *groups: str) -> DataFrame:
    """(groups, metric, values): all values of each metric, sorted."""
    return metrics.groupBy(*groups, "metric").agg(F.sort_array(F.collect_list("value")).alias("values"))


def tukey(values: DataFrame) -> DataFrame:
    """Adds n, q1, q3, low and high: hinges that leave the median out, and fences at 1.5 times their distance."""
    q1, q3 = T.hinges(F.col("values"))
    d = T.bound(values, n=F.size("values").cast("long"), q1=q1, q3=q3)
    return T.bound(d, low=F.col("q1") - V.FENCE * (F.col("q3") - F.col("q1")), high=F.col("q3") + V.FENCE * (F.col("q3") - F.col("q1")))


def ranked_tukey(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, n, q1, q3, low, high) of a column too large to gather: hinges are looked up by rank.

    Values are counted first, so one row per distinct value is ranked, and only a running sum
    over them is sorted. Nulls are left out.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*groups)
    d = counts.withColumns({"to": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})
    half = F.floor(F.col("n") / 2)
    mid = F.floor((half + 1) / 2)
    mid2 = F.floor(half / 2) + 1
    at = lambda rank: F.max(F.when((F.col("to") - F.col("c") < rank) & (F.col("to") >= rank), F.col("v")))
    d = d.groupBy(*groups).agg(F.max("n").alias("n"), ((at(mid) + at(mid2)) / 2).alias("q1"), ((at(F.col("n") - half + mid) + at(F.col("n") - half + mid2)) / 2).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return d.withColumns({"low": F.col("q1") - V.FENCE * spread, "high": F.col("q3") + V.FENCE * spread})


def ranked_quantiles(df: DataFrame, value: str, at: dict[str, float], *groups: str) -> DataFrame:
    """(groups, n, a column for each name of at): quantiles by the exclusive method, looked up by rank; groups of two values or more."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*groups)
    d = counts.withColumns({"to": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)}).where("n > 1")
    held = lambda rank: F.max(F.when((F.col("to") - F.col("c") < rank) & (F.col("to") >= rank), F.col("v")))
    low = {name: F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * F.lit(p)), F.col("n") - 1)) for name, p in at.items()}
    d = d.groupBy(*groups).agg(F.max("n").alias("n"), *(held(r).alias(f"_a_{k}") for k, r in low.items()), *(held(r + 1).alias(f"_b_{k}") for k, r in low.items()))
    part = lambda k: (F.col("n") + 1) * F.lit(at[k]) - low[k]
    return d.select(*groups, "n", *((F.col(f"_a_{k}") * (1 - part(k)) + F.col(f"_b_{k}") * part(k)).alias(k) for k in at))


def calibrate(metrics: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, rejected): thresholds at the fences of a corpus, and metrics that give none, with the reason."""
    d = ranked_tukey(metrics.join(F.broadcast(profile.select("metric")), "metric"), "value", "metric").join(F.broadcast(profile), "metric")
    fence = F.when(F.col("direction") == "above", F.col("high")).otherwise(F.col("low"))
    reason = F.when(F.col("n") < V.MIN_SAMPLES, "too few").when((F.col("direction") == "below") & (fence <= 0), "unreachable")
    d = d.withColumns({"fence": fence, "reason": reason})
    return d.where("reason is null").select("metric", F.col("fence").alias("threshold"), "direction", "severity", "guidance"), d.where("reason is not null").select("metric", "reason", "n", F.col("fence").alias("threshold"))
