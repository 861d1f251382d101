"""A corpus pipeline of five stages, each by one of the operators of foliolens.llm.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
run() writes each stage's rows as Parquet in the shared folder and reads them again as the
next one's docs. All stages but the last return the columns of their docs, of any name and type.
Each row is judged by its text: rows that share or lack a doc_id, and repeated rows, are treated like
any other. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import classifier, decontamination, near_copies, pieces, quality_rules
from foliolens.llm.common import discard, own_columns, small_batches, stored, table


def _whole(docs: DataFrame) -> DataFrame:
    """docs as (row, text): what a stage adds can then clash with no column of docs, whatever its name."""
    return docs.select(F.struct(*(c.alias(n) for c, n in zip(own_columns(docs), docs.columns, strict=True))).alias("row"), "text")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep; null and empty texts go."""
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(_whole(docs), rules).where("kept").select("row.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more.

    The network learns from the labelled rows of the whole documents table: the stage before has
    already dropped most of the bad ones from docs.
    """
    small_batches(spark)
    model = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return classifier.scored(_whole(docs), model).where(F.col("score") >= classifier.THRESHOLD).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    SimHash links what it reaches; near_copies finds the rest and verifies all links on the whole texts.
    """
    small_batches(spark)
    return near_copies.survivors(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    small_batches(spark)
    return decontamination.matches(_whole(docs), table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids): the token ids of every document."""
    small_batches(spark)
    out = pieces.encoded(docs.select("doc_id", "text"), pieces.Pieces.load(pieces.MODEL))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
#: Learned rules, a network and edit distances cannot be expressed in SQL; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
