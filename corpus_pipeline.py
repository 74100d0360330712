"""Documents to training sequences: five stages, each of which works on all that the one before kept.

All stages take a table with any further columns, whatever these are called, and an empty one; null texts count as empty texts, and
all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from millrace.llm.common import exists, scratch, table
from millrace.llm.queries import learned_lexicon


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The lexicon learns from the labelled documents of the input folder; without labels of both
    kinds it is empty and all stay. Rows that repeat are judged each.
    """
    return toxicity.drop_toxic(docs, learned_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, null ids last; of rows that repeat an id and a text, one."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays. Empty texts and rows with a null id are linked with nothing."""
    return near_dedup.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; rows that repeat an id go together. Without items all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; an empty text is its end mark."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The lexicon's fit and best-fit packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written to the shared folder and read again.

    ``at`` names the folder of the results. Stages that have ended there are not run again, so a run that was stopped goes on
    where it was; without it a new folder is taken.
    """
    docs = table(spark, sf_dir, "documents")
    at = at or scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
