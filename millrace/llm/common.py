"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these are words for decontamination: digits, lower-case letters and all that is not ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` is right (and much faster) where every character takes one byte; other texts go through ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master (tests, one machine); on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return at or tempfile.gettempdir() + "/millrace-shared"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: written once to the shared folder, from where any executor can read it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Cuts the lineage by a table written to the shared folder; for loops. Returns it and its path, for ``remove``.

    A checkpoint keeps the size that the optimizer estimated. A join's estimate is a product, so where each round joins the last
    one's result with itself, the number has twice the digits each round, and planning takes the driver's time and memory. A table
    that is read again has its true size.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that is needed no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` is called so, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread: str, most: int = 200_000, salts: int = 16) -> DataFrame:
    """Joins on ``keys`` a table that may have hot keys with one of few columns that has each key once.

    ``right`` is counted, and broadcast up to ``most`` rows. Beyond that both sides shuffle; a hot key's rows are then dealt over
    ``salts`` groups by the column ``spread`` of ``left``, and each row of ``right`` is in all of them.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), list(keys), how)
    (salt,) = fresh(left, "salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
