"""Exact deduplication by skew-safe combining. DataFrame operations only.

Equal texts have equal digests, so a text whose digest no other row has is no copy: digests are counted first, folded by each task
and then by id, and only rows whose digest occurs twice go on. Of these (1) each task folds the equal texts it has read (the partial
aggregate), (2) the folded rows of a text meet in one of ``salts`` groups, chosen by the row's id, so a text that a third of all rows
repeat is merged in many tasks, (3) the at most ``salts`` winners of a text meet once more. Every stage groups by the digest and by
the full normalised text. After that a text is known by SHA-256, a second hash and its length, and moves no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, meet

_KEY = ("sha", "check", "bytes")


def _normal(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _digests(norm: str) -> tuple[Column, ...]:
    return F.unhex(F.sha2(norm, 256)), F.xxhash64(norm), F.octet_length(norm)


def _copied(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """The texts of several rows: their digests, ``keep_id``, ``group_size`` and whether rows may ``repeat`` an id too."""
    rows = docs.select(F.col(id_col).alias("id"), _normal(text_col).alias("norm"))
    rows = rows.select("id", "norm", *(c.alias(k) for k, c in zip(_KEY, _digests("norm"), strict=True)))
    by_id = rows.groupBy(*_KEY, "id").agg(F.count("*").alias("n"))
    several = by_id.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > 1")
    several = cut(several.select(*_KEY, (F.col("most") > 1).alias("repeat")))
    some = meet(rows, several.select(*_KEY), _KEY, "left_semi", "id", salts=salts)
    salted = some.groupBy(*_KEY, "norm", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.groupBy(*_KEY, "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return cut(winners.select(*_KEY, "keep_id", "group_size").join(several, list(_KEY)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row with the row that stays of its group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; ids that
    are null lose to all others, and a group of null ids only has a null ``keep_id``. Rows that repeat an id and a text are
    all returned and all count in ``group_size``. An empty table gives an empty table; other columns are not looked at.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _normal(text_col).alias("norm"))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in zip(_KEY, _digests("norm"), strict=True)))
    known = meet(rows, _copied(docs, id_col, text_col, salts), _KEY, "left", "doc_id", salts=salts)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return known.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay by ``exact_groups``, with all their columns, whatever these are called.

    Of rows that repeat an id and a text, one stays; so does one row of a group of null ids only. Null texts are empty and copies of
    each other. An empty table gives an empty table.
    """
    groups = _copied(docs, id_col, text_col, salts)
    names = fresh(docs, "norm", *_KEY, "keep_id", "repeat")
    norm, key, (keep_id, repeat) = names[0], names[1:4], names[4:]
    groups = groups.select(*(F.col(a).alias(b) for a, b in zip((*_KEY, "keep_id", "repeat"), names[1:], strict=True)))
    rows = docs.withColumn(norm, _normal(text_col)).withColumns(dict(zip(key, _digests(norm), strict=True))).drop(norm)
    stays = meet(rows, groups, key, "left", id_col, salts=salts).filter(F.col(repeat).isNull() | F.col(id_col).eqNullSafe(F.col(keep_id)))
    if groups.filter(F.col(repeat)).limit(1).count():
        again = F.coalesce(F.col(repeat), F.lit(False))
        stays = stays.filter(~again).unionByName(stays.filter(again).dropDuplicates([id_col, *key]))
    return stays.drop(*key, keep_id, repeat)
