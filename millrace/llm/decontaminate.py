"""Benchmark decontamination by winnowing. DataFrame operations only.

A text's fingerprints are the smallest hash of ``k`` consecutive words in each window of ``span - k + 1`` such hashes, which is
a window of ``span`` words. Equal windows have equal fingerprints, so every shared span of ``span`` words or more is found. A
fingerprint of a document that the benchmark has too is a hit; it is extended to the windows that it can stand for, and these
count where the benchmark has exactly their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

#: Benchmark windows up to which their tables are broadcast (about 200 bytes each); beyond it the joins shuffle.
BROADCAST_WINDOWS = 200_000
_SEP = " "


def _fingerprint(hashes: str, at: Column, width: int) -> Column:
    return F.least(*(F.get(hashes, at + j) for j in range(width))) if width > 1 else F.get(hashes, at)


def _with_hashes(df: DataFrame, k: int) -> DataFrame:
    """Adds ``h``, the hash of each ``k`` consecutive words of ``w``."""
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(k))))
    return df.withColumn("h", F.when(F.size("w") >= k, grams).otherwise(F.array().cast("array<bigint>")))


def benchmark_windows(bench: DataFrame, span: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of the items: ``len, window, items``; an item of fewer words than ``span`` is one window."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - span, F.lit(0)))
    return (
        items.select("item", "w", F.explode(starts).alias("i"))
        .select("item", F.least(F.size("w"), F.lit(span)).alias("len"), F.array_join(F.slice("w", F.col("i") + 1, span), _SEP).alias("window"))
        .groupBy("len", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def hits(docs: DataFrame, windows: DataFrame, span: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, start, len, items``: a row for each occurrence of a window, and one with a null start per document."""
    width = span - k + 1
    short = sorted(r[0] for r in windows.filter(F.col("len") < span).select("len").distinct().collect())  # span - 1 at most
    small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    held = F.broadcast if small else (lambda df: df)

    split = windows.withColumn("w", F.split("window", _SEP))
    full = _with_hashes(split.filter(F.col("len") == span), k).select("len", _fingerprint("h", F.lit(0), width).alias("f"))
    prints = reduce(
        DataFrame.unionByName,
        (split.filter(F.col("len") == n).select("len", F.xxhash64(*(F.get("w", F.lit(j)) for j in range(n))).alias("f")) for n in short),
        full,
    ).distinct()

    base = _with_hashes(docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")), k)
    # Position -1 stands for the document itself, so that one pass returns documents without hits too.
    at = base.select("doc_id", "w", "h", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - (min(short) if short else span), F.lit(-1)))).alias("i"))
    i, none = F.col("i"), F.lit(None).cast("bigint")
    here, before = _fingerprint("h", i, width), _fingerprint("h", i - 1, width)
    # least() skips nulls; a window that would reach past the last word has no fingerprint. A run of windows with one
    # fingerprint is one selection, cut every `width` words as a repeated phrase can make it longer.
    chosen = F.when((i >= 0) & (i <= F.size("h") - width) & ((i % width == 0) | (here != before)), here)
    kinds = [F.struct(F.lit(span).alias("len"), chosen.alias("f"))]
    kinds += [F.struct(F.lit(n).alias("len"), F.when((i >= 0) & (i <= F.size("w") - n), F.xxhash64(*(F.get("w", i + j) for j in range(n)))).alias("f")) for n in short]
    if len(kinds) == 1:
        at = at.select("doc_id", "w", "i", F.lit(span).alias("len"), F.coalesce(chosen, none).alias("f"))
    else:
        at = at.select("doc_id", "w", "i", F.explode(F.array(*kinds)).alias("p")).select("doc_id", "w", "i", "p.len", "p.f")
    at = at.filter(F.col("f").isNotNull() | ((F.col("i") == -1) & (F.col("len") == span)))
    n_words = F.size("w").alias("n_words")
    if small:
        found = at.join(held(prints.withColumn("hit", F.lit(True))), ["len", "f"], "left").filter("hit or i = -1")
        found = found.select("doc_id", n_words, "i", "len", F.when(F.col("i") >= 0, F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, span + width - 1)).alias("near"))
    else:
        # Only numbers are shuffled to find the hits; the words of their documents are fetched after.
        found = at.filter("i >= 0").select("doc_id", "i", "len", "f").join(prints, ["len", "f"], "left_semi").select(F.col("doc_id").alias("_id"), "i", "len")
        found = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
            "doc_id", n_words, F.coalesce("i", F.lit(-1)).alias("i"), F.coalesce("len", F.lit(span)).alias("len"),
            F.when(F.col("i") >= 0, F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, span + width - 1)).alias("near"),
        )
    # Extend: a selection stands for the windows that begin at it and up to width - 1 words later.
    begins = F.when(F.col("i") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(F.col("len") == span, F.lit(width - 1)).otherwise(F.lit(0))))
    spread = found.select("doc_id", "n_words", "i", "len", "near", F.explode(begins).alias("d")).select(
        "doc_id", "n_words", F.when(F.col("i") >= 0, F.col("i") + F.col("d")).alias("start"), "len",
        F.when(F.col("i") >= 0, F.array_join(F.slice("near", F.col("d") + 1, F.col("len")), _SEP)).alias("window"),
    )
    return spread.join(held(windows), ["len", "window"], "left").filter("start is null or items is not null").select("doc_id", "n_words", "start", "len", "items")


def contamination(
    docs: DataFrame, bench: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if any occurrence of a benchmark window covers it. Null or empty texts have no words and no hits, on either
    side; an empty benchmark hits nothing; an empty ``docs`` gives an empty table. Rows that repeat a doc_id are one document
    whose hits are united and which has the words of its longest row. Other columns are not looked at.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be from 1 to span")
    found = hits(docs, benchmark_windows(bench, span, item_id_col, item_text_col), span, k, id_col, text_col)
    # One row per place, then per document: the largest group is the places of one document.
    place = found.groupBy("doc_id", "start").agg(F.max("n_words").alias("n_words"), F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    ends = F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")))
    per = place.groupBy("doc_id").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_list(ends)).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    covered = F.aggregate(
        "ends",
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["e"].cast("bigint") - F.greatest(a["upto"], x["s"].cast("bigint")), F.lit(0).cast("bigint"))).alias("n"),
            F.greatest(a["upto"], x["e"].cast("bigint")).alias("upto"),
        ),
        lambda a: a["n"],
    )
    return per.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a contaminated text, all columns as they are, whatever these are called.

    Null and empty texts stay, on an empty benchmark all rows; of an id with several rows all go if one is contaminated, a null id
    counting as one id. An empty table gives an empty table.
    """
    (bad,) = fresh(docs, "bad")
    gone = contamination(docs, bench, span, k, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias(bad))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")
