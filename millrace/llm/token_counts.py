"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch is a table of signed counts. It is folded to one row per group and written as one folder, named by the batch; the folder's
commit mark makes it count. A batch that is committed already is left alone, one that was cut off is written again, so repeating any
batch any number of times changes nothing. Totals are the sum of the committed batches; ``compact`` folds them into one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this family splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, read once in each process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, n_tokens, n_chars`` of each row's whole text; a null text has none of either.

    Null sources and languages stay null. Repeated rows are counted each; an empty table gives an empty table; other columns are not
    looked at. The vocabulary is a file that every executor can read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for df in frames:
            df["n_tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in df["text"]]
            yield df[["doc_id", "source", "lang", "n_tokens", "n_chars"]]

    rows = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", F.col(text_col).alias("text"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("bigint").alias("n_chars"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, lang string, n_tokens bigint, n_chars bigint")


def signed(counts: DataFrame, tokenizer: str, sign: int = 1, tokens: str | Column = "n_tokens") -> DataFrame:
    """Deltas that insert (1) or delete (-1) counted documents, a row each. Null counts are 0; null sources and languages are groups."""
    value = F.col(tokens) if isinstance(tokens, str) else tokens
    zero = F.lit(0)
    return counts.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("n_docs"),
        (sign * F.coalesce(value, zero)).cast("bigint").alias("n_tokens"), (sign * F.coalesce("n_chars", zero)).cast("bigint").alias("n_chars"),
    )


def revised(old: DataFrame, new: DataFrame, tokenizer: str) -> DataFrame:
    """Deltas that replace the counts ``old`` by ``new`` of the same documents."""
    return signed(old, tokenizer, -1).unionByName(signed(new, tokenizer, 1))


class TokenRollup:
    """Totals in a folder that all of the cluster sees."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):  # noqa: ANN202
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _folders(self) -> list[str]:
        fs = self._fs()
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in names if re.match(r"(batch|base)=", n) and fs.exists(self._at(f"{n}/_SUCCESS")))

    def _base(self, folders: list[str]) -> tuple[str | None, set[str]]:
        """The newest compaction of ``folders`` and the batches it holds."""
        last = max((n for n in folders if n.startswith("base=")), key=lambda n: int(n.split("=")[1]), default=None)
        return last, {r[0] for r in self.spark.read.parquet(f"{self.path}/{last.replace('base=', 'held=')}").collect()} if last else set()

    def _batches(self, folders: list[str]) -> set[str]:
        return {n.split("=", 1)[1] for n in folders if n.startswith("batch=")} | self._base(folders)[1]

    def committed(self) -> set[str]:
        return self._batches(self._folders())

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch once; False if it was there."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch is named by letters, digits, dots, dashes and underscores")
        if batch in self.committed():
            return False
        folded = deltas.groupBy(*GROUP).agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))
        folded.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self, drop_empty: bool = True) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_chars``; groups that came back to nothing are left out."""
        return self._totals(self._folders(), drop_empty)

    def _totals(self, folders: list[str], drop_empty: bool) -> DataFrame:
        base, held = self._base(folders)
        paths = [f"{self.path}/{n}" for n in folders if n.startswith("batch=") and n.split("=", 1)[1] not in held]
        paths += [f"{self.path}/{base}"] if base else []
        read = [self.spark.read.schema(_SCHEMA).parquet(p) for p in paths] or [self.spark.createDataFrame([], _SCHEMA)]
        total = reduce(DataFrame.unionByName, read).groupBy(*GROUP).agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))
        return total.filter("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0") if drop_empty else total

    def compact(self) -> None:
        """Folds the batches committed by now into one table; the list of what it holds is written before it counts.

        Folders are listed once, so a batch committed meanwhile is in neither the table nor its list and counts as before. What the
        compaction before this one holds is deleted, and older compactions; the batches folded now stay until the next time, for
        readers that have listed them. One compaction runs at a time.
        """
        folders = self._folders()
        base, held = self._base(folders)
        n = int(base.split("=")[1]) + 1 if base else 1
        rows = self.spark.createDataFrame([(x,) for x in sorted(self._batches(folders))], "batch string")
        rows.write.mode("overwrite").parquet(f"{self.path}/held={n}")
        self._totals(folders, drop_empty=False).write.mode("overwrite").parquet(f"{self.path}/base={n}")
        fs = self._fs()
        for x in folders:
            kind, name = x.split("=", 1)
            if kind == "batch" and name in held or kind == "base" and x != base:
                fs.delete(self._at(x), True)
                if kind == "base":
                    fs.delete(self._at(f"held={name}"), True)
