"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs to the letters that they look like, and turns digits and signs inside words into letters. The
lexicon's entries are words or beginnings of words with weights learned from labels; a match inside an exception phrase does not
count. Exception phrases are pairs and triples of words around a match, learned from the same labels. The sum of the weights,
normalised by length, is calibrated to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .shingles import MinHash, shingle_sets

#: Letters of other scripts and signs that are drawn like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ʟ": "l", "ѵ": "v", "ԛ": "q", "ԝ": "w",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_SPLIT = re.compile(r"[^\w@$!|€]+|_")
_MIXED = re.compile(r"(?=[^\W\d_]*[\d@$!|€])(?=[\d@$!|€]*[^\W\d_])[\w@$!|€]+")
_EDGE = "@$!|€"


def _letter_table() -> dict[int, str]:
    """Full-width and mathematical letters by their compatibility form, and the fixed homoglyphs. Accents stay: they tell words apart."""
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    for lo, hi in ((0xFF21, 0xFF5A), (0x1D400, 0x1D7FF)):
        for c in range(lo, hi + 1):
            x = unicodedata.normalize("NFKC", chr(c)).lower()
            if x != chr(c) and len(x) == 1:
                table[c] = HOMOGLYPHS.get(x, x)
    table |= {c: "" for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}  # invisible
    return table


_LETTERS = _letter_table()
_SUBST = str.maketrans(SUBSTITUTES)


def folded_words(text: str) -> list[str]:
    """The words of a text after folding. Digits and signs become letters only in words that have a letter."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    text = _MIXED.sub(lambda m: m.group().rstrip(_EDGE).translate(_SUBST), text)
    return [w for w in re.split(r"[\W_]+", text) if w]


@dataclass
class Lexicon:
    """Entries (``word`` or ``beginning*``) with weights, phrases that are no matches, and the calibration to a probability."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = -2.0
    _auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_auto"} | {"_auto": None}

    def _automaton(self):  # noqa: ANN202
        if self._auto is None:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                key = f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "
                a.add_word(key, (len(key), w, 0))
            for phrase in self.exceptions:  # one that is an entry too takes its place: the entry never counts
                key = f" {' '.join(folded_words(phrase))} "
                if key.strip():
                    a.add_word(key, (len(key), 0.0, 1))
            a.make_automaton()
            self._auto = a
        return self._auto

    def matches(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Start, end and weight of the matches in ``' '.join(words)`` between blanks, without those inside exception phrases.

        Of the entries that match one word, the heaviest counts. A match that an exception phrase holds only a part of counts.
        """
        if not self.weights:
            return []
        line = f" {' '.join(words)} "
        found, spared = {}, []
        for end, (size, w, exception) in self._automaton().iter(line):
            start = end - size + 1
            if exception:
                spared.append((start, end))
            elif w > found.get(start, (0, 0.0))[1]:
                found[start] = (end, w)
        out, spared_to, at = [], -1, 0
        spared.sort()
        for s, (e, w) in sorted(found.items()):
            while at < len(spared) and spared[at][0] <= s:
                spared_to = max(spared_to, spared[at][1])
                at += 1
            if e > spared_to:
                out.append((s, e, w))
        return out

    def density(self, text: str | None) -> float:
        """The sum of the weights over the logarithm of the length: long texts need more."""
        words = folded_words(text or "")
        return sum(w for *_, w in self.matches(words)) / math.log(math.e + len(words) / 100)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * self.density(text) + self.offset))))


def _features(words: list[str]) -> set[str]:
    """Whole words, and beginnings of four to eight letters. Of words over 40 letters only the beginnings, else lists of features grow with them."""
    out = set()
    for w in set(words):
        out.update(f"{w[:n]}*" for n in range(4, min(len(w), 9)))
        if len(w) <= 40:
            out.add(w)
    return out


def _identity(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key that near copies mostly share, so that one text often copied is no evidence many times over."""
    one = MinHash(1)
    for df in frames:
        sets = shingle_sets(pa.array([" ".join(folded_words(t or "")) for t in df["text"]], pa.string()), 2)
        keys = [int(one(s)[0] >> np.uint64(1)) for s in sets]
        yield pd.DataFrame({"key": np.array(keys, np.int64), "toxic": df["toxic"], "text": df["text"]})


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        toxic, clean = Counter(), Counter()
        for text, y in zip(df["text"], df["toxic"], strict=True):
            (toxic if y else clean).update(_features(folded_words(text or "")))
        # What no toxic text here has can still be in toxic texts elsewhere, so all of it is passed on.
        names = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({"feature": names, "toxic": [toxic[x] for x in names], "clean": [clean[x] for x in names]})


def _phrases(words: list[str], weights: dict[str, float]) -> set[tuple[str, str]]:
    """Pairs and triples of words around each match, with the entry that matches. Words over 40 letters are in none."""
    out, entries = set(), {}
    for i, w in enumerate(words):
        if w not in entries:
            fits = [x for x in (w, *(f"{w[:n]}*" for n in range(4, min(len(w), 8) + 1))) if x in weights]
            entries[w] = max(fits, key=lambda x: weights[x], default=None)
        if entries[w] is not None:
            for size in (2, 3):
                for k in range(max(0, i - size + 1), min(i, len(words) - size) + 1):
                    if all(len(x) <= 40 for x in words[k : k + size]):
                        out.add((" ".join(words[k : k + size]), entries[w]))
    return out


def _phrase_counts(frames: Iterator[pd.DataFrame], weights: dict[str, float]) -> Iterator[pd.DataFrame]:
    for df in frames:
        toxic, clean = Counter(), Counter()
        for text, y in zip(df["text"], df["toxic"], strict=True):
            (toxic if y else clean).update(_phrases(folded_words(text or ""), weights))
        both = list(toxic.keys() | clean.keys())
        if both:  # Arrow can't tell the types of empty columns
            yield pd.DataFrame({"phrase": [p for p, _ in both], "entry": [e for _, e in both], "toxic": [toxic[x] for x in both], "clean": [clean[x] for x in both]})


def _learned_exceptions(sample: DataFrame, weights: dict[str, float], seen: dict[str, tuple[int, int]], least_surprise: float, most: int) -> frozenset[str]:
    """Phrases around entries that clean texts of ``sample (text, toxic)`` have and toxic ones don't.

    ``seen`` has the toxic and the clean texts of each entry. That all of a phrase's texts are clean must be no chance: it is measured
    against the share of toxic texts that the entry has outside the phrase. A phrase that holds a shorter one is not needed.
    """
    if not weights:
        return frozenset()
    shared = sample.sparkSession.sparkContext.broadcast(weights)
    counts = sample.mapInPandas(lambda it: _phrase_counts(it, shared.value), "phrase string, entry string, toxic bigint, clean bigint")
    counts = counts.groupBy("phrase", "entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    per = counts.groupBy("phrase").agg(F.sum("t").alias("t"), F.max("c").alias("c"), F.collect_list("entry").alias("entries")).filter("t = 0 and c >= 4")

    def surprise(c: int, entry: str) -> float:
        toxic, clean = seen[entry]
        return -2 * c * math.log(1 - (toxic + 0.5) / (toxic + max(clean - c, 0) + 1))

    kept: dict[str, None] = {}
    rows = per.orderBy(F.desc("c"), "phrase").limit(4 * most).collect()
    for r in sorted(rows, key=lambda r: (r["phrase"].count(" "), -r["c"], r["phrase"])):
        w = r["phrase"].split(" ")
        if min(surprise(r["c"], e) for e in r["entries"]) >= least_surprise and not any(" ".join(w[k : k + 2]) in kept for k in range(len(w) - 1)):
            kept[r["phrase"]] = None
    return frozenset(list(kept)[:most])


def fit_lexicon(docs: DataFrame, labels: DataFrame, per_class: int = 4000, exceptions: tuple[str, ...] = (), least_surprise: float = 18.0, entries: int = 5000) -> Lexicon:
    """Learns from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``.

    A bounded sample is used: about ``per_class`` labels of each kind, chosen by a hash of the id, with their whole texts; of near copies
    one counts. The sample is drawn from the labels, so it is its ids (a few thousand) that are broadcast and no text is shuffled for it.
    An entry is kept if the log-odds of its texts being toxic are over 1.5 and that is no chance (``least_surprise``, a likelihood
    ratio; about one feature in 50,000 passes 18 by chance); of a word and its beginnings the shortest that is as good stays. At most
    ``entries`` entries. To ``exceptions`` come the phrases that ``_learned_exceptions`` finds in the same sample, at most ``entries``
    too; the calibration is made with them. Null texts and labels teach nothing.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    sizes = dict(marks.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Lexicon({}, frozenset(exceptions))
    drawn = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(F.lit(min(1.0, per_class / sizes[0])))
    marks = marks.filter(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1_000_000)) < drawn * 1_000_000)
    few = marks.limit(8 * per_class + 1).count() <= 8 * per_class  # labels that repeat one id could be more
    texts = docs.select(F.col("doc_id"), F.col("text")).filter("text is not null")
    sample = texts.join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("_id")).select("text", "toxic")
    sample = cut(sample.mapInPandas(_identity, "key bigint, toxic int, text string").groupBy("key", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"))
    n = dict(sample.groupBy("toxic").count().collect())
    nt, nc = n.get(1, 0), n.get(0, 0)
    counts = sample.mapInPandas(_counts, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (nt - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (nc - F.col("c") + 0.5))
    share = nt / max(nt + nc, 1)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    # How surprising it is to find the feature's texts so split (the likelihood ratio statistic).
    surprise = part(F.col("t"), (F.col("t") + F.col("c")) * share) + part(F.col("c"), (F.col("t") + F.col("c")) * (1 - share))
    good = counts.filter("t >= 4").withColumn("odds", odds).withColumn("z", surprise).filter((F.col("odds") > 1.5) & (F.col("z") >= least_surprise))
    best = good.orderBy(F.desc("z"), "feature").limit(4 * entries).collect()
    # A shorter beginning says the same if it is about as surprising and tells the labels about as well apart.
    kept: dict[str, tuple[float, float]] = {}
    for r in sorted(best, key=lambda r: (len(r["feature"].rstrip("*")), not r["feature"].endswith("*"), r["feature"])):
        f = r["feature"].rstrip("*")
        shorter = [kept[x] for k in range(4, len(f) + 1) if (x := f"{f[:k]}*") in kept]
        weight = r["odds"] * r["t"] / (r["t"] + 5)
        if not any(z >= 0.9 * r["z"] and w >= weight - 0.7 for w, z in shorter):
            kept[r["feature"]] = (weight, r["z"])
    top = sorted(kept, key=lambda k: -kept[k][1])[:entries]
    weights = {k: round(kept[k][0], 6) for k in top}
    seen_in = {r["feature"]: (r["t"], r["c"]) for r in best if r["feature"] in weights}
    lexicon = Lexicon(weights, frozenset(exceptions) | _learned_exceptions(sample, weights, seen_in, least_surprise, entries))

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    density = F.pandas_udf(lambda s: pd.Series([shared.value.density(t) for t in s]), "double")
    seen = sample.select("toxic", F.round(density("text"), 2).alias("x")).groupBy("toxic", "x").count().collect()
    x, y, w = (np.array([r[k] for r in seen], float) for k in ("x", "toxic", "count"))
    w = w * np.where(y == 1, sizes[1] / max(nt, 1), sizes[0] / max(nc, 1))
    a, b = 1.0, -2.0
    for _ in range(60):  # a two-parameter logistic fit by Newton's method, lightly held
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (y - p) * x).sum() - 0.5 * (a - 1), (w * (y - p)).sum() - 0.05 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.05]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    lexicon.slope, lexicon.offset = round(a, 6), round(b, 6)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row, from the whole text; a null text scores as an empty one.

    Repeated rows are answered each; an empty table gives an empty table; other columns are not looked at. The lexicon has a bounded
    number of entries and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"doc_id": df["doc_id"], "score": np.array([shared.value.score(t if isinstance(t, str) else None) for t in df["text"]], float)})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns as they are, whatever these are called.

    A null text scores as an empty one. Repeated rows are judged each; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    score = F.pandas_udf(lambda s: pd.Series([shared.value.score(t if isinstance(t, str) else None) for t in s], dtype=float), "double")
    return docs.filter(score(F.col(text_col).cast("string")) < threshold)
