"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters kept as they are after lower-casing; every other character is the one symbol 32. Astral letters share a symbol.
_FOLD: np.ndarray | None = None
CHUNK_CHARS = 1 << 20


def _fold_table() -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        table = np.full(0x10000, 32, np.uint16)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        _FOLD = table
    return _FOLD


def symbols(text: str) -> np.ndarray:
    """Folded characters, runs of what is no letter as one blank, with one blank at either end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _fold_table()[np.minimum(raw, 0xFFFF)]
    high = raw > 0xFFFF
    if high.any():
        s[high] = np.array([0x2603 if chr(c).isalpha() else 32 for c in raw[high].tolist()], np.uint16)
    s = np.concatenate(([32], s, [32])).astype(np.uint16)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    return s[keep]


def has_letter(sym: np.ndarray) -> bool:
    return bool((sym != 32).any())


def grams(sym: np.ndarray, order: int) -> np.ndarray:
    """The n-grams as 64-bit keys, 16 bits a symbol, the last symbol lowest."""
    m = len(sym) - order + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(order if m > 0 else 0):
        out = (out << np.uint64(16)) | sym[k : k + m].astype(np.uint64)
    return out


def counted_grams(text: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text and how often each occurs."""
    sym = symbols(text)
    return np.unique(grams(sym, order), return_counts=True)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (16 * n)) - 1)


class KneserNey:
    """Interpolated Kneser-Ney: sorted keys and their numerators for each order, and each context's total and back-off weight."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, discount: float = 0.75) -> None:
        self.order, self.tables = order, []
        while True:
            keys, counts = np.asarray(keys, np.uint64), np.asarray(counts, np.float64)
            ctx, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(at, counts, len(ctx))
            self.tables.append((keys, np.maximum(counts - discount, 0.0), ctx, total, discount * np.bincount(at, minlength=len(ctx)) / total))
            if len(self.tables) == order:
                break
            # A lower order counts the different symbols before, not the occurrences.
            n = order - len(self.tables)
            keys, counts = np.unique(keys & _mask(n), return_counts=True)
        self.floor = 1.0 / (len(self.tables[-1][0]) + 1)

    def prob(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """P(last symbol | the symbols before) of each key."""
        if level == self.order:
            return np.full(len(keys), self.floor)
        known, numer, ctx, total, back = self.tables[level]
        lower = self.prob(keys & _mask(max(self.order - level - 1, 0)), level + 1)
        if not len(known):
            return lower
        c = np.minimum(np.searchsorted(ctx, keys >> np.uint64(16)), len(ctx) - 1)
        seen = ctx[c] == keys >> np.uint64(16)
        k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        own = np.where(known[k] == keys, numer[k], 0.0)
        return np.where(seen, own / total[c] + back[c] * lower, lower)


@dataclass
class LanguageModel:
    """Models of all languages over one sorted array of n-grams.

    ``cost[i]`` holds the negative log probability of ``keys[i]`` in each language; n-grams that no language has seen are
    computed from the models. ``reject`` is, for each language, the cross-entropy above which a text is like none that was learned;
    ``scale`` turns a lead in cross-entropy into a score.
    """

    langs: list[str]
    order: int
    keys: np.ndarray
    cost: np.ndarray
    models: list[KneserNey]
    reject: np.ndarray
    scale: float

    def entropies(self, text: str) -> np.ndarray | None:
        """Each language's cross-entropy per character of the whole text; None without a letter."""
        sym = symbols(text)
        if not has_letter(sym):
            return None
        while len(sym) < self.order:
            sym = np.append(sym, np.uint16(32))
        # Long texts in pieces that overlap by order - 1 symbols: every n-gram counts once.
        total, n = np.zeros(len(self.langs)), 0
        for i in range(0, len(sym) - self.order + 1, CHUNK_CHARS):
            g, c = np.unique(grams(sym[i : i + CHUNK_CHARS + self.order - 1], self.order), return_counts=True)
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = self.keys[at] == g
            total += c[hit].astype(np.float64) @ self.cost[at[hit]]
            if not hit.all():
                fresh = g[~hit]
                total += c[~hit].astype(np.float64) @ np.stack([-np.log(m.prob(fresh)) for m in self.models], 1)
            n += int(c.sum())
        return total / n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected as none of the languages."""
        h = self.entropies(text) if text and self.langs else None
        if h is None:
            return "und", 0.0, True
        best = int(h.argmin())
        e = np.exp(-(h - h[best]) * self.scale)
        return self.langs[best], float(1 / e.sum()), bool(h[best] > self.reject[best])


def _train_counts(frames: Iterator[pd.DataFrame], order: int) -> Iterator[pd.DataFrame]:
    """Each batch's counts by language."""
    for df in frames:
        for lang, part in df.groupby("lang"):
            keys: list[np.ndarray] = []
            for text in part["text"]:
                keys.append(grams(symbols(text), order))
            k, c = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": k.view(np.int64), "n": c.astype(np.int64)})


def fit_languages(labelled: DataFrame, order: int = 4, docs_per_lang: int = 3000, calibration_docs: int = 100, id_col: str = "doc_id") -> LanguageModel:
    """Learns from ``labelled (id, text, lang)``.

    A bounded sample is used: about ``docs_per_lang`` texts of each language, chosen by a hash of the id, whole. Of each language
    about ``calibration_docs`` further texts set the rejection limit (their largest cross-entropy but for one in fifty, and a
    tenth more) and the score's scale. Null texts and null languages teach nothing.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col(id_col).alias("id"), "text", "lang")
    sizes = dict(rows.groupBy("lang").count().collect())  # a row for each language
    langs = sorted(sizes)
    models, held = [], {}
    if langs:
        part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10))  # a tenth calibrates, the rest teaches

        def share(most: float) -> Column:
            return F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n) * 1_000_000)))[F.col("lang")]

        draw = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1_000_000))
        sample = rows.filter((part > 0) & (draw < share(docs_per_lang / 0.9))).select("text", "lang")
        counts = sample.mapInPandas(lambda it: _train_counts(it, order), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        counts["gram"] = counts["gram"].to_numpy().view(np.uint64)
        langs = [x for x in langs if (counts["lang"] == x).any()]
        for lang in langs:
            own = counts[counts["lang"] == lang].sort_values("gram")
            models.append(KneserNey(own["gram"].to_numpy(), own["n"].to_numpy(), order))
        for r in rows.filter((part == 0) & (draw < share(calibration_docs / 0.1))).select("text", "lang").collect():
            held.setdefault(r["lang"], []).append(r["text"])
    keys = np.unique(np.concatenate([m.tables[0][0] for m in models])) if models else np.zeros(0, np.uint64)
    cost = np.stack([-np.log(m.prob(keys)) for m in models], 1).astype(np.float32) if models else np.zeros((0, 0), np.float32)
    model = LanguageModel(langs, order, keys, cost, models, np.full(len(langs), np.inf), 10.0)
    leads, limits = [], np.full(len(langs), np.inf)
    for i, lang in enumerate(langs):
        own = [h for t in held.get(lang, []) if (h := model.entropies(t)) is not None]
        if own:
            limits[i] = 1.1 * float(np.quantile([h[i] for h in own], 0.98))
            leads += [float(np.partition(h, 1)[1] - h[i]) for h in own] if len(langs) > 1 else []
    model.reject = limits
    # The scale at which the weakest fiftieth of right answers still scores 0.9 among two languages.
    if leads and (lead := float(np.quantile(leads, 0.02))) > 0:
        model.scale = float(np.log(9) / lead)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row: the language with the lowest cross-entropy over the whole text.

    ``und``, 0 and rejected for null texts and texts without a letter. Repeated rows are answered each; an empty table gives an
    empty table; other columns are not looked at. The model (its size is set by the alphabets and the bounded sample) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for df in frames:
            out = [m.predict(t if isinstance(t, str) else None) for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "rejected": [x[2] for x in out]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")

