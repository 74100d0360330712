"""Personal data and secrets: fixed patterns, and bootstrapped contextual extraction of what they miss.

Seeds are the fixed patterns' finds and, for the further kind ``secret``, strings that look made by a machine: ``SECRET_LENGTH``
characters or more that go from letters to digits or back at least ``SECRET_CHANGES`` times. The words around each seed and its own
beginning are lexical patterns; patterns and the strings found in them form a bipartite graph over which confidence spreads: a
pattern is as good as the strings in it, a string as good as its patterns. What stands in a pattern that ends up trusted, and looks
like an identifier, is a find of the pattern's kind; so is a secret, which its looks alone don't make one: a commit's digest in no
context that others share is none. Identifiers are words with a digit or @, of any length, and runs of numbers with the blanks,
parentheses, dots and dashes that phones and cards have.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, meet

KINDS = ("email", "ip", "card", "phone")
#: Found by context only, after the kinds above.
SECRET = "secret"
SECRET_LENGTH, SECRET_CHANGES = 16, 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match takes whole runs of digits, so one that begins inside a run can be skipped at once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Tried only where a word begins, and whole, so it takes time linear in the text.
_IDENTIFIER = re.compile(r"(?<![^\s\"'<>=,;:()\[\]{}|])[^\s\"'<>=,;:()\[\]{}|0-9@]*+[0-9@][^\s\"'<>=,;:()\[\]{}|]*+")
_NUMBER = re.compile(r"\+?[0-9.-]++")
#: What the phone and card patterns allow between digits.
_BETWEEN = "\x20().-"
#: Digits of a phone, at least.
_LEAST_DIGITS = 8
#: Longer surfaces are known by a digest.
_LONG = 64
_WORD = re.compile(r"[^\s]+")
_KEY = re.compile(r"[A-Za-z0-9_+/-]+")
_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_LETTER = re.compile(r"[^\W\d_]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            yield s, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end, in code points, of the fixed patterns' matches that pass their checks; by kind, then start."""
    text = text or ""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def key_span(text: str, start: int, end: int) -> tuple[int, int]:
    """A word without the signs after it, if it is one run of letters, digits, ``_``, ``+``, ``/`` and ``-``; else as it is."""
    m = _KEY.match(text, start, end)
    return (start, m.end()) if m and not any(c.isalnum() for c in text[m.end() : end]) else (start, end)


def looks_secret(s: str) -> bool:
    return len(s) >= SECRET_LENGTH and _KEY.fullmatch(s) is not None and len(_CHANGE.findall(s)) >= SECRET_CHANGES


def _beginning(s: str) -> list[str]:
    """The pattern of keys that begin alike: four letters, the length and the kinds of characters."""
    if len(s) < SECRET_LENGTH or not s[:4].isalpha() or not _KEY.fullmatch(s):
        return []
    return [f"p {s[:4]} {len(s)} {'a' * any(map(str.islower, s))}{'A' * any(map(str.isupper, s))}"]


def _context(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a place.

    The two words before it; the word before with the word after; and, where it follows a sign or word without a blank, all back to
    the last word with a letter (at most three words).
    """
    words = _WORD.findall(text[max(0, start - 80) : start])[-3:]
    before = [_shape_word(w) for w in words[-2:]]
    glued = start > 0 and not text[start - 1].isspace()
    after = _WORD.findall(text[end : end + 40])[:1]
    out = []
    if len(before) == 2:
        out.append("2 " + " ".join(before) + (" ^" if glued else ""))
    if before and after:
        out.append("1 " + before[-1] + (" ^ _ " if glued else " _ ") + _shape_word(after[0]))
    if glued:
        for n in range(1, len(words) + 1):
            if _LETTER.search(words[-n]):
                out.append("0 " + " ".join(map(_shape_word, words[-n:])) + " ^")
                break
    return out + _beginning(text[start:end])


def _shape_word(w: str) -> str:
    return re.sub(r"[0-9]+", "0", w.lower())


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What may be an identifier, outside the spans ``taken`` (sorted): words with a digit or @, and the longest runs of numbers.

    A run of numbers goes over blanks, parentheses, dots and dashes, as in phones and cards. It ends with a sentence if it has the
    digits of a phone by then, and where a parenthesis closes that opened before it. A parenthesis at its edge belongs to it if its
    other half does.
    """
    t = 0
    start = end = digits = 0  # the run that may go on; none if digits is 0
    inside = 0  # parentheses open in the run or at its start

    def closed(s: int, e: int) -> tuple[int, int]:
        while e > s and text[e - 1] in ".!?":
            e -= 1
        opening, closing = text.count("(", s, e), text.count(")", s, e)
        if closing > opening and s and text[s - 1] == "(":
            return s - 1, e
        if opening > closing and text[e : e + 1] == ")":
            return s, e + 1
        return s, e

    for m in _IDENTIFIER.finditer(text):
        s, e = m.span()
        while t < len(taken) and taken[t][1] <= s:
            t += 1
        if t < len(taken) and taken[t][0] < e:
            continue
        number = _NUMBER.fullmatch(text, s, e) is not None
        if digits:
            sentence = digits >= _LEAST_DIGITS and text[end - 1] == "."
            if number and not sentence and text[s] != "+" and not (gap := text[end:s]).strip(_BETWEEN) and inside >= gap.count(")"):
                inside += gap.count("(") - gap.count(")")
                end, digits = e, digits + sum("0" <= c <= "9" for c in text[s:e])
                continue
            yield closed(start, end)
            digits = 0
        if number:
            start, end, digits = s, e, sum("0" <= c <= "9" for c in text[s:e])
            inside = int(s > 0 and text[s - 1] == "(")
        else:
            yield closed(s, e)
    if digits:
        yield closed(start, end)


def _surface(s: str) -> str:
    return s if len(s) <= _LONG else "#" + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def found_places(text: str, spans: list[tuple[str, int, int]], shortest: int) -> list[tuple[str, int, int]]:
    """Seeds with their kinds, and candidates (no kind) of ``shortest`` characters at least, outside the base spans."""
    out = list(spans)
    for s, e in _candidates(text, sorted((s, e) for _, s, e in spans)):
        s, e = key_span(text, s, e)
        if e - s >= shortest:
            out.append((SECRET if looks_secret(text[s:e]) else "", s, e))
    return out


def _scan(frames: Iterator[pd.DataFrame], shortest: int) -> Iterator[pd.DataFrame]:
    for df in frames:
        base, seen = [], []
        for text in df["text"]:
            text = text if isinstance(text, str) else ""
            spans = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            found = []
            if "@" in text or _DIGIT.search(text):
                places = found_places(text, spans, shortest)
                found = [{"kind": k, "start": s, "end": e, "surface": _surface(text[s:e]), "contexts": c} for k, s, e in places if (c := _context(text, s, e))]
            seen.append(found)
        yield pd.DataFrame({"doc_id": df["doc_id"], "key": df["key"], "base": base, "seen": seen})


def find_personal_data(
    docs: DataFrame, rounds: int = 3, least_seeds: int = 5, trust: float = 0.8, shortest: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``kind, start, end`` by kind as in ``KINDS``, then start; ``base`` are the fixed patterns' finds.

    A lexical pattern counts for a kind with ``least_seeds`` different seeds of it at least; its confidence is the mean confidence of
    the different strings in it, one unknown string added. A string's confidence is 1 minus the product of its patterns' doubts. After
    ``rounds`` rounds, a string of ``shortest`` characters or more in a pattern of confidence ``trust`` becomes a span where it stands
    in that pattern. Spans of kind ``secret`` come last. All documents count. A null text is empty; rows that repeat a doc_id are
    answered each; an empty table gives an empty table; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    # The number of a row is dealt once: the checkpoint keeps it.
    scanned = cut(
        rows.withColumn("key", F.monotonically_increasing_id()).mapInPandas(
            lambda it: _scan(it, shortest),
            f"doc_id {kind}, key bigint, base {span}, seen array<struct<kind:string,start:bigint,end:bigint,surface:string,contexts:array<string>>>",
        )
    )
    places = scanned.select("key", F.explode("seen").alias("s")).select("key", "s.kind", "s.start", "s.end", "s.surface", F.explode("s.contexts").alias("pattern"))
    edges = places.groupBy("pattern", "surface").agg(F.max("kind").alias("seed"))
    # Only patterns with enough seeds of one kind can ever be trusted; the graph is cut down to them first.
    able = edges.filter("seed <> ''").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_seeds)
    able = cut(able.select("pattern", "kind"))
    graph = cut(meet(edges, able, ["pattern"], "inner", "surface").withColumn("c", (F.col("seed") == F.col("kind")).cast("double")))
    # Looks make a seed of secrets, and leave open whether the string is of another kind.
    open_ = F.col("seed").isin("", SECRET) & (F.col("seed") != F.col("kind"))
    for _ in range(rounds):
        good = graph.groupBy("pattern", "kind").agg((F.sum("c") / (F.count("*") + 1)).alias("conf"))
        unknown = meet(graph.filter(open_), good, ["pattern", "kind"], "inner", "surface")
        doubt = unknown.groupBy("surface", "kind").agg(F.exp(F.sum(F.log(1 - F.col("conf")))).alias("doubt"))
        graph = graph.select("pattern", "surface", "seed", "kind", "c").join(doubt, ["surface", "kind"], "left")
        graph = cut(graph.withColumn("c", F.when(open_, 1 - F.coalesce("doubt", F.lit(1.0))).otherwise(F.col("c"))).drop("doubt"))
    good = graph.groupBy("pattern", "kind").agg((F.sum("c") / (F.count("*") + 1)).alias("conf")).filter(F.col("conf") >= trust)
    best = cut(good.groupBy("pattern").agg(F.max_by("kind", F.struct("conf", "kind")).alias("as"), F.max("conf").alias("conf")))
    new = meet(places.filter(F.col("kind").isin("", SECRET)), best, ["pattern"], "inner", "key")
    new = new.groupBy("key", "start", "end").agg(F.max_by("as", F.struct("conf", "as")).alias("kind"))
    per = new.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    order = F.create_map(*(x for i, k in enumerate((*KINDS, SECRET)) for x in (F.lit(k), F.lit(i))))
    together = F.concat("base", F.coalesce("more", F.array().cast(span)))
    ranked = F.array_sort(F.transform(together, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select("doc_id", "key", "base").join(per, "key", "left").select("doc_id", "base", spans.alias("spans"))
