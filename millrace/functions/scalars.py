"""Scalar rules: back-off, key names, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff_bound(attempt: Column, base_ms: float, cap_ms: float) -> Column:
    """The smaller of the cap and base * 2**attempt; large attempts give the cap."""
    return F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(1023)).cast("double")))


def backoff_delay(attempt: Column, r: Column, base_ms: float, cap_ms: float) -> Column:
    """Full jitter: a supplied r in [0, 1) times the bound; null for any other r."""
    return F.when((r >= 0) & (r < 1), r * backoff_bound(attempt, base_ms, cap_ms))


def retry_delay(base_ms: int, retries: Column) -> Column:
    """base * 2**retries without jitter."""
    return F.lit(base_ms).cast("bigint") * F.pow(F.lit(2), retries).cast("bigint")


def dedup_key(i: Column) -> Column:
    return F.concat(F.lit("dedup:"), i.cast("string"))


def room_channel(room: Column) -> Column:
    return F.concat(F.lit("room:"), room.cast("string"))


def leaderboard_key(board: Column) -> Column:
    return F.concat(F.lit("leaderboard:"), board)


def processing_key(queue: Column, consumer: Column) -> Column:
    return F.concat(queue, F.lit(":processing:"), consumer.cast("string"))


def subject_of(stream: Column) -> Column:
    return F.concat(F.lower(stream), F.lit(".events"))


def glob_escape(text: Column) -> Column:
    """A glob that matches only the text itself."""
    return F.regexp_replace(text, r"([\\*?\[\]])", r"\\$1")


def glob_regex(glob: str) -> str:
    """A glob (``*``, ``?``, ``[...]``, backslash) as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 1)
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "[" and end > i + 1:
            out += "[" + glob[i + 1 : end].replace("\\", r"\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def glob_matches_literal(text: Column, escaped: Column) -> Column:
    """Whether an escaped glob, read back, is the text."""
    return F.regexp_replace(escaped, r"\\([\\*?\[\]])", "$1") == text


def rfc3339_nanos(ns: Column) -> Column:
    """Nanoseconds since 1970 as UTC text, the fraction without trailing zeros. By whole numbers, so no session's zone matters."""
    rest = F.pmod(ns, F.lit(86_400_000_000_000))
    day = F.date_from_unix_date(((ns - rest) / 86_400_000_000_000).cast("int")).cast("string")
    second = F.floor(rest / 1_000_000_000)
    clock = F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)))
    part = F.rtrim(F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(day, F.lit("T"), clock, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z"))


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time with ``Z`` or an offset and up to nine decimals; null for anything else."""
    pattern = r"\A(\d{4}-\d\d-\d\d)T([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:\.(\d{1,9}))?(?:Z|([+-])([01]\d|2[0-3]):([0-5]\d))\z"

    def group(k: int) -> Column:
        return F.regexp_extract(text, pattern, k)

    def number(k: int) -> Column:
        return F.when(group(k) == "", F.lit(0)).otherwise(group(k).cast("bigint"))

    away = F.when(group(6) == "-", -1).otherwise(1) * (number(7) * 3600 + number(8) * 60)
    seconds = F.unix_date(F.try_to_date(group(1), "yyyy-MM-dd")).cast("bigint") * 86_400 + number(2) * 3600 + number(3) * 60 + number(4) - away
    return F.when(text.rlike(pattern), seconds * 1_000_000_000 + F.rpad(group(5), 9, "0").cast("bigint"))
