"""Routing by keys and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topic_regex(pattern: str) -> str:
    """A topic pattern as a regular expression: words between dots, ``*`` one word, ``#`` any number of words, none included."""
    out = ""
    words = pattern.split(".")
    words = [w for i, w in enumerate(words) if w != "#" or i == 0 or words[i - 1] != "#"]  # any number twice is any number
    for i, w in enumerate(words):
        one = r"[^.]+" if w == "*" else re.escape(w)
        if w == "#":
            # Zero or more words with their dots; alone, anything.
            out += r".*" if len(words) == 1 else (r"(?:[^.]+\.)*" if i == 0 else r"(?:\.[^.]+)*")
        else:
            after_first_hash = i == 1 and words[0] == "#"
            out += one if i == 0 or after_first_hash else r"\." + one
    return rf"\A{out}\z"


def topic_matches(key: Column, pattern: str) -> Column:
    return key.rlike(topic_regex(pattern))


def route(messages: DataFrame, bindings: dict[str, str], key: str = "routing_key") -> DataFrame:
    """A row for each message and queue that it reaches; a queue gets a message once. ``bindings`` maps patterns to queues."""
    by_queue: dict[str, list[str]] = {}
    for pattern, queue in bindings.items():
        by_queue.setdefault(queue, []).append(topic_regex(pattern))
    hits = [F.when(F.col(key).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(queue)) for queue, patterns in sorted(by_queue.items())]
    return messages.withColumn("queue", F.explode(F.array_compact(F.array(*hits))))


def unroutable(messages: DataFrame, patterns: list[str], key: str = "routing_key", mandatory: str = "mandatory") -> DataFrame:
    """Messages that no binding takes: returned with code 312 if mandatory, else dropped."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | topic_matches(F.col(key), p)
    lost = messages.filter(~hit)
    return lost.withColumn("outcome", F.when(F.col(mandatory), "returned").otherwise("dropped")).withColumn("reply_code", F.when(F.col(mandatory), F.lit(312)))


def direct(messages: DataFrame, bindings: DataFrame, key: str = "routing_key") -> DataFrame:
    """Equality of routing key and binding key. Bindings are a topology, a few rows, which is checked by the caller's literals."""
    return messages.join(F.broadcast(bindings), key)
