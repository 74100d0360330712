"""Best-fit packing with several permitted sequence lengths.

Texts longer than the longest sequence are cut into pieces. Pieces are dealt into shards of a bounded number by a hash; each shard
packs by best-fit decreasing: a piece goes to the open bin that it leaves with the least room; where none has room, a bin is opened at
the size of least cost per token. What a bin of some size will hold is looked up in the pieces still to come: the longest that fits,
again and again, and the bin is worth the smallest permitted length that holds them. At the end each bin becomes the smallest
permitted length that holds its contents. The look ahead can't know what other bins will take, so a shard is also packed by the
tokens that a size can hold at most, with each longest size to open at, and the packing of the least total cost is kept.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Packing = tuple[list[int], list[int], list[int]]


def price(size: int, overhead: int = 32, quadratic: int = 0) -> int:
    """What a sequence of ``size`` costs: its length, ``overhead``, and for attention its square by ``quadratic`` (0: nothing)."""
    return size + overhead + (size * size // quadratic if quadratic else 0)


def cost(packing: Packing, overhead: int, quadratic: int = 0) -> int:
    return sum(price(s, overhead, quadratic) for s in packing[2])


def cheapest_fit(lengths: Sequence[int], sizes: Sequence[int], overhead: int = 32, quadratic: int = 0) -> Packing:
    """The cheapest of several packings of ``best_fit``: looking ahead, opening at most at each size, and only at each size.

    So it is never dearer than any single size to open at.
    """
    sizes = sorted(set(sizes))
    opens = [*(sizes[: k + 1] for k in range(len(sizes))), *([s] for s in sizes[1:])]
    tried = [best_fit(lengths, sizes, overhead, look=True, quadratic=quadratic)]
    tried += [best_fit(lengths, sizes, overhead, opens=x, quadratic=quadratic) for x in reversed(opens)]
    return min(tried, key=lambda p: cost(p, overhead, quadratic))


class _Ahead:
    """What a bin would hold of the pieces still to come, which are sorted, the longest first."""

    def __init__(self, lengths: list[int]) -> None:
        self.negative = [-n for n in lengths]
        self.sums = [0, *itertools.accumulate(lengths)]

    def fill(self, at: int, room: int) -> int:
        """The tokens of the pieces from ``at`` on that fill ``room``, each the longest that fits: runs of neighbours at a time."""
        held = 0
        while at < len(self.negative) and room > 0:
            at = bisect.bisect_left(self.negative, -room, at)
            upto = bisect.bisect_right(self.sums, self.sums[at] + room, at) - 1
            got = self.sums[upto] - self.sums[at]
            held, room, at = held + got, room - got, upto
        return held


def best_fit(lengths: Sequence[int], sizes: Sequence[int], overhead: int = 32, opens: Sequence[int] | None = None, look: bool = False, quadratic: int = 0) -> Packing:
    """Bin and offset of each piece, and each bin's size. All lengths are 1 to max(sizes).

    Bins open at one of ``opens`` (all sizes, unless given); for a piece that is longer than these, at the smallest size that holds it.
    The least cost per token decides, by the tokens that ``_Ahead`` finds for a bin (``look``), or that it can hold at most.
    """
    sizes = sorted(set(sizes))
    dear = {s: price(s, overhead, quadratic) for s in sizes}
    opens = sizes if opens is None else opens
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = sum(lengths)
    ahead = _Ahead([lengths[i] for i in order]) if look else None
    where, offset = [0] * len(lengths), [0] * len(lengths)
    fill: list[int] = []
    rooms: list[int] = []  # the different amounts of room that open bins have, ascending
    with_room: dict[int, list[int]] = {}
    size_of: list[int] = []
    for place, i in enumerate(order):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                del with_room[room]
                rooms.pop(at)
        else:
            fits = [s for s in opens if s >= n] or [sizes[bisect.bisect_left(sizes, n)]]
            if ahead is not None:
                full = [(n + ahead.fill(place + 1, s - n), s) for s in fits]
                room = min(full, key=lambda x: (dear[sizes[bisect.bisect_left(sizes, x[0])]] / x[0], x[1]))[1]
            else:
                # What a bin will hold at most: its size, or all that is left.
                room = min(fits, key=lambda s: (dear[s] / min(s, left), s))
            b = len(fill)
            fill.append(0)
            size_of.append(room)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        left -= n
        if room > n:
            if room - n not in with_room:
                bisect.insort(rooms, room - n)
            with_room.setdefault(room - n, []).append(b)
    return where, offset, [sizes[bisect.bisect_left(sizes, f)] for f in fill]


def pack(
    docs: DataFrame, sizes: Sequence[int] = (512, 1024, 2048, 4096, 8192), overhead: int = 32, quadratic: int = 49_152, pieces_per_shard: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
) -> DataFrame:
    """``doc_id, piece, piece_start, piece_tokens, bin_id, bin_size, bin_offset, bin_fill``: a row for each piece of each text.

    Tokens are the bytes of the text in UTF-8 and one end mark, or ``length_col``. A null or empty text is its end mark alone; a
    null length is 0, and lengths under 1 take no room and are one piece of 0 tokens with a null bin. Every token is in one bin, and no
    bin holds more than its size. Repeated rows are packed each. An empty table gives an empty table. Other columns are not looked at.

    A sequence of s tokens costs ``price(s, overhead, quadratic)``. Attention takes the square of the length; at the default it is a
    sixth of the rest at 8192 tokens, as in a model 4096 wide. Without it the longest size is nearly always the cheapest to open.

    A shard holds about ``pieces_per_shard`` pieces whatever the size of the table, so it fits a task; the waste that sharding adds is
    at most a few open bins a shard.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("sizes must be positive")
    most = max(sizes)
    length = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint") + 1 if length_col is None else F.coalesce(F.col(length_col).cast("bigint"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), length.alias("n"))
    cuts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)))
    pieces = rows.select("doc_id", "n", F.explode(cuts).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * most).alias("piece_start"), F.greatest(F.least(F.col("n") - F.col("piece") * most, F.lit(most)), F.lit(0)).alias("piece_tokens")
    )
    total = pieces.count()
    shards = max(1, math.ceil(total / pieces_per_shard))
    # Rows that repeat an id would meet in one shard; a few marks of the place where a row is read part them.
    spread = F.pmod(F.xxhash64("doc_id", "piece", F.pmod(F.monotonically_increasing_id(), F.lit(64))), F.lit(shards))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["piece_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        some = df["piece_tokens"].to_numpy() > 0
        where, offset, size_of = cheapest_fit(df["piece_tokens"][some].tolist(), sizes, overhead, quadratic)
        fill = np.bincount(where, df["piece_tokens"][some], len(size_of)).astype(np.int64) if where else np.zeros(0, np.int64)
        out = df[["doc_id", "piece", "piece_start", "piece_tokens"]].copy()
        shard = int(df["shard"].iloc[0])
        for name, values in (("bin_id", [f"{shard}-{b}" for b in where]), ("bin_size", [size_of[b] for b in where]), ("bin_offset", offset), ("bin_fill", [int(fill[b]) for b in where])):
            out[name] = pd.Series(values, index=df.index[some], dtype="object" if name == "bin_id" else "Int64").reindex(df.index)
        return out

    schema = f"doc_id {kind}, piece bigint, piece_start bigint, piece_tokens bigint, bin_id string, bin_size bigint, bin_offset bigint, bin_fill bigint"
    return pieces.withColumn("shard", spread).groupBy("shard").applyInPandas(run, schema)


