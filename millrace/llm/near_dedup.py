"""Near-duplicates by chosen-path set similarity join.

Each set of shingles is written as minwise tokens. In each of ``trees`` independent trees a document goes from the root to the
node of one of its tokens; small nodes are compared exhaustively, large ones branch further by tokens that the node chooses.
Two sets of similarity s part in one tree with probability 1 - s at most at the root, so ``trees`` = 10 finds a pair at 0.75
with probability 1 - 0.25 ** 10.

Equal sets are one vertex. Small nodes are compared by estimates from 128 tokens, and what comes near the threshold is confirmed on
the full sets, which alone decide: first the likest partner of each document, then, between the components that this gives, all
that is left. Middling nodes that still hold several components are compared on the full sets at once, what is outside the node's
main component against all of it. So a group of n near copies costs about n comparisons, not n * n. A pair that is estimated so high
that the rest between its components was left out, and that the full sets then refuse, opens its nodes again, and all pairs between
their components are confirmed. What stays out in small nodes is a link estimated more than LOW_MARGIN too low.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from .common import cut, fresh, written
from .components import components
from .shingles import MinHash, jaccard_at_least, shingle_sets

TOKENS = 128
#: Estimates from TOKENS tokens have a standard deviation of 0.04 at 0.75: a link is not estimated 0.15 lower, hardly any other pair 0.10 higher.
SURE_MARGIN, LOW_MARGIN = 0.10, 0.15
#: Documents of a cell's side that is held in memory; the other side streams past it.
CELL = 512
#: Ids up to which the documents to confirm are found by a broadcast of their ids (8 bytes each), else by a shuffle.
BROADCAST_IDS = 400_000
_PAIR = "a bigint, b bigint, est float"


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(TOKENS)
    for batch in batches:
        count, digest, tokens, sig = [], [], [], []
        for s in shingle_sets(batch.column(1), size):
            low = (minhash(s) >> np.uint64(32)).astype(np.uint32)
            count.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            tokens.append(low.view(np.int32))
            sig.append((low & np.uint32(255)).astype(np.uint8).tobytes())
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(count, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * TOKENS), pa.array(flat)),
                pa.array(sig, pa.binary()),
            ],
            ["doc_id", "n_shingles", "digest", "tokens", "sig"],
        )


def _estimate(equal: np.ndarray) -> np.ndarray:
    """The similarity, from how many of the tokens' low bytes are equal; one in 256 is so by chance."""
    return ((equal / TOKENS - 1 / 256) * (256 / 255)).astype(np.float32)


def _signatures(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(len(col), TOKENS)


def _within(ids: np.ndarray, labels: np.ndarray, sig: np.ndarray, low: float, join: float) -> list[tuple[int, int, float]]:
    """Pairs of a small node between components, the likest first. Pairs from ``join`` on make their components one."""
    i, j = np.triu_indices(len(ids), 1)
    other = labels[i] != labels[j]
    i, j = i[other], j[other]
    equal = np.concatenate([(sig[i[k : k + 8192]] == sig[j[k : k + 8192]]).sum(1) for k in range(0, len(i), 8192)]) if len(i) else np.zeros(0)
    est = _estimate(equal)
    near = np.flatnonzero(est >= low)
    near = near[np.argsort(-est[near], kind="stable")]
    root = {x: x for x in labels.tolist()}
    found = []
    for k in near.tolist():
        x, y = _find(root, int(labels[i[k]])), _find(root, int(labels[j[k]]))
        if x != y:
            if est[k] >= join:
                root[x] = y
            a, b = sorted((int(ids[i[k]]), int(ids[j[k]])))
            found.append((a, b, float(est[k])))
    return found


def _find(root: dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _node_pairs(frames: Iterator[pd.DataFrame], low: float, join: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by node; a node may lie across frames, and is small."""
    rest = None

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(df):
            node, ids, labels, sig = df["node"].to_numpy(), df["id"].to_numpy(), df["label"].to_numpy(), _signatures(df["sig"])
            cuts = np.append(np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(node))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e - s > 1:
                    found += _within(ids[s:e], labels[s:e], sig[s:e], low, join)
        return pd.DataFrame(found, columns=["a", "b", "est"]).astype({"a": "int64", "b": "int64", "est": "float32"})

    for df in frames:
        df = df if rest is None or not len(rest) else pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        last = df["node"].to_numpy() == df["node"].iloc[-1]
        rest = df[last]
        yield pairs(df[~last])
    if rest is not None:
        yield pairs(rest)


def _against(frames: Iterator[pd.DataFrame], low: float) -> Iterator[pd.DataFrame]:
    """Rows ``id, sig, hub, hub_sig``: each compares one document with one other."""
    for df in frames:
        est = _estimate((_signatures(df["sig"]) == _signatures(df["hub_sig"])).sum(1)) if len(df) else np.zeros(0, np.float32)
        ids, hub = df["id"].to_numpy(), df["hub"].to_numpy()
        near = (est >= low) & (ids != hub)
        yield pd.DataFrame({"a": np.minimum(ids, hub)[near], "b": np.maximum(ids, hub)[near], "est": est[near]})


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size)
        keep = pa.array([jaccard_at_least(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


class _Cell:
    """Sets held by one side of a cell, and the links of a stream of others to them."""

    def __init__(self, percent: int) -> None:
        self.percent, self.sets, self.labels, self.root = percent, [], [], {}
        self.keys: np.ndarray | None = None

    def hold(self, label: int, s: np.ndarray) -> None:
        self.sets.append(s)
        self.labels.append(label)
        self.keys = None

    def links(self, label: int, s: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of labels that a set's links join, each only once."""
        if self.keys is None:
            keys, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            order = np.argsort(keys, kind="stable")
            self.keys, self.owner, self.sizes = keys[order], owner[order], np.array([len(x) for x in self.sets])
        lo, hi = np.searchsorted(self.keys, s, "left"), np.searchsorted(self.keys, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        out = []
        for k in np.flatnonzero((both > 0) & (100 * both >= self.percent * (len(s) + self.sizes - both))).tolist():
            for x in (label, self.labels[k]):
                self.root.setdefault(x, x)
            x, y = _find(self.root, label), _find(self.root, self.labels[k])
            if x != y:
                self.root[x] = y
                out.append((label, self.labels[k]))
        return out


def _cells(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``cell, streams, label, text`` sorted by cell, those that are held first. Held ones come in blocks of about CELL."""
    at, cell = None, _Cell(percent)
    for batch in batches:
        out: list[tuple[int, int]] = []
        rows = zip(batch.column("cell").to_pylist(), batch.column("streams").to_pylist(), batch.column("label").to_pylist(), shingle_sets(batch.column("text"), size), strict=True)
        for key, streams, label, s in rows:
            if key != at:
                at, cell = key, _Cell(percent)
            if streams:
                out += cell.links(label, s) if cell.sets else []
            else:
                cell.hold(label, s)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


class NearDuplicates:
    """Components of documents linked with 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles.

    Nodes of up to ``small`` documents are compared by estimates, of up to ``middling`` on the full sets; larger ones branch, ``levels``
    times at most.
    """

    def __init__(self, size: int = 5, percent: int = 75, trees: int = 10, small: int = 64, middling: int = 4096, levels: int = 16) -> None:
        self.size, self.percent, self.trees, self.small, self.middling, self.levels = size, percent, trees, small, middling, levels
        self.low, self.sure = percent / 100 - LOW_MARGIN, percent / 100 + SURE_MARGIN

    # -- candidates

    def _sized(self, members: DataFrame) -> DataFrame:
        """Members ``node, id`` of nodes that hold two ids at least, with the node's size."""
        sizes = members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        return cut(members.join(sizes, "node"))

    def _mixed(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members ``node, id, label`` of nodes that hold several components."""
        named = members.select("node", "id", "n").join(labels, "id", "left").select("node", "id", "n", F.coalesce("label", "id").alias("label"))
        mixed = named.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("node")
        return cut(named.join(mixed, "node", "left_semi"))

    def _by_estimate(self, members: DataFrame, reps: DataFrame, join: float) -> DataFrame:
        """Pairs of the small nodes; ``join`` as in ``_within``."""
        rows = members.filter(F.col("n") <= self.small).join(reps.select("id", "sig"), "id").select("node", "id", "label", "sig")
        parts, low = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.low
        return rows.repartition(parts, "node").sortWithinPartitions("node").mapInPandas(lambda it: _node_pairs(it, low, join), _PAIR)

    def _hubs(self, members: DataFrame, reps: DataFrame) -> DataFrame:
        """Larger nodes: each document against the node's smallest and largest id, and two chosen by a hash."""
        rows = members.filter(F.col("n") > self.small)
        ends = rows.groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min_by("id", F.xxhash64("id")).alias("c"), F.max_by("id", F.xxhash64("id")).alias("d"))
        ends = ends.select("node", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("hub"))
        ends = ends.join(reps.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
        pairs = rows.join(ends, "node").select("id", "hub", "hub_sig").join(reps.select("id", "sig"), "id")
        low = self.low
        return pairs.mapInPandas(lambda it: _against(it, low), _PAIR)

    def _deeper(self, large: DataFrame, reps: DataFrame, labels: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Branches nodes that are too large, level by level: what becomes small, and what becomes middling or branches no more.

        Of n unlike documents that share a part p of their tokens, p * n stay together at each level, in two branches: nodes shrink
        until they are middling, and the memberships grow as (2p) ** levels at most, not as n * n.
        """
        small, middling = [], []
        for level in range(self.levels + 1):
            members = self._mixed(large, labels)
            if not members.limit(1).count():
                break
            if level == self.levels:
                middling.append(members)
                break
            if level == 0:
                # No later level holds other documents, so the tokens of the rest are shuffled at none.
                reps = cut(self._only(reps.select("id", "tokens"), "id", cut(members.select(F.col("id").alias("_id")).distinct())))
            # Two of the tokens, which the node chooses: with 1 / 0.75 expected at least, the survival of a pair doesn't fade.
            pick = F.array(*(F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(TOKENS - self.trees)) + self.trees for k in range(2)))
            branches = members.join(reps, "id").select("node", "id", "label", "tokens", F.explode(pick).alias("at"))
            nodes = branches.select(F.xxhash64("node", "at", F.get("tokens", F.col("at").cast("int"))).alias("node"), "id", "label").distinct()
            sized = self._sized(nodes)
            small.append(sized.filter(F.col("n") <= self.small))
            middling.append(sized.filter((F.col("n") > self.small) & (F.col("n") <= self.middling)))
            large = sized.filter(F.col("n") > self.middling)
        return small, middling

    # -- decision

    def _only(self, rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
        """The ``rows`` of the ids ``ids (_id)``: where these are few, the others are left out before any shuffle."""
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return rows.join(F.broadcast(ids) if few else ids, rows[id_col] == ids["_id"], "left_semi")

    def _confirm(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs (a, b)`` that the full sets confirm."""
        texts = self._only(docs, "doc_id", cut(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()))
        rows = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        size, percent = self.size, self.percent
        return cut(rows.mapInArrow(lambda it: _confirmed(it, size, percent), "a bigint, b bigint"))

    def _by_sets(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """Links between components in mixed nodes, on the full sets, as pairs of labels.

        A node's documents outside its main component are dealt into blocks of about CELL; each block is a cell in which they are
        held in memory while all of the node streams past. A document comes to as many cells as the node has blocks.
        """
        label = members.groupBy("node", "label").agg(F.count("*").alias("k"))
        main = label.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("k"))
        rows = members.join(main, "node").withColumn("blocks", F.ceil((F.col("n") - F.col("k")) / CELL)).withColumn("own", F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
        rows = rows.select("node", "id", "label", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        # A held document streams past the blocks after its own, so two of them meet once; in its own block it does so too.
        held = rows.filter("own = block").select(F.xxhash64("node", "block").alias("cell"), F.lit(False).alias("streams"), "id", "label")
        past = rows.filter("own is null or own >= block").select(F.xxhash64("node", "block").alias("cell"), F.lit(True).alias("streams"), "id", "label")
        cells = held.unionByName(past)
        texts = self._only(docs, "doc_id", cut(members.select(F.col("id").alias("_id")).distinct()))
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = cells.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("cell", "streams", "label", "text").repartition(parts, "cell").sortWithinPartitions("cell", "streams")
        size, percent = self.size, self.percent
        return cut(rows.mapInArrow(lambda it: _cells(it, size, percent), "a bigint, b bigint").distinct())

    def _reopened(self, small: DataFrame, refused: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
        """All pairs between components, whatever their estimates, in those of the ``small`` nodes that hold a pair of ``refused (a, b)``."""
        one = small.select("node", F.col("id").alias("a")).join(refused, "a")
        nodes = one.join(small.select("node", F.col("id").alias("b")), ["node", "b"]).select("node").distinct()
        pairs = self._by_estimate(self._mixed(small.join(nodes, "node", "left_semi"), labels), reps, float("inf"))
        return pairs.groupBy("a", "b").agg(F.max("est").alias("est"))

    def _relabel(self, labels: DataFrame | None, edges: DataFrame) -> DataFrame:
        """Labels after ``edges`` between labels."""
        new = components(edges)
        if labels is None:
            return new
        old = labels.select("id", F.col("label").alias("_l")).join(new.select(F.col("id").alias("_i"), F.col("label").alias("_n")), F.col("_l") == F.col("_i"), "left")
        old = old.select("id", F.coalesce("_n", "_l").alias("label"))
        return cut(old.union(new.join(labels.select("id"), "id", "left_anti").select("id", "label")))

    def _apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Those of ``pairs (a, b, est)`` that lie between two components, with their labels ``la, lb``."""
        named = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("_la")), "a", "left")
        named = named.join(labels.select(F.col("id").alias("b"), F.col("label").alias("_lb")), "b", "left")
        return named.select("a", "b", "est", F.coalesce("_la", "a").alias("la"), F.coalesce("_lb", "b").alias("lb")).filter("la <> lb")

    def _settle(self, docs: DataFrame, pending: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels after those of the pairs ``pending (a, b, est)`` that the full sets confirm."""
        for most in (4, None):
            # Pairs within one component need no look; of those between two components the likest come first.
            ends = [F.least("la", "lb"), F.greatest("la", "lb")]
            pending = cut(self._apart(pending, labels).withColumn("r", F.row_number().over(W.partitionBy(*ends).orderBy(F.desc("est"), "a", "b"))))
            now = pending if most is None else pending.filter(F.col("r") <= most)
            if not now.limit(1).count():
                break
            sound = self._confirm(docs, now)
            joined = now.join(sound, ["a", "b"], "left_semi").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            labels = self._relabel(labels, joined)
            if most is not None:
                pending = pending.filter(F.col("r") > most).select("a", "b", "est")
        return labels

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, n_shingles, component_id, kept``, a row per row of ``docs``.

        Null and empty texts and texts without words have no shingles and are linked with nothing. A row with a null id is linked
        with nothing and is its own: component_id null, kept. Rows that repeat an id are one vertex; they are linked where any of
        their texts is. An empty table gives an empty table. Other columns are not looked at. Ids are of any type that has an order:
        what is no integer is numbered in that order first.
        """
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        if isinstance(docs.schema["doc_id"].dataType, IntegralType):
            return self._components(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))
        # Sorted by ranges, so numbers rise with the ids from partition to partition too; written, so they are dealt once.
        known = docs.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct().orderBy("_id")
        numbers = written(known.withColumn("_n", F.monotonically_increasing_id()), "numbers")[0]
        found = self._components(docs.join(numbers, F.col("doc_id") == F.col("_id"), "left").select(F.col("_n").alias("doc_id"), "text"))
        own, first = (numbers.select(F.col("_id").alias(f"{x}_id"), F.col("_n").alias(f"{x}_n")) for x in ("own", "first"))
        named = found.join(own, F.col("doc_id") == F.col("own_n"), "left").join(first, F.col("component_id") == F.col("first_n"), "left")
        return named.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("first_id").alias("component_id"), "kept")

    def _components(self, docs: DataFrame) -> DataFrame:
        size = self.size
        all_rows = cut(docs.mapInArrow(lambda it: _sketches(it, size), "doc_id bigint, n_shingles bigint, digest binary, tokens array<int>, sig binary"))
        sets = all_rows.filter("n_shingles > 0 and doc_id is not null")
        reps = cut(sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens"), F.first("sig").alias("sig")))

        roots = reps.select("id", F.posexplode(F.slice("tokens", 1, self.trees)).alias("tree", "token"))
        sized = self._sized(roots.select(F.xxhash64("tree", "token").alias("node"), "id", F.col("id").alias("label")))
        first = self._by_estimate(sized, reps, self.low).unionByName(self._hubs(sized, reps))
        first = cut(first.groupBy("a", "b").agg(F.max("est").alias("est")))

        # The likest partner of each document.
        ends = first.select(F.col("a").alias("x"), F.col("b").alias("y"), "est").union(first.select("b", "a", "est"))
        best = ends.groupBy("x").agg(F.max_by("y", F.struct("est", "y")).alias("y"))
        best = cut(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = self._relabel(None, self._confirm(docs, best))

        # Nodes that still hold several components.
        mixed = self._mixed(sized, labels)
        small, middling = self._deeper(mixed.filter(F.col("n") > self.middling), reps, labels)
        middling = [mixed.filter((F.col("n") > self.small) & (F.col("n") <= self.middling)), *(self._mixed(x, labels) for x in middling)]
        middling = reduce(DataFrame.unionByName, [x.select("node", "id", "n", "label") for x in middling])
        if middling.limit(1).count():
            labels = self._relabel(labels, self._by_sets(docs, middling))
        small = reduce(DataFrame.unionByName, [x.select("node", "id", "n") for x in (mixed.filter(F.col("n") <= self.small), *small)])
        pending = cut(self._by_estimate(self._mixed(small, labels), reps, self.sure).groupBy("a", "b").agg(F.max("est").alias("est")))
        labels = self._settle(docs, pending.join(best, ["a", "b"], "left_anti"), labels)
        refused = cut(self._apart(pending.filter(F.col("est") >= self.sure), labels).select("a", "b"))
        if refused.limit(1).count():
            again = self._reopened(small, refused, reps, labels)
            labels = self._settle(docs, again.join(best.union(refused), ["a", "b"], "left_anti"), labels)

        of_set = reps.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
        # An id with several texts joins their components.
        twice = sets.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
        if twice.limit(1).count():
            own = sets.join(twice, "doc_id", "left_semi").join(of_set, "digest").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
            tied = components(own)
            of_set = of_set.join(tied, of_set["component"] == tied["id"], "left").select("digest", F.coalesce("label", "component").alias("component"))
        rows = all_rows.select("doc_id", "n_shingles", "digest").withColumn("digest", F.when(F.col("n_shingles") > 0, F.col("digest")))
        out = rows.join(of_set, "digest", "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
        )
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one document of each component stays: the one with the smallest id.

    Rows with a null id, a null or empty text all stay; rows that repeat an id stay or go together. Columns may have any name. An
    empty table gives an empty table.
    """
    (gone,) = fresh(docs, "gone")
    others = NearDuplicates(**options).components(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(others, F.col(id_col) == F.col(gone), "left_anti")
