"""Decontamination, exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontaminate, exact_dedup, near_dedup
from millrace.llm.components import components
from millrace.llm.shingles import shingle_sets

A2Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, start string, items int, keep_id string, digest string"


def frame(spark, rows, schema=DOCS):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], schema)


def low(t):
    return (t or "").translate(A2Z)


def vocabulary(rnd, n):
    return ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7))) for _ in range(n)]


# -- decontamination


def contaminated(docs, bench, span=10):
    out = {}
    items = {i: WORD.findall(low(t)) for i, t in bench}
    windows = {}
    for i, w in items.items():
        for k in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + span]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, got = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    got |= x
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = vocabulary(rnd, 60)
    bench = [(k, " ".join(rnd.choices(words, k=rnd.choice((1, 3, 7, 10, 14, 30))))) for k in range(12)]
    bench += [(20, None), (21, ""), (22, "!!! ..."), (23, "a " * 25), (24, bench[5][1].upper())]
    docs = []
    for i in range(60):
        t = rnd.choices(words, k=rnd.choice((0, 1, 4, 9, 40, 120)))
        if i % 3 == 0:
            at = rnd.randrange(len(t) + 1)
            item = bench[rnd.randrange(12)][1].split()
            cut = rnd.choice((len(item), 10, 9))
            t[at:at] = item[:cut]
        docs.append((i, rnd.choice((" ", ", ", "\n")).join(t).title() if i % 4 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, "É é 日本語 ß!"), (103, "a " * 300), (104, "word " * 20_000)]
    return docs, bench


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_is_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs, bench = corpus(1)
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(frame(spark, docs), items).collect()}
    assert got == contaminated(docs, bench)


def test_contamination_long_items_only_and_other_widths(spark):
    docs, bench = corpus(2)
    bench = [(i, t) for i, t in bench if t and len(WORD.findall(t)) >= 12]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    for k in (1, 5, 12):
        got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(frame(spark, docs), items, span=12, k=k).collect()}
        assert got == contaminated(docs, bench, 12)


def test_contamination_empty_and_repeated(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = [(1, "one two"), (None, "three four"), (1, "one two")]
    got = decontaminate.contamination(frame(spark, docs), none).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.contaminated) for r in got) == [(0, 2, False), (1, 2, False)]
    assert decontaminate.contamination(frame(spark, []), none).count() == 0
    items = spark.createDataFrame([(7, "three four")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(frame(spark, docs), items).collect()] == [1, 1]
    with pytest.raises(ValueError):
        decontaminate.contamination(frame(spark, docs), items, span=3, k=4)


# -- exact copies


def test_exact_groups(spark):
    rnd = random.Random(3)
    texts = [None, "", "A b", "a B", "É", "é", "x" * 50_000, "X" * 50_000]
    docs = [(i, rnd.choice(texts)) for i in range(200)] + [(None, "only null id"), (5, "again"), (5, "again"), (None, "a b")]
    groups = {}
    for i, t in docs:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t in docs:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i is not None and i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, docs), salts=3).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = exact_dedup.exact_dedup(frame(spark, docs), salts=3)
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((w is None, w or 0) for w in {x[1] for x in want})
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


# -- near copies


def shingles(t, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(docs, percent=75):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    real = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(real)):
        for b in range(a + 1, len(real)):
            both = len(real[a][1] & real[b][1])
            if both and 100 * both >= percent * len(real[a][1] | real[b][1]):
                x, y = find(real[a][0]), find(real[b][0])
                root[max(x, y)] = min(x, y)
    return sorted(repr((i, len(s), None if i is None else find(i))) for i, s in sets)


def families(seed, n, size, length, change):
    rnd = random.Random(seed)
    words = vocabulary(rnd, 400)
    docs = []
    for _ in range(n):
        base = rnd.choices(words, k=length)
        for _ in range(rnd.randint(1, size)):
            t = list(base)
            for _ in range(rnd.randint(0, change)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            docs.append((len(docs), " ".join(t).title() if rnd.random() < 0.3 else "\n ".join(t)))
    return docs


EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (None, "one two"), (906, "same text here for two rows"), (906, "one two three"), (907, "w " * 30_000)]


def test_near_components_are_brute_force(spark):
    docs = families(4, 25, 6, 60, 4) + EDGE
    got = near_dedup.NearDuplicates().components(frame(spark, docs))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect()) == near_components(docs)


def test_near_components_in_large_and_branching_nodes(spark, monkeypatch):
    """One group of near copies at all distances, and a passage that all share, with limits so low that every path is taken."""
    monkeypatch.setattr(near_dedup, "CELL", 8)
    rnd = random.Random(5)
    passage = " ".join(vocabulary(rnd, 25))
    docs = families(6, 1, 150, 50, 12) + [(1000 + i, passage + " " + t) for i, t in families(7, 60, 1, 30, 0)]
    want = near_components(docs)
    got = near_dedup.NearDuplicates(small=4, middling=30, levels=2).components(frame(spark, docs)).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def two_pairs(seed):
    """Two pairs of near copies; of the four sets across only those of 2 and 4 are linked."""
    w = lambda what, n: [f"{what}{seed}x{k}" for k in range(n)]
    c, a, b = w("c", 300), w("a", 48), w("b", 48)
    return [(1, " ".join(c[24:] + a[25:])), (2, " ".join(c + a)), (3, " ".join(c[:-24] + b[25:])), (4, " ".join(c + b))]


def hides(docs, trees, sure):
    """Whether in each node with 2 and 4 an unlinked pair across is estimated higher, and ``sure`` at least."""
    mins = near_dedup.MinHash(near_dedup.TOKENS)
    low32 = {i: (mins(s) >> np.uint64(32)).astype(np.uint32) for (i, _), s in zip(docs, shingle_sets(pa.array([t for _, t in docs]), 1), strict=True)}
    est = {(i, j): near_dedup._estimate(((low32[i] & 255) == (low32[j] & 255)).sum()) for i in low32 for j in low32}
    if est[2, 4] < 0.65 or min(est[1, 2], est[3, 4]) <= max(est[i, j] for i in (1, 2) for j in (3, 4)):
        return False
    for k in range(trees):
        same = [i for i in low32 if low32[i][k] == low32[2][k]]
        if 4 in same and not any(i in same and j in same and est[i, j] >= sure and est[i, j] > est[2, 4] for i, j in ((1, 3), (1, 4), (2, 3))):
            return False
    # Each pair of near copies shares a node, and so do the four at least once.
    return any(len({low32[i][k] for i in low32}) == 1 for k in range(trees))


def test_a_refused_sure_pair_hides_no_link(spark):
    docs = next(d for d in map(two_pairs, range(5000)) if hides(d, 3, 0.75))
    assert [len(shingles(x, 1) & shingles(y, 1)) * 100 >= 75 * len(shingles(x, 1) | shingles(y, 1)) for (_, x), (_, y) in ((docs[0], docs[2]), (docs[0], docs[3]), (docs[1], docs[2]), (docs[1], docs[3]))] == [False, False, False, True]
    near = near_dedup.NearDuplicates(size=1, trees=3)
    near.sure = 0.75
    got = near.components(frame(spark, docs)).collect()
    assert {r.component_id for r in got} == {1}


def test_near_dedup_keeps_one_and_all_columns(spark):
    docs = [(3, "a b c d e f"), (2, "A b c d e f"), (9, "other words that are not the same"), (None, "a b c d e f")]
    kept = near_dedup.near_dedup(frame(spark, docs))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9] and kept.columns == frame(spark, []).columns
    assert near_dedup.NearDuplicates().components(frame(spark, [])).count() == 0


def test_shingle_sets_count_like_python():
    import pyarrow as pa

    texts = [t for _, t in families(8, 10, 3, 30, 3)] + [t for _, t in EDGE] + ["a\x0bb c\rd e f", "É é"]
    assert [len(s) for s in shingle_sets(pa.array(texts), 5)] == [len(shingles(t)) for t in texts]
    assert [len(s) for s in shingle_sets(pa.array(texts).slice(3, 9), 5)] == [len(shingles(t)) for t in texts[3:12]]


def test_components(spark):
    rnd = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(5, 5), (5, 6)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges + [(None, 1)], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- names of columns, types of ids


CLASHES = ("_bad", "_sha", "_keep_id", "_gone", "bad", "sha", "keep_id", "repeat", "salt", "norm", "gone", "KEY", "check", "bytes", "a.b", "text_sha256", "component_id")


@pytest.mark.parametrize("most", [200_000, 0])
def test_functions_that_return_documents_keep_all_columns(spark, monkeypatch, most):
    from millrace.llm import toxicity
    from millrace.llm.common import meet

    monkeypatch.setattr(exact_dedup, "meet", lambda *a, **k: meet(*a, **k, most=most))
    texts = {1: "one two three four five six", 2: "ONE two three four five six", 3: "seven eight nine", 4: None, 5: "bad bad", None: "one two three four five six"}
    rows = [(i, t, *(f"{c}{i}" for c in CLASHES)) for i, t in texts.items()] + [(2, "ONE two three four five six", *(f"{c}2" for c in CLASHES))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    bench = spark.createDataFrame([(1, "seven eight nine")], "item_id bigint, text string")
    done = {
        "exact": (exact_dedup.exact_dedup(docs, salts=3), [2, 3, 4, 5]),
        "near": (near_dedup.near_dedup(docs), [0, 1, 3, 4, 5]),
        "bench": (decontaminate.decontaminate(docs, bench), [0, 1, 2, 2, 4, 5]),
        "toxic": (toxicity.drop_toxic(docs, toxicity.Lexicon({"bad": 9.0}), 0.7), [0, 1, 2, 2, 3, 4]),
    }
    for name, (got, ids) in done.items():
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert sorted(r[0] or 0 for r in kept) == ids, name
        assert all(tuple(r)[2:] == tuple(f"{c}{r[0]}" for c in CLASHES) for r in kept), name


def test_exact_copies_by_shuffles_are_those_by_broadcast(spark, monkeypatch):
    from millrace.llm.common import meet

    rnd = random.Random(31)
    docs = [(rnd.choice((None, *range(400))), rnd.choice(("A b", "a B", None, "", "x", f"t{rnd.randrange(90)}"))) for _ in range(700)]
    results = []
    for most in (200_000, 0):
        monkeypatch.setattr(exact_dedup, "meet", lambda *a, most=most, **k: meet(*a, **k, most=most))
        results.append((sorted(map(repr, exact_dedup.exact_groups(frame(spark, docs), salts=5).collect())), sorted(map(repr, exact_dedup.exact_dedup(frame(spark, docs), salts=5).select("doc_id").collect()))))
    assert results[0] == results[1]
    groups = {}
    for i, t in docs:
        groups.setdefault(low(t), []).append(i)
    best = [max((x for x in g if x is not None), default=None) for g in groups.values()]
    assert results[0][1] == sorted(f"Row(doc_id={b})" for b in best)


def test_near_components_of_text_ids(spark):
    docs = [(f"d{i}" if i is not None else None, t) for i, t in families(41, 12, 4, 40, 3) + EDGE]
    got = near_dedup.NearDuplicates().components(spark.createDataFrame(docs, "doc_id string, text string"))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect()) == near_components(docs)
    assert near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id string, text string")).count() == sum(repr(i) == c for i, c in ((i, c) for i, c in ((r.doc_id, repr(r.component_id)) for r in got.collect())))
