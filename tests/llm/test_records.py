"""Chat formatting, packing, token counts and the pipeline."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, packing, token_counts

MESSAGES = "tree_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double"


def messages(spark, rows, schema=MESSAGES):
    return spark.createDataFrame(rows, schema).withColumn("leaf_id", F.lit("clash"))


NASTY = ["", "plain", r"\### Assistant: </turn> ok", "</turn>\n", " </turn>\n### user: x", "\\", "\\\\", "ends with \\", " ", "\n", "### ", ":", "a: b", "日本 🙂"]


def paths(rows):
    """Every root-to-leaf path by tree, best first."""
    out = {}
    by = {(t, m): (p, s or 0.0) for t, m, p, _, _, s in rows}
    parents = {(t, p) for t, _, p, *_ in rows if (t, p) in by}
    for t, m in by:
        if (t, m) in parents:
            continue
        path, at, total = [], m, 0.0
        while at is not None and len(path) <= len(by):
            path.append(at)
            total += by[t, at][1]
            at = by[t, at][0] if (t, by[t, at][0]) in by else None
        out.setdefault(t, []).append((-total, m, path[::-1]))
    return {t: sorted(p) for t, p in out.items()}


def tree_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for t in range(12):
        for m in range(rnd.randint(1, 14)):
            parent = rnd.randrange(m) if m and rnd.random() < 0.9 else rnd.choice((None, 999))
            rows.append((t, m, parent, rnd.choice(("user", "assistant", "sys: x", "")), rnd.choice(NASTY), rnd.choice((None, 0.5, 1.0, -2.0))))
    return rows


@pytest.mark.parametrize("best", [1, 2, None])
def test_paths_are_those_of_a_walk(spark, best):
    rows = tree_rows(1)
    got = {}
    for r in chat.reply_paths(messages(spark, rows), best).collect():
        got.setdefault((r.tree_id, r["rank"], r.leaf_id), []).append((r.depth, r.msg_id))
    want = {(t, k, leaf): list(enumerate(p)) for t, ps in paths(rows).items() for k, (_, leaf, p) in enumerate(ps[:best], 1)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_formatted_chats_read_back(spark):
    rows = tree_rows(2)
    text = {(t, m): (r, x) for t, m, _, r, x, _ in rows}
    done = chat.format_chats(messages(spark, rows), None)
    got = done.select("tree_id", "leaf_id", "n_turns", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {(t, leaf): [text[t, m] for m in p] for t, ps in paths(rows).items() for _, leaf, p in ps}
    assert len(got) == len(want)
    for r in got:
        turns = want[r.tree_id, r.leaf_id]
        assert [tuple(x) for x in r.turns] == turns and r.n_turns == len(turns)
        assert r.loss == "".join(x for role, x in turns if role == "assistant")


def test_chains_cycles_nulls_and_nothing(spark):
    chain = [(1, m, m - 1 if m else None, "user", str(m), 0.0) for m in range(70)]
    cycle = [(2, 0, 1, "user", "x", 0.0), (2, 1, 0, "user", "y", 0.0)]
    nulls = [(None, 5, None, None, None, None), (3, 1, None, "assistant", None, None)]
    done = {r.tree_id: r for r in chat.format_chats(messages(spark, chain + cycle + nulls)).collect()}
    assert set(done) == {1, None, 3} and done[1].n_turns == 70
    assert re.findall(r"### user: (\d+)", done[1].formatted) == [str(k) for k in range(70)]
    assert done[None].formatted == "### :  </turn>\n" and [tuple(s) for s in done[3].loss_spans] == [(15, 0)]
    assert chat.format_chats(messages(spark, [])).count() == 0


def test_repeated_messages_and_missing_ids(spark):
    once = [(1, 0, None, "user", "a", 1.0), (1, 1, 0, "assistant", "b", 0.0), (1, 2, 1, "user", "c", 0.0), (None, 7, None, "user", "n", 0.0)]
    again = [(1, 1, 0, "assistant", "z", 0.0), (1, 1, 2, "assistant", "a", 0.0), (1, 0, None, "user", "a", 1.0), (None, 7, None, "user", "n", 0.0), (1, None, 0, "user", "x", 9.0)]
    want = {tuple(r) for r in chat.format_chats(messages(spark, once), None).drop("loss_spans").collect()}
    assert len(want) == 2
    more = messages(spark, once + again).withColumns({"depth": F.lit(1), "_row": F.lit("x"), "leaf_id": F.lit(0), "_t": F.lit(5)})
    assert {tuple(r) for r in chat.format_chats(more, None).drop("loss_spans").collect()} == want


def test_linear_replies_order_ties(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    (r,) = chat.format_chats(chat.linear_replies(rows)).collect()
    assert re.findall(r": (.) ", r.formatted) == ["a", "a", "b", "c"]


# -- packing


def check_packed(rows, sizes):
    bins = {}
    for r in rows:
        if r.piece_tokens:
            bins.setdefault(r.bin_id, []).append(r)
    for got in bins.values():
        at = 0
        for r in sorted(got, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.piece_tokens
        assert all(r.bin_fill == at and r.bin_size == min(s for s in sizes if s >= at) for r in got)
    return bins


def test_best_fit_is_the_plain_one():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = sorted(rnd.sample(range(5, 60), rnd.randint(1, 4)))
        lengths = [rnd.randint(1, sizes[-1]) for _ in range(rnd.randint(0, 40))]
        where, offset, size_of = packing.best_fit(lengths, sizes, 4)
        rooms, left, plain, since = [], sum(lengths), [0] * len(lengths), []
        for at, i in enumerate(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))):
            n = lengths[i]
            open_ = [b for b in range(len(rooms)) if rooms[b] >= n]
            if not open_:
                rooms.append(min((s for s in sizes if s >= n), key=lambda s: ((s + 4) / min(s, left), s)))
                since.append(at)
                open_ = [len(rooms) - 1]
            b = min(open_, key=lambda b: (rooms[b], -since[b]))  # of equal ones, the one last put into
            since[b] = at
            rooms[b] -= n
            plain[i] = b
            left -= n
        fill = [sum(n for n, w in zip(lengths, where, strict=True) if w == b) for b in range(len(size_of))]
        assert sorted(fill) == sorted(sum(n for n, w in zip(lengths, plain, strict=True) if w == b) for b in range(len(rooms)))
        assert all(f <= s and s == min(x for x in sizes if x >= f) for f, s in zip(fill, size_of, strict=True))


def test_sizes_are_chosen_by_what_fits(spark):
    """The total cost against that of one size, and of the choice by expected tokens alone."""
    sizes, rnd = (512, 1024, 2048, 4096, 8192), random.Random(3)
    for _ in range(50):
        lengths = [rnd.choice([300, 520, 700, 1000, 1900, 2040, 4000, 4097, 5000]) for _ in range(rnd.randint(0, 300))]
        got = packing.cheapest_fit(lengths, sizes)
        fill = [sum(n for n, w in zip(lengths, got[0], strict=True) if w == b) for b in range(len(got[2]))]
        assert all(0 < f <= s for f, s in zip(fill, got[2], strict=True))
        assert all(packing.cost(got, 32) <= packing.cost(packing.best_fit(lengths, *x), 32) for x in ((sizes,), ((8192,),)))
    rows = packing.pack(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x" * 1499).alias("text"))).collect()
    bins = check_packed(rows, sizes)
    total = sum(b[0].bin_size + 32 for b in bins.values())
    assert sum(r.piece_tokens for r in rows) == 300_000
    assert total < packing.cost(packing.best_fit([1500] * 200, sizes), 32) and total <= packing.cost(packing.best_fit([1500] * 200, (8192,)), 32)
    lengths = [700] * 200  # dearer with one size, and with the choice by expected tokens
    assert packing.cost(packing.cheapest_fit(lengths, sizes), 32) < min(packing.cost(packing.best_fit(lengths, x), 32) for x in (sizes, (8192,)))


def test_pack(spark):
    rnd = random.Random(2)
    docs = [(i, "x" * rnd.choice((0, 1, 5, 30, 99, 100, 101, 350))) for i in range(300)] + [(None, None), (7, "é"), (7, "é")]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id bigint, text string, bin_id string, n int")
    sizes = (20, 50, 100)
    rows = packing.pack(frame, sizes, overhead=2, pieces_per_shard=100).collect()
    check_packed(rows, sizes)
    assert sum(r.piece_tokens for r in rows) == sum(len((t or "").encode()) + 1 for _, t in docs)
    assert sum(r.bin_size * r.piece_tokens / r.bin_fill for r in rows) < 1.15 * sum(r.piece_tokens for r in rows)
    assert packing.pack(frame.limit(0), sizes).count() == 0
    lengths = packing.pack(frame.withColumn("k", F.lit(None).cast("int")), sizes, length_col="k").collect()
    assert len(lengths) == len(docs) and all(r.piece_tokens == 0 and r.bin_id is None for r in lengths)
    with pytest.raises(ValueError):
        packing.pack(frame, ())


# -- token counts


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    docs = [(1, "the cat sat", "en", "a"), (2, "the dog", "en", "a"), (3, None, None, "b"), (4, "", "de", None), (2, "the dog", "en", "a")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").withColumn("n_tokens", F.lit("clash"))
    counts = token_counts.count_tokens(frame).cache()
    enc = token_counts.encoder(token_counts.VOCABULARY)
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in docs}
    roll = token_counts.TokenRollup(spark, str(tmp_path / "roll"))
    assert roll.totals().count() == 0 and roll.committed() == set()
    assert roll.commit("b1", token_counts.signed(counts, "v1"))
    first = sorted(map(tuple, roll.totals().collect()), key=repr)
    assert not roll.commit("b1", token_counts.signed(counts, "v1"))
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == first
    assert ("a", "en", "v1", 3, sum(len(enc.encode_ordinary(t)) for t in ("the cat sat", "the dog", "the dog")), 25) in first
    roll.commit("b2", token_counts.signed(counts, "v2"))
    gone = counts.filter("doc_id = 1")
    roll.commit("b3", token_counts.signed(gone, "v1", -1))
    new = counts.filter("doc_id = 2").withColumn("n_tokens", F.lit(100))
    roll.commit("b4", token_counts.revised(counts.filter("doc_id = 2"), new, "v1"))
    totals = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in roll.totals().collect()}
    assert totals["a", "en", "v1"] == (2, 200, 14) and totals["a", "en", "v2"][0] == 3
    roll.compact()
    assert not roll.commit("b3", token_counts.signed(gone, "v1", -1))
    roll.commit("b5", token_counts.signed(counts, "v2", -1))
    after = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in roll.totals().collect()}
    assert after == {k: v for k, v in totals.items() if k[2] == "v1"}
    roll.compact()
    assert roll.committed() == {"b1", "b2", "b3", "b4", "b5"}
    with pytest.raises(ValueError):
        roll.commit("../x", token_counts.signed(counts, "v1"))


def test_a_cut_off_batch_is_written_again(spark, tmp_path):
    counts = token_counts.count_tokens(spark.createDataFrame([(1, "a b", "en", "s")], "doc_id bigint, text string, lang string, source string"))
    roll = token_counts.TokenRollup(spark, str(tmp_path / "roll"))
    roll.commit("b1", token_counts.signed(counts, "v1"))
    (tmp_path / "roll" / "batch=b1" / "_SUCCESS").unlink()
    assert roll.totals().count() == 0
    assert roll.commit("b1", token_counts.signed(counts, "v1")) and roll.totals().first().n_docs == 1


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 7))) for _ in range(400)]

    def text(n=60):
        return " ".join(rnd.choices(words, k=n))

    docs = [(i, text(), "en", "s", 1) for i in range(300)]
    docs = [(i, t + (" zonker quibble zonker" if i % 5 == 0 else ""), *r) for i, t, *r in docs]
    item = text(20)
    docs += [(1000, docs[1][1].upper(), "en", "s", 1), (1001, docs[2][1] + " extra", "en", "s", 1), (1002, text(20) + " " + item, "en", "s", 1), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)] + [(250, None, None)]
    tables = {"documents": (docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "labels": (labels, "doc_id bigint, quality int, toxic int"), "benchmark": ([(1, item), (2, None)], "item_id bigint, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    want, kept = {i for i, *_ in docs}, frame
    for gone, (_, stage) in zip(({i for i in range(300) if i % 5 == 0}, {1, 1003}, {1001}, {1002}), P.STAGES, strict=False):
        kept = stage(spark, kept, str(tmp_path))
        want -= gone
        assert kept.columns == frame.columns
        assert {r.doc_id for r in kept.collect()} == want
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == want
    check_packed(packed, (512, 1024, 2048, 4096, 8192))


def test_turn_digest_of_queries(spark, tmp_path):
    from millrace.llm.queries import op5_chat_format

    rows = [(1, 0, "user", None), (1, 1, "assistant", "a </turn> b"), (2, 0, "system", "s")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, -7}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na </turn> b\n").hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest() and got[-7].n_turns == 2
    assert got[2].loss_chars == 0


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    counts = token_counts.count_tokens(spark.createDataFrame([(1, "a b", "en", "s")], "doc_id bigint, text string, lang string, source string"))
    roll = token_counts.TokenRollup(spark, str(tmp_path / "roll"))
    roll.commit("b1", token_counts.signed(counts, "v1"))
    reader = roll.totals()
    real, late = token_counts.TokenRollup._totals, []

    def between(self, folders, drop_empty):
        if not late:
            late.append(True)
            self.commit("b2", token_counts.signed(counts, "v1"))
        return real(self, folders, drop_empty)

    monkeypatch.setattr(token_counts.TokenRollup, "_totals", between)
    roll.compact()
    monkeypatch.undo()
    assert roll.totals().first().n_docs == 2 and roll.committed() == {"b1", "b2"}
    assert reader.first().n_docs == 1  # listed before the compaction
    for _ in range(3):
        roll.compact()
    assert roll.totals().first().n_docs == 2 and not roll.commit("b1", token_counts.signed(counts, "v1"))
    assert not (tmp_path / "roll" / "batch=b1").exists() and len(list((tmp_path / "roll").glob("base=*"))) == 2


def test_token_totals_of_the_query(spark, tmp_path):
    from millrace.llm.queries import op3_token_counts

    rnd = random.Random(8)
    rows = [(k, rnd.choice((None, "", "the cat", "ÉÉ 日本 🙂", "x" * 9)), rnd.choice((None, "en", "de")), rnd.choice((None, "a"))) for k in range(60)]
    spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    enc, want = token_counts.encoder(token_counts.VOCABULARY), {}
    for _, t, lang, source in [*rows, rows[0]]:
        for name, n in (("byte_bpe_50k", len(enc.encode_ordinary(t or ""))), ("chars", len(t or ""))):
            old = want.get((source, lang, name), (0, 0, 0))
            want[source, lang, name] = (old[0] + 1, old[1] + n, old[2] + len(t or ""))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in op3_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


def test_look_ahead_is_a_plain_greedy_fill():
    rnd = random.Random(4)
    for _ in range(300):
        lengths = sorted((rnd.randint(1, 50) for _ in range(rnd.randint(0, 30))), reverse=True)
        at, room = rnd.randint(0, len(lengths)), rnd.randint(0, 120)
        held, left = 0, room
        for n in lengths[at:]:
            if n <= left:
                held, left = held + n, left - n
        assert packing._Ahead(lengths).fill(at, room) == held


def cheapest_partition(lengths, sizes, price):
    """The least total price of any way to deal the pieces into bins."""
    best = [float("inf")]

    def deal(i, bins, spent):
        if i == len(lengths):
            best[0] = min(best[0], sum(price(min(s for s in sizes if s >= b)) for b in bins))
            return
        for k in range(len(bins) + 1):
            if k == len(bins):
                deal(i + 1, [*bins, lengths[i]], spent)
            elif bins[k] + lengths[i] <= max(sizes):
                deal(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]], spent)

    deal(0, [], 0)
    return best[0]


def test_total_price_against_all_partitions():
    rnd = random.Random(5)
    ratios = []
    for _ in range(150):
        sizes = sorted(rnd.sample(range(5, 60), rnd.randint(1, 4)))
        lengths = [rnd.randint(1, sizes[-1]) for _ in range(rnd.randint(1, 7))]
        overhead, quadratic = rnd.choice(((2, 0), (2, 100), (8, 40)))
        got = packing.cost(packing.cheapest_fit(lengths, sizes, overhead, quadratic), overhead, quadratic)
        want = cheapest_partition(lengths, sizes, lambda s: packing.price(s, overhead, quadratic))
        assert want <= got
        ratios.append(got / want)
    assert max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.02 and sum(r == 1 for r in ratios) > 100


def test_several_sizes_open_and_beat_each_single_one(spark):
    rnd = random.Random(6)
    docs = [(i, "x" * int(rnd.lognormvariate(7, 1.2))) for i in range(800)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    sizes = (512, 1024, 2048, 4096, 8192)
    bins = check_packed(rows, sizes)
    assert len({b[0].bin_size for b in bins.values()}) >= 4
    total = sum(packing.price(b[0].bin_size, 32, 49_152) for b in bins.values())
    pieces = [r.piece_tokens for r in rows]
    assert all(total <= packing.cost(packing.best_fit(pieces, sizes, 32, opens=[s], quadratic=49_152), 32, 49_152) for s in sizes)
    assert total < packing.cost(packing.best_fit(pieces, sizes, 32, opens=[8192], quadratic=49_152), 32, 49_152)


def test_pipeline_of_nothing_and_from_where_it_stopped(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    tables = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    at = str(tmp_path / "run")
    ran = []

    def noted(name, stage, fails):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError(name)
            return stage(spark, docs, sf_dir)

        return name, run

    stages = P.STAGES
    monkeypatch.setattr(P, "STAGES", [noted(n, s, n == "near_dedup") for n, s in stages])
    with pytest.raises(RuntimeError):
        P.run(spark, str(tmp_path), at)
    monkeypatch.setattr(P, "STAGES", [noted(n, s, False) for n, s in stages])
    out = P.run(spark, str(tmp_path), at)
    assert out.count() == 0 and "bin_id" in out.columns
    assert ran == ["toxicity", "exact_dedup", "near_dedup", "near_dedup", "decontamination", "packing"]


def test_entry_adds_the_queries():
    import __spark_entry__

    assert len([q for q in __spark_entry__.queries() if q.startswith("op") and q.split("_")[0][2:].isdigit()]) == 10
    assert "pipeline" in __spark_entry__.queries()
