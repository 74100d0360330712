"""Chat formatting of reply trees. DataFrame operations only.

Messages form trees by parent. Root-to-leaf paths are enumerated by iterative self-joins, the branches of a tree are ranked by
score and each chosen path is written as one conversation, with the places that the loss covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Marks of the template: a turn is HEAD role COLON text TAIL.
HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """Puts a backslash before each backslash, ``###`` and ``</turn>`` of the text; ``unescape`` takes it away again."""
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>|:)", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ":", r"\\:")


def linear_replies(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Turn tables as reply trees: each row's parent is the one before it by turn. Rows of equal turn are ordered by role, then text."""
    order = W.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    out = rows.select(F.col(conv_col).alias("tree_id"), "role", "text", F.row_number().over(order).cast("bigint").alias("msg_id"))
    return out.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _each_once(messages: DataFrame, *payload: str) -> DataFrame:
    """``tree_id, msg_id`` and ``parent_id, score, *payload`` of the smallest of the rows that repeat a message, by these columns in turn."""
    values = F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), *payload)
    return messages.groupBy("tree_id", "msg_id").agg(F.min(values).alias("_row")).select("tree_id", "msg_id", "_row.*")


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """``tree_id, leaf_id, rank, depth, msg_id``: the messages of each root-to-leaf path that ranks up to ``best`` in its tree.

    A path's score is the sum of its messages' scores; ties go to the smaller leaf id. ``best`` None keeps all paths. A null
    score counts as 0. A message whose parent is not in the table is a root. Messages on a cycle have no root and are left out, and
    so are those without a msg_id. Rows that repeat a tree_id and msg_id are one message, the smallest by parent_id, then score, nulls first; a
    null tree_id is one tree. Other columns are not looked at. An empty table gives an empty table.
    """
    m = _each_once(messages)
    known = m.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_p")).distinct()
    m = m.join(known, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("parent_id") == F.col("_p")), "left")
    m = cut(m.select("tree_id", "msg_id", F.col("_p").alias("parent_id"), "score"))
    inner = m.filter("parent_id is not null").select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_m")).distinct()
    leaves = m.join(inner, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("msg_id") == F.col("_m")), "left_anti")

    # Step 1: each message's distance to its root and its path's score, by pointer doubling: after n joins 2^n levels are known.
    up = m.select("tree_id", "msg_id", F.col("parent_id").alias("to"), "score", F.lit(0).cast("bigint").alias("depth"))
    up = cut(up.withColumn("depth", F.when(F.col("to").isNotNull(), F.lit(1)).otherwise(0).cast("bigint")))
    last = None
    while (open_now := up.filter("to is not null").count()) and open_now != last:
        last = open_now
        # Only what has not come to its root is joined again, so one long path costs no more than its own rows.
        nxt = up.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.col("to").alias("_to"), F.col("score").alias("_s"), F.col("depth").alias("_d"))
        more = up.filter("to is not null").join(nxt, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("to") == F.col("_m"))).select(
            "tree_id", "msg_id", F.col("_to").alias("to"), (F.col("score") + F.col("_s")).alias("score"), (F.col("depth") + F.col("_d")).alias("depth")
        )
        up = cut(up.filter("to is null").unionByName(more))
    rooted = up.filter("to is null").select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.col("score").alias("total"), "depth")

    # Step 2: rank each tree's leaves.
    ranked = leaves.join(rooted, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("msg_id") == F.col("_m"))).select("tree_id", F.col("msg_id").alias("leaf_id"), "total", "depth")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("tree_id").orderBy(F.desc("total"), "leaf_id")))
    ranked = ranked if best is None else ranked.filter(F.col("rank") <= best)

    # Step 3: walk the chosen paths to their roots. Levels double here too: with hops of 1, 2, 4 ... a path of n messages takes
    # log2(n) joins.
    paths = cut(ranked.select("tree_id", "leaf_id", "rank", F.col("leaf_id").alias("msg_id"), "depth"))
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    hops = m.filter("parent_id is not null").select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.col("parent_id").alias("_to"))
    hop, table = 1, [hops]
    while hop * 2 <= deepest:
        far = hops.select(F.col("_t").alias("_t2"), F.col("_m").alias("_m2"), F.col("_to").alias("_to2"))
        hops = cut(hops.join(far, F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_to") == F.col("_m2"))).select("_t", "_m", F.col("_to2").alias("_to")))
        table.append(hops)
        hop *= 2
    for n, hops in reversed(list(enumerate(table))):
        if 2**n <= deepest:
            more = paths.join(hops, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("msg_id") == F.col("_m")))
            more = more.select("tree_id", "leaf_id", "rank", F.col("_to").alias("msg_id"), (F.col("depth") - 2**n).alias("depth"))
            paths = cut(paths.unionByName(more))  # else the plan would double with each level
    return paths


def format_chats(messages: DataFrame, best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree_id, leaf_id, rank, n_turns, formatted, loss_spans``.

    ``loss_spans`` holds start and length, in code points of ``formatted``, of each text of ``loss_role``. Null texts and roles
    are empty. Of rows that repeat a message the one that ``reply_paths`` takes is said, of equal ones that with the smallest role,
    then text. Other columns are not looked at. An empty table gives an empty table.
    """
    paths = reply_paths(messages, best)
    said = _each_once(messages, "role", "text")
    said = said.select(F.col("tree_id").alias("_t"), F.col("msg_id").alias("_m"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("msg_id") == F.col("_m")))
    head = F.concat(F.lit(HEAD), _escape_role(F.col("role")), F.lit(COLON))
    turn = F.struct("depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss"))
    per = turns.groupBy("tree_id", "leaf_id", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start, length = a["at"] + F.char_length(t["head"]), F.char_length(t["body"]).cast("bigint")
        one = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(TAIL)).alias("at"), F.when(t["loss"], F.concat(a["spans"], one)).otherwise(a["spans"]).alias("spans"))

    return per.select(
        "tree_id",
        "leaf_id",
        "rank",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda a: a["spans"]).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """Reads a formatted conversation back: an array of ``role, text``."""
    parts = F.filter(F.split(formatted, " </turn>\n"), lambda t: t != "")
    # In a text, </turn> always follows a backslash, never the blank of a turn's end. A role's colons are escaped too.
    pattern = r"(?s)\A### ((?:\\.|[^\\:])*): (.*)\z"
    return F.transform(parts, lambda t: F.struct(unescape(F.regexp_extract(t, pattern, 1)).alias("role"), unescape(F.regexp_extract(t, pattern, 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
