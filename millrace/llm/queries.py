"""The queries of this subpackage: each operator, with production parameters, on its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_extract, langid, near_dedup, packing, pii, token_counts, toxicity
from .common import cut, held_out, scratch, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.train(html_extract.labelled_pages())
    text = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return text.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all kinds of commits.

    Estimates of all documents, the same batch again, their revision to real counts, counts of characters, and a tokenizer version
    whose documents are all deleted again, so that it has no group in the end.
    """
    counts = cut(token_counts.count_tokens(table(spark, sf_dir, "documents")))
    rollup = token_counts.TokenRollup(spark, scratch(spark, "token-rollup"))
    guess = counts.withColumn("n_tokens", F.ceil(F.col("n_chars") / 4))
    rollup.commit("0001-estimates", token_counts.signed(guess, "byte_bpe_50k"))
    rollup.commit("0001-estimates", token_counts.signed(guess, "byte_bpe_50k"))
    rollup.commit("0002-counts", token_counts.revised(guess, counts, "byte_bpe_50k"))
    rollup.commit("0003-chars", token_counts.signed(counts, "chars", tokens="n_chars"))
    rollup.commit("0004-halves", token_counts.signed(counts, "halves", tokens=F.ceil(F.col("n_chars") / 2)))
    rollup.commit("0005-retired", token_counts.signed(counts, "halves", -1, tokens=F.ceil(F.col("n_chars") / 2)))
    return rollup.totals()


def _span_text(col: str) -> Column:
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, all spans, and how many of these the method added."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def n_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    added = (F.size("spans") - F.size("base")).cast("bigint").alias("n_added")
    return found.select("doc_id", *map(n_of, pii.KINDS), F.sha2(_span_text("base"), 256).alias("base_sha256"), _span_text("spans").alias("spans"), added)


#: A conversation whose texts hold what the template uses.
_TRAP = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRAP).alias("text"))
    done = chat.format_chats(chat.linear_replies(rows.unionByName(trap)))
    said = F.array_join(F.transform(chat.parse_chat(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select(
        F.col("tree_id").alias("conv_id"), F.size(chat.parse_chat(F.col("formatted"))).cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.NearDuplicates().components(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def learned_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """The lexicon from the labelled documents that may teach."""
    return toxicity.fit_lexicon(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.toxicity(docs, learned_lexicon(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_decontaminate, op2_html_extract, op3_token_counts, op4_personal_data, op5_chat_format, op6_near_dedup, op7_exact_dedup, op8_language_id, op9_toxicity, op10_packing)
    return {f.__name__: f for f in own}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, s)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
        "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(esc) + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
        "op6_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM (SELECT * FROM g SEMI JOIN h USING (s)) x
  JOIN (SELECT * FROM g SEMI JOIN h USING (s)) y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 75 * (na.n + nb.n - both_)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id""",
        "op7_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    }


