"""Queries on answers: token F1, exact match, normalisation, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import overlap_count
from ..functions.metrics import f1
from ..operators import evaluate, nest
from .tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as predictions of the turn after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("truth"))
    return rows.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prediction"), "truth")


def qa_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).where("truth is not null").select("id", T.answer_tokens(F.col("prediction")).alias("p"), T.answer_tokens(F.col("truth")).alias("t"))
    return rows.select("id", overlap_count(F.col("p"), F.col("t")).alias("common"), F.round(f1(F.col("p"), F.col("t")), 6).alias("f1"))


def qa_exact_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    questions = rows.select("id", F.array_compact(F.array("truth", F.when(F.col("id").endswith("0"), F.col("prediction")))).alias("answers"))
    scores = evaluate.score(questions, rows.where(~F.col("id").endswith("3")).select("id", "prediction"))
    return evaluate.summary(scores).select("total", F.round("exact_match", 4).alias("exact_match"), F.round("f1", 4).alias("f1"))


def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalized_answer(F.col("text")).alias("answer"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a corpus: conversation = article, role = context, turn = question."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("conv_id").cast("string").alias("title"), F.col("role").alias("context"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.col("text").alias("answer"), F.lit(0).alias("answer_start"))


def nest_unnest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nest.nest(_corpus(spark, sf_dir))
    flat = nested.select("title", F.posexplode("paragraphs").alias("para_ix", "p")).select("title", "para_ix", "p.context", F.posexplode("p.qas").alias("qa_ix", "q"))
    return flat.select("title", "para_ix", "context", "qa_ix", "q.question", F.size("q.answers").alias("n_answers"))


def global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return nest.numbered(rows, ["conv_id", "turn"], 1_000_001).select("conv_id", "turn", F.col("new_id").cast("long").alias("new_id"))


def distinct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("answer"))
    return nest.distinct_answers(rows, ["conv_id"], "answer", "turn")


def version_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("title"), F.col("role").alias("context"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), "turn")
    old = c.where("turn % 3 <> 0").select("title", "context", "id", "question", F.lit(None).cast("boolean").alias("is_impossible"))
    new = c.where("turn % 2 = 0").select("title", "context", "id", F.concat(F.lit("!"), "question").alias("question"), (F.col("turn") == 4).alias("is_impossible"))
    merged = nest.merge_versions(old, new)
    return merged.select("title", "context", "id", F.length("question").alias("n"), F.coalesce("is_impossible", F.lit(False)).alias("is_impossible"), F.col("question").startswith("!").alias("newer"))


def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "turn")
    return nest.version_counts(c.where("turn % 3 <> 0"), c.where("turn % 2 = 0").select("id", (F.col("turn") == 6).alias("is_impossible")))


_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
_TURNS = "SELECT conv_id || '-' || turn AS id, text AS prediction, truth FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS truth FROM conversations) WHERE role = 'assistant'"
_OVERLAP = "coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(t_, lambda y: y = t))))), 0)"

QUERIES = {f.__name__: f for f in (qa_token_f1, qa_exact_match_summary, answer_normalize, nest_unnest_roundtrip, global_ids, distinct_answers, version_merge, version_counts)}
ORACLE = {
    "qa_token_f1": f"""
WITH turns AS ({_TURNS}), toks AS (SELECT id, {_TOKENS.format('prediction')} AS p, {_TOKENS.format('truth')} AS t_ FROM turns WHERE truth IS NOT NULL),
c AS (SELECT id, p, t_, CAST({_OVERLAP} AS INT) AS common FROM toks)
SELECT id, common, round(CASE WHEN common > 0 THEN 2 * (common / len(p)) * (common / len(t_)) / (common / len(p) + common / len(t_)) ELSE 0.0 END, 6) AS f1 FROM c""",
    "qa_exact_match_summary": f"""
WITH turns AS ({_TURNS}),
pairs AS (
  SELECT id, prediction, truth AS answer FROM turns UNION ALL SELECT id, prediction, CASE WHEN id LIKE '%0' THEN prediction END FROM turns
), toks AS (SELECT id, answer, {_TOKENS.format('prediction')} AS p, {_TOKENS.format('answer')} AS t_ FROM pairs WHERE answer IS NOT NULL AND id NOT LIKE '%3'),
c AS (SELECT *, {_OVERLAP} AS common FROM toks),
s AS (SELECT id, max(CASE WHEN p = t_ THEN 1 ELSE 0 END) AS em, max(CASE WHEN common > 0 THEN 2 * (common / len(p)) * (common / len(t_)) / (common / len(p) + common / len(t_)) ELSE 0.0 END) AS f1 FROM c GROUP BY id)
SELECT count(*) AS total, round(100.0 * sum(coalesce(em, 0)) / count(*), 4) AS exact_match, round(100.0 * sum(coalesce(f1, 0)) / count(*), 4) AS f1 FROM turns LEFT JOIN s USING (id)""",
    "answer_normalize": f"SELECT conv_id, turn, array_to_string({_TOKENS.format('text')}, ' ') AS answer FROM conversations",
    "nest_unnest_roundtrip": """
WITH c AS (SELECT conv_id * 1000 + turn AS o, CAST(conv_id AS VARCHAR) AS title, role AS context, text AS question FROM conversations),
q AS (SELECT title, context, question, min(o) AS o, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT title, context, min(o) AS po FROM q GROUP BY ALL)
SELECT title, CAST(dense_rank() OVER (PARTITION BY title ORDER BY po) - 1 AS INT) AS para_ix, context, CAST(row_number() OVER (PARTITION BY title, context ORDER BY o) - 1 AS INT) AS qa_ix, question, CAST(n AS INT) AS n_answers
FROM q JOIN p USING (title, context)""",
    "global_ids": "SELECT conv_id, turn, 1000000 + row_number() OVER (ORDER BY conv_id, turn) AS new_id FROM conversations",
    "distinct_answers": "SELECT conv_id, min(turn) AS turn, lower(text) AS answer FROM conversations GROUP BY conv_id, lower(text)",
    "version_merge": """
SELECT CAST(conv_id AS VARCHAR) AS title, role AS context, conv_id || '-' || turn AS id, CAST(length(q) AS INT) AS n, turn % 2 = 0 AND turn = 4 AS is_impossible, starts_with(q, '!') AS newer
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN '!' || text ELSE text END AS q FROM conversations WHERE turn % 2 = 0 OR turn % 3 <> 0)""",
    "version_counts": """
SELECT count(*) AS total, count(*) FILTER (turn % 2 = 0 AND turn % 3 <> 0) AS common, count(*) FILTER (turn % 3 = 0 AND turn <> 6) AS new_possible, count(*) FILTER (turn % 3 = 0 AND turn = 6) AS new_impossible
FROM conversations WHERE turn % 2 = 0 OR turn % 3 <> 0""",
}
