"""Scores of predictions against answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import exact_match, f1
from ..functions.text import answer_tokens


def score(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, exact_match, f1) for each question (id, answers: array of strings): the best over its answers.

    A question without a prediction (id, prediction) scores 0 and counts; of repeated predictions the smallest text is taken.
    """
    one = predictions.groupBy(F.col("id").alias("p_id")).agg(F.min("prediction").alias("prediction"))
    rows = questions.join(one, questions["id"] == one["p_id"], "left").withColumn("_p", answer_tokens(F.col("prediction")))
    truths = F.transform("answers", answer_tokens)
    best = lambda of: F.coalesce(F.array_max(F.transform(truths, lambda t: of(F.col("_p"), t))), F.lit(0))
    missing = F.col("prediction").isNull()
    return rows.select("id", F.when(missing, 0).otherwise(best(exact_match)).alias("exact_match"), F.when(missing, 0.0).otherwise(best(f1)).alias("f1"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: the number of questions and the means in per cent."""
    mean = lambda c: F.coalesce(100.0 * F.sum(c) / F.count(F.lit(1)), F.lit(0.0))
    return scores.agg(F.count(F.lit(1)).alias("total"), mean("exact_match").alias("exact_match"), mean("f1").alias("f1"))
