"""Scores of predicted answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import overlap_count


def exact_match(prediction: Column, truth: Column) -> Column:
    """1 if two token arrays are equal, else 0."""
    return F.array_join(prediction, " ").eqNullSafe(F.array_join(truth, " ")).cast("int")


def f1(prediction: Column, truth: Column) -> Column:
    """The harmonic mean of the precision and recall of two token arrays; 0 without a common token."""
    return f1_of(overlap_count(prediction, truth), F.size(prediction), F.size(truth))


def f1_of(common: Column, n_prediction: Column, n_truth: Column) -> Column:
    p, r = common / n_prediction, common / n_truth
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
