"""Expressions over class scores; class lists are always in alphabetical order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits, shifted by its maximum so that no exponential overflows."""
    powers = F.transform(logits, lambda z: F.exp(z.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(powers, lambda e: e / total)


def argmax_label(scores: Column, classes: Column) -> Column:
    """The class with the highest score; a tie goes to the class that comes first."""
    return F.get(classes, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def binarise(label: Column, classes: Column) -> Column:
    """1 for the second class, 0 for the first, null where the classes are not exactly two."""
    return F.when(F.size(classes) == 2, (label == F.get(classes, F.lit(1))).cast("int"))


def positive_score(scores: Column) -> Column:
    """The score of the second class."""
    return F.get(scores, F.lit(1))
