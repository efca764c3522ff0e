"""Row filters and label statistics over review tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.text import clean_label, clean_text
from reviewlab.session import control_table

MIN_LENGTH = 10
RARE_LABEL = "Neutraal"
RARE_COUNT = 10


def clean_reviews(df: DataFrame) -> DataFrame:
    """Clean both text columns and drop rows without a label (``count_rejected`` counts them)."""
    return (
        df.withColumn("review", clean_text(F.col("review")))
        .withColumn("sentiment", clean_label(F.col("sentiment")))
        .where(F.col("sentiment").isNotNull())
    )


def count_rejected(df: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows without a label per dataset, which ``clean_reviews`` leaves out."""
    return df.groupBy(*by).agg(F.count_if(F.col("sentiment").isNull()).alias("n_rejected"))


def filter_min_length(df: DataFrame, n: int = MIN_LENGTH, col: str = "review") -> DataFrame:
    """Keep texts of more than ``n`` code points; null texts go."""
    return df.where(F.length(col) > n)


def class_counts(df: DataFrame, by: Sequence[str] = ("dataset",), label: str = "sentiment") -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))


def drop_rare_class(
    df: DataFrame,
    rare: str | None = RARE_LABEL,
    min_count: int = RARE_COUNT,
    by: Sequence[str] = ("dataset",),
    label: str = "sentiment",
) -> DataFrame:
    """Drop the class ``rare`` where a dataset has fewer than ``min_count`` rows of it; ``None`` means any class.

    Only the short list of (dataset, class) pairs to drop is joined back, as a broadcast anti join, so the
    reviews themselves are never shuffled, however unevenly the datasets are filled.
    """
    rows = df if rare is None else df.where(F.col(label) == rare)
    doomed = class_counts(rows, by, label).where(F.col("n") < min_count).select(*by, label)
    return df.join(control_table(doomed), [*by, label], "left_anti")


def class_lists(df: DataFrame, by: Sequence[str] = ("dataset",), label: str = "sentiment") -> DataFrame:
    """The distinct labels of each group as one sorted array."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(label)).alias("classes"))


def index_labels(df: DataFrame, by: Sequence[str] = ("dataset",), label: str = "sentiment") -> DataFrame:
    """Add ``label_index``, the position of the label in its group's sorted class list."""
    lists = control_table(class_lists(df, by, label))
    position = (F.array_position("classes", F.col(label)) - 1).cast("int")
    return df.join(lists, list(by)).withColumn("label_index", position)


def decode_labels(df: DataFrame, index: str = "label_index", into: str = "label") -> DataFrame:
    """The inverse of ``index_labels`` on a frame that still has its ``classes`` column."""
    return df.withColumn(into, F.get("classes", F.col(index)))
