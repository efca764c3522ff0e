"""Training class counts, balanced class weights and class lists, for all runs in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.operators.sampling import RUNS, in_run


def train_class_counts(
    points: DataFrame,
    by: Sequence[str] = ("model_set",),
    label: str = "label",
    runs: int = RUNS,
    mask: str = "train_mask",
) -> DataFrame:
    """Training rows per group, run and class. Counts all runs side by side instead of repeating the rows."""
    per_run = [F.count_if(in_run(mask, run)).alias(f"run_{run}") for run in range(runs)]
    wide = points.groupBy(*by, label).agg(*per_run)
    pairs = F.array(*[F.struct(F.lit(run).alias("run"), F.col(f"run_{run}").alias("n")) for run in range(runs)])
    return (
        wide.select(*by, label, F.explode(pairs).alias("pair"))
        .select(*by, "pair.run", label, "pair.n")
        .where(F.col("n") > 0)
    )


def balanced_weights(counts: DataFrame, by: Sequence[str] = ("model_set", "run")) -> DataFrame:
    """``weight`` = n / (number of classes * class rows); summed over the rows the weights give n again."""
    group = Window.partitionBy(*by)
    total = F.sum("n").over(group) / (F.count("*").over(group) * F.col("n"))
    return counts.withColumn("weight", total)


def model_classes(counts: DataFrame, by: Sequence[str] = ("model_set", "run"), label: str = "label") -> DataFrame:
    """The sorted class list a model knows, per group."""
    return counts.groupBy(*by).agg(F.array_sort(F.collect_set(label)).alias("classes"))


def with_weights(rows: DataFrame, weights: DataFrame, on: Sequence[str] = ("model_set", "run", "label")) -> DataFrame:
    """Attach its class weight to every training row."""
    return rows.join(weights.select(*on, "weight"), list(on))
