"""Seeded stratified splits: exact class quotas, all runs at once, no class ever ranked in one task.

A split is stored as one BIGINT per row, ``train_mask``: bit r is set when the row is in the train part of run r.
Which rows those are is decided by the order of ``md5("<seed>:<id>")`` within a class; the first ``quota`` rows
train. That order statistic needs no sort of the class: a histogram over hash prefixes finds the prefix that holds
the cut, and only the rows under that prefix are ranked. The cut points (one per class and run) are a control
table, so marking the rows is a map-side comparison and the reviews are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.operators.filters import class_counts
from reviewlab.session import control_rows, control_table

RUNS = 10
BASE_SEED = 42
MAX_RUNS = 62
PREFIX_DIGITS = 4


def _parts(fraction: float | str) -> tuple[int, int]:
    share = Fraction(str(fraction))
    return share.numerator, share.denominator


def train_rows_for_test_fraction(n: Column, fraction: float | str) -> Column:
    """Rows left for training when ``ceil(fraction * n)`` rows test."""
    top, bottom = _parts(fraction)
    return (n - F.call_function("div", n * top + (bottom - 1), F.lit(bottom))).cast("bigint")


def train_rows_for_train_fraction(n: Column, fraction: float | str) -> Column:
    top, bottom = _parts(fraction)
    return F.call_function("div", n * top, F.lit(bottom)).cast("bigint")


def train_rows_for_target(n: Column, target: Column, fallback: float | str = "0.9") -> Column:
    """``target`` rows, or the fallback fraction of what there is when the target is not below it."""
    return F.when(target >= n, train_rows_for_train_fraction(n, fallback)).otherwise(target).cast("bigint")


def mix_size(n_base: Column, base_share: float | str = "0.7") -> Column:
    """Partner rows that make base : partner = share : (1 - share); halves round to even."""
    share = Fraction(str(base_share))
    rest = 1 - share
    ratio = float(rest) / float(share)
    return F.bround(n_base.cast("double") * ratio).cast("bigint")


def allocate_quota(counts: DataFrame, by: Sequence[str], label: str = "sentiment") -> DataFrame:
    """Split each group's ``n_train`` over its classes by largest remainder, ties to the first label.

    ``counts`` has one row per group and class with ``n`` (class rows), ``n_group`` and ``n_train``.
    """
    share = F.col("n").cast("decimal(18,0)") * F.col("n_train").cast("decimal(18,0)")
    group = Window.partitionBy(*by)
    return (
        counts.withColumn("floor", F.call_function("div", share, F.col("n_group").cast("decimal(18,0)")).cast("bigint"))
        .withColumn("remainder", (share % F.col("n_group").cast("decimal(18,0)")).cast("bigint"))
        .withColumn("place", F.row_number().over(group.orderBy(F.desc("remainder"), label)))
        .withColumn("spare", F.col("n_train") - F.sum("floor").over(group))
        .withColumn("quota", F.col("floor") + (F.col("place") <= F.col("spare")).cast("bigint"))
        .drop("floor", "remainder", "place", "spare")
    )


def group_sizes(df: DataFrame, by: Sequence[str], label: str = "sentiment") -> DataFrame:
    """Class counts with the group total beside them."""
    return class_counts(df, by, label).withColumn("n_group", F.sum("n").over(Window.partitionBy(*by)))


def _hash(seed: Column, row: Column) -> Column:
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), row.cast("string")))


def with_runs(df: DataFrame, runs: int = RUNS, base_seed: int = BASE_SEED) -> DataFrame:
    """Repeat every row once per run, with the run's seed."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn(
        "seed", F.col("run") + base_seed
    )


def _cut_points(
    keys: DataFrame,
    quotas: DataFrame,
    by: list[str],
    label: str,
    row_id: str,
    runs: int,
    base_seed: int,
) -> DataFrame:
    """The last training row of every class and run, in hash order."""
    strata = [*by, label]
    wanted = quotas.where((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).select(*strata, "n", "quota")
    draws = with_runs(keys, runs, base_seed).withColumn("h", _hash(F.col("seed"), F.col(row_id))).drop("seed")
    prefix = F.substring("h", 1, PREFIX_DIGITS).alias("prefix")
    histogram = draws.groupBy(*strata, "run", prefix).agg(F.count("*").alias("here"))
    upto = Window.partitionBy(*strata, "run").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        histogram.withColumn("upto", F.sum("here").over(upto))
        .join(wanted, strata)
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("here") < F.col("quota")))
        .select(*strata, "run", "prefix", (F.col("quota") - F.col("upto") + F.col("here")).alias("need"))
    )
    near = draws.withColumn("prefix", prefix).join(control_table(cells), [*strata, "run", "prefix"])
    order = Window.partitionBy(*strata, "run").orderBy("h", row_id)
    return (
        near.withColumn("place", F.row_number().over(order))
        .where(F.col("place") == F.col("need"))
        .select(*strata, "run", "h", row_id)
    )


class Split(NamedTuple):
    """A split and what is known of it without another pass over the rows."""

    rows: DataFrame
    quotas: DataFrame
    known: pa.Table | None
    """The quotas' rows on the driver, where they are few enough to be a control table."""


def stratified_split(df: DataFrame, n_train: Column | None = None, **options) -> DataFrame:
    """Add ``train_mask`` to ``df``; see ``split_with_quotas`` for the arguments."""
    return split_with_quotas(df, n_train, **options).rows


def split_with_quotas(
    df: DataFrame,
    n_train: Column | None = None,
    by: Sequence[str] = ("dataset",),
    label: str = "sentiment",
    row_id: str = "row_id",
    runs: int = RUNS,
    base_seed: int = BASE_SEED,
    test_fraction: float | str = "0.3",
    sizes: DataFrame | None = None,
) -> Split:
    """Split every group of ``df`` by class, for all runs.

    ``n_train`` gives the training rows of a group as an expression over ``n_group`` and the ``by`` columns; by
    default it follows from ``test_fraction``. ``sizes`` takes a ``group_sizes`` table that is already there.
    """
    if not 1 <= runs <= MAX_RUNS:
        raise ValueError(f"runs must be between 1 and {MAX_RUNS} (one mask bit each)")
    by = list(by)
    strata = [*by, label]
    if n_train is None:
        n_train = train_rows_for_test_fraction(F.col("n_group"), test_fraction)
    sizes = group_sizes(df, by, label) if sizes is None else sizes
    quotas, rows = control_rows(allocate_quota(sizes.withColumn("n_train", n_train), by, label))
    keys = df.select(*strata, row_id)
    cuts = _cut_points(keys, quotas, by, label, row_id, runs, base_seed)
    cut = [F.max(F.when(F.col("run") == run, F.struct("h", row_id))).alias(f"cut_{run}") for run in range(runs)]
    marks = control_table(
        quotas.select(*strata, "n", "quota").join(cuts.groupBy(*strata).agg(*cut), strata, "left")
    )
    # One plain comparison per run stays inside generated code, which a lambda over an array of cuts would not.
    bits = []
    for run in range(runs):
        place = F.struct(_hash(F.lit(base_seed + run), F.col(row_id)).alias("h"), F.col(row_id))
        bits.append(F.when(place <= F.col(f"cut_{run}"), F.lit(1 << run)).otherwise(F.lit(0)).cast("bigint"))
    mask = (
        F.when(F.col("quota") >= F.col("n"), F.lit((1 << runs) - 1).cast("bigint"))
        .when(F.col("quota") <= 0, F.lit(0).cast("bigint"))
        .otherwise(sum(bits[1:], bits[0]))
    )
    extra = ["n", "quota", *[f"cut_{run}" for run in range(runs)]]
    return Split(df.join(marks, strata).withColumn("train_mask", mask).drop(*extra), quotas, rows)


def in_run(mask: str, run: Column | int) -> Column:
    """Whether the bit of ``run`` is set."""
    shift = F.lit(run) if isinstance(run, int) else run
    return F.call_function("getbit", F.col(mask), shift) == 1


def explode_runs(df: DataFrame, runs: int = RUNS, mask: str = "train_mask") -> DataFrame:
    """One row per run with ``part`` = train or test; the complement of the draw is the test part."""
    spread = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    part = F.when(in_run(mask, F.col("run")), "train").otherwise("test")
    return spread.withColumn("part", part).drop(mask)
