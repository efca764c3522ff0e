"""The folds of an experiment: masked rows together with the training class counts that the split already knows."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.operators.sampling import BASE_SEED, RUNS
from reviewlab.operators.weights import balanced_weights, model_classes, train_class_counts
from reviewlab.session import control_rows, durable


@dataclass(frozen=True)
class Folds:
    """``rows`` has model_set, eval_set, row_id, label, train_mask, test_mask and the features.

    ``train_counts`` has the training rows per (model_set, run, label). A split fixes them before any row is drawn,
    so class lists and weights need no scan of the rows.
    """

    rows: DataFrame
    train_counts: DataFrame
    small: bool
    runs: int = RUNS
    base_seed: int = BASE_SEED

    @staticmethod
    def of(rows: DataFrame, runs: int = RUNS, base_seed: int = BASE_SEED) -> Folds:
        """Folds of rows whose masks come from elsewhere; counts them in one pass."""
        counts, known = control_rows(train_class_counts(rows, runs=runs))
        return Folds(rows, counts, known is not None, runs, base_seed)

    @staticmethod
    def of_quotas(
        rows: DataFrame, quotas: DataFrame, known: pa.Table | None, runs: int = RUNS, base_seed: int = BASE_SEED
    ) -> Folds:
        """Folds of a split: every run trains on ``quota`` rows of a class."""
        per_run = quotas.where(F.col("quota") > 0).select(
            "model_set", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "label", F.col("quota").alias("n")
        )
        return Folds(rows, per_run, known is not None, runs, base_seed)

    def _hinted(self, derived: DataFrame) -> DataFrame:
        """What follows from the counts is no larger than they are, so it is broadcast if they are a control table."""
        return F.broadcast(derived) if self.small else derived

    @property
    def classes(self) -> DataFrame:
        """The sorted class list of every model: (model_set, run, classes)."""
        return self._hinted(model_classes(self.train_counts))

    @property
    def weights(self) -> DataFrame:
        """The balanced class weights of every model: (model_set, run, label, n, weight)."""
        return self._hinted(balanced_weights(self.train_counts))

    def stored(self) -> Folds:
        """The same folds on a written table, for models that read them many times.

        It is partitioned by model set: a fit reads its own set's files and columns only.
        """
        return replace(self, rows=durable(self.rows, ["model_set"]))
