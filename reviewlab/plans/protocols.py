"""The four experiment protocols, from labelled points to run metrics and tests.

Every protocol is a rule for how many rows of each dataset train; the rest of each dataset tests. All runs share one
pass: a row carries the set of runs it trains in as ``train_mask`` and the set it is tested in as ``test_mask``.

========  ============  ===============================================  ==========================
protocol  model sets    training rows                                    tests
========  ============  ===============================================  ==========================
transfer  the base      70 % of the base                                 none
fraction  per external  70 % of the base and 20 % of the external        none
mix       per external  70 % of the base, externals matched to 70 : 30   paired, base vs external
own       per dataset   70 % of the dataset                              Welch, over dataset pairs
========  ============  ===============================================  ==========================
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.scores import positive_score
from reviewlab.operators.comparison import paired_t, run_summary, welch_t
from reviewlab.operators.folds import Folds
from reviewlab.operators.metrics import accuracy, run_metrics
from reviewlab.operators.neighbors import class_shares, nearest_neighbors
from reviewlab.operators.sampling import (
    BASE_SEED,
    RUNS,
    group_sizes,
    mix_size,
    split_with_quotas,
    train_rows_for_target,
    train_rows_for_test_fraction,
)
from reviewlab.session import control_rows, durable

PROTOCOLS = ("transfer", "fraction", "mix", "own")


class Model(Protocol):
    """What a protocol needs of a model: fit on the train bits, score the test bits, of every set and run."""

    name: str

    def score(self, folds: Folds) -> DataFrame: ...


@dataclass(frozen=True)
class Knn:
    """k nearest neighbours; ``weights`` is ``uniform`` or ``distance``."""

    k: int = 5
    weights: str = "uniform"
    name: str = "KNN"

    def score(self, folds: Folds) -> DataFrame:
        shares = class_shares(nearest_neighbors(folds.rows, self.k, folds.runs), folds.classes, self.weights)
        score = F.when(F.size("classes") == 2, positive_score(F.col("shares")))
        return shares.withColumn("score", score).drop("shares", "classes")


def make_folds(
    points: DataFrame,
    protocol: str,
    base: str | None = None,
    runs: int = RUNS,
    base_seed: int = BASE_SEED,
    test_fraction: str = "0.3",
    external_test_fraction: str = "0.8",
    base_share: str = "0.7",
    fallback: str = "0.9",
) -> Folds:
    """Add model_set, eval_set, train_mask and test_mask to ``points`` (dataset, row_id, label, ...).

    Base rows are repeated once per external where each external has a model of its own.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"protocol must be one of {PROTOCOLS}, not {protocol!r}")
    if (base is None) != (protocol == "own"):
        raise ValueError("every protocol but 'own' needs the name of the base dataset, and 'own' takes none")
    sizes, known = group_sizes(points, ["dataset"], "label"), None
    if protocol in ("mix", "fraction"):
        sizes, known = control_rows(sizes)
    n, is_base = F.col("n_group"), F.col("dataset") == F.lit(base)
    n_train = train_rows_for_test_fraction(n, test_fraction)
    if protocol == "transfer":
        n_train = F.when(is_base, n_train).otherwise(F.lit(0).cast("bigint"))
    elif protocol == "fraction":
        n_train = F.when(is_base, n_train).otherwise(train_rows_for_test_fraction(n, external_test_fraction))
    elif protocol == "mix":
        base_rows = sizes.where(is_base).select(n_train).first()
        target = mix_size(F.lit(base_rows[0] if base_rows else 0), base_share)
        n_train = F.when(is_base, n_train).otherwise(train_rows_for_target(n, target, fallback))
    rows, quotas, quota_rows = split_with_quotas(
        points, n_train, by=["dataset"], label="label", runs=runs, base_seed=base_seed, sizes=sizes
    )
    all_runs = F.lit((1 << runs) - 1).cast("bigint")
    rows = rows.withColumn("test_mask", all_runs.bitwiseXOR(F.col("train_mask")))
    if protocol == "own":
        model_sets = F.array("dataset")
    elif protocol == "transfer":
        model_sets = F.array(F.lit(base))
    elif known is None:
        raise ValueError("too many datasets for one model each")
    else:
        externals = sorted(set(known["dataset"].to_pylist()) - {base})
        model_sets = F.when(is_base, F.array(*[F.lit(name) for name in externals])).otherwise(F.array("dataset"))
    rows, quotas = (frame.withColumn("model_set", F.explode(model_sets)) for frame in (rows, quotas))
    return Folds.of_quotas(rows.withColumnRenamed("dataset", "eval_set"), _summed(quotas), quota_rows, runs, base_seed)


def _summed(quotas: DataFrame) -> DataFrame:
    """Quotas per model set, over the datasets it trains on."""
    return quotas.groupBy("model_set", "label").agg(F.sum("quota").alias("quota"))


def score_protocol(
    points: DataFrame,
    protocol: str,
    models: Sequence[Model],
    base: str | None = None,
    runs: int = RUNS,
    base_seed: int = BASE_SEED,
    store: bool = True,
    **fold_options: str,
) -> tuple[DataFrame, DataFrame]:
    """Fit and score every model; return the scored rows (written out, as several metrics read them) and classes.

    ``store=False`` leaves the folds unwritten, which saves a copy where ``points`` is a plain scan of stored vectors
    and the models read it once or twice.
    """
    folds = make_folds(points, protocol, base, runs, base_seed, **fold_options)
    folds = folds.stored() if store else folds
    scored = None
    for model in models:
        part = model.score(folds).select(
            F.lit(protocol).alias("protocol"),
            F.lit(model.name).alias("model"),
            "model_set",
            "eval_set",
            "run",
            "row_id",
            "y",
            "yhat",
            "score",
        )
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("give at least one model")
    return durable(scored), folds.classes


def accuracy_metrics(scored: DataFrame) -> DataFrame:
    """The accuracy rows of the metric table."""
    facts = accuracy(scored)
    return facts.select(
        *[key for key in facts.columns if key not in ("accuracy", "n")],
        F.lit("accuracy").alias("metric"),
        F.col("accuracy").alias("value"),
    )


def transfer_eval(points: DataFrame, base: str, models: Sequence[Model], runs: int = RUNS, **options) -> DataFrame:
    """Train on the base only; metrics on its test part and on every external dataset as a whole."""
    scored, classes = score_protocol(points, "transfer", models, base, runs, **options)
    return run_metrics(scored, classes)


def retrain_eval(
    points: DataFrame,
    base: str,
    models: Sequence[Model],
    runs: int = RUNS,
    mix: bool = True,
    **options,
) -> tuple[DataFrame, DataFrame | None]:
    """Retrain with part of each external; run metrics and, for the 70:30 mix, the paired tests on accuracy."""
    scored, classes = score_protocol(points, "mix" if mix else "fraction", models, base, runs, **options)
    metrics = run_metrics(scored, classes)
    if not mix:
        return metrics, None
    return metrics, paired_t(metrics.where(F.col("metric") == "accuracy"), base)


def own_train_eval(
    points: DataFrame,
    models: Sequence[Model],
    pairs: Sequence[tuple[str, str]],
    runs: int = RUNS,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and test within each dataset: run metrics, their summary and the Welch tests on accuracy."""
    scored, classes = score_protocol(points, "own", models, None, runs, **options)
    metrics = run_metrics(scored, classes)
    return metrics, run_summary(metrics), welch_t(metrics.where(F.col("metric") == "accuracy"), pairs)
