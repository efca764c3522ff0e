"""Evaluation of scored rows: accuracy, confusion matrices, per-class reports, ROC-AUC.

A scored frame has one row per evaluated row: the key columns present from ``KEYS``, ``row_id``, ``y`` (true label),
``yhat`` (predicted label) and ``score`` (probability of the model's second class). Every operator first reduces it
to (key, y, yhat) counts or (key, score) counts with map-side partial aggregation; what follows works on the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.session import durable

KEYS = ("protocol", "model", "model_set", "eval_set", "run")


def keys_of(df: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    return list(keys) if keys is not None else [key for key in KEYS if key in df.columns]


def label_counts(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows per key, true label and predicted label."""
    return scored.groupBy(*keys_of(scored, keys), "y", "yhat").agg(F.count("*").alias("n"))


def accuracy(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    matched = (F.col("y") == F.col("yhat")).cast("double")
    return scored.groupBy(*keys_of(scored, keys)).agg(F.avg(matched).alias("accuracy"), F.count("*").alias("n"))


def _with_classes(df: DataFrame, classes: DataFrame | Sequence[str]) -> DataFrame:
    """Attach the model's class list: one list for all rows, or a table that shares key columns with ``df``."""
    if not isinstance(classes, DataFrame):
        return df.withColumn("classes", F.array(*[F.lit(name) for name in sorted(classes)]))
    return df.join(classes, [key for key in classes.columns if key in df.columns and key != "classes"])


def shared_labels(counts: DataFrame, classes: DataFrame | Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key: the labels that both the test rows and the model have, and the counts as an array of ``cells``."""
    seen = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_set("y")).alias("test_labels"),
        F.collect_list(F.struct("y", "yhat", "n")).alias("cells"),
    )
    joined = _with_classes(seen, classes)
    return joined.withColumn("labels", F.array_sort(F.array_intersect("test_labels", "classes")))


def confusion_matrix(
    scored: DataFrame,
    classes: DataFrame | Sequence[str],
    restrict: bool = False,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Long confusion matrix (key, y, yhat, n) with its zero cells.

    The labels are the model's classes; with ``restrict`` only those that the test rows have too. Then a row counts
    only if both its labels are left, and a key without any label in common gets one row with ``note``.

    The counts travel with the label lists, so the scored rows are read once.
    """
    keys = keys_of(scored, keys)
    lists = shared_labels(label_counts(scored, keys), classes, keys)
    grid = (
        lists.select(*keys, "cells", F.col("labels" if restrict else "classes").alias("axis"))
        .withColumn("y", F.explode_outer("axis"))
        .withColumn("yhat", F.explode_outer("axis"))
    )
    here = F.filter("cells", lambda c: (c["y"] == F.col("y")) & (c["yhat"] == F.col("yhat")))
    n = F.when(F.col("y").isNotNull(), F.aggregate(here, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"]))
    note = F.when(F.col("y").isNull(), F.lit("no labels in common"))
    return grid.select(*keys, "y", "yhat", n.alias("n"), note.alias("note"))


def confusion_wide(matrix: DataFrame, labels: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """One row per true label with a column per predicted label."""
    keys = keys_of(matrix, keys)
    return matrix.where(F.col("y").isNotNull()).groupBy(*keys, "y").pivot("yhat", list(labels)).agg(F.first("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_scores(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, over the union of true and predicted labels.

    A zero denominator gives 0.
    """
    keys = keys_of(scored, keys)
    counts = label_counts(scored, keys)
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("yhat").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when((F.col("y") == F.col("yhat")) & (F.col("side.support") > 0), F.col("n")).otherwise(0)
    totals = (
        counts.withColumn("side", F.explode(sides))
        .groupBy(*keys, "side.class")
        .agg(
            F.sum(hit).alias("hit"),
            F.sum("side.predicted").alias("predicted"),
            F.sum("side.support").alias("support"),
        )
    )
    precision = _ratio(F.col("hit"), F.col("predicted"))
    recall = _ratio(F.col("hit"), F.col("support"))
    f1 = _ratio(2 * F.col("hit"), F.col("predicted") + F.col("support"))
    return totals.select(
        *keys, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit"
    )


REPORT_AVERAGES = ("accuracy", "macro avg", "weighted avg")


def classification_report(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Per-class rows followed by ``accuracy``, ``macro avg`` and ``weighted avg`` rows (``place`` orders them)."""
    keys = keys_of(scored, keys)
    rows = class_scores(scored, keys)
    weighted = {c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in ("precision", "recall", "f1")}
    overall = rows.groupBy(*keys).agg(
        _ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in weighted],
        *[value.alias(f"weighted_{c}") for c, value in weighted.items()],
        F.sum("support").alias("support"),
    )
    nothing = F.lit(None).cast("double")

    def line(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(REPORT_AVERAGES.index(name) + 1).alias("place"),
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
        )

    lines = F.array(
        line("accuracy", nothing, nothing, F.col("accuracy")),
        line("macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")),
        line("weighted avg", F.col("weighted_precision"), F.col("weighted_recall"), F.col("weighted_f1")),
    )
    averages = overall.select(*keys, F.explode(lines).alias("line"), "support").select(*keys, "line.*", "support")
    per_class = rows.drop("hit").withColumn("place", F.lit(0))
    return per_class.unionByName(averages)


def auc_ready(scored: DataFrame, classes: DataFrame | Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Keys that get an AUC: the model has exactly two classes and knows every label of the test rows."""
    keys = keys_of(scored, keys)
    lists = shared_labels(label_counts(scored, keys), classes, keys)
    fits = F.size(F.array_except("test_labels", "classes")) == 0
    return lists.where((F.size("classes") == 2) & fits).select(*keys, F.get("classes", F.lit(1)).alias("positive"))


def roc_auc(
    scored: DataFrame, classes: DataFrame | Sequence[str], keys: Sequence[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Area under the ROC curve, ties at half weight; null where the test rows are all of one class.

    Rows collapse to counts per distinct score, which are range-partitioned by key and score, so that no task holds a whole
    key. A task runs through its sorted counts and gives a few numbers per key and stretch; the running count of negatives
    is then taken over the stretches of a key. The counts are written out, as the ranges and the area both read them.
    """
    keys = keys_of(scored, keys)
    known = _with_classes(scored, classes).where((F.size("classes") == 2) & F.col("score").isNotNull())
    positive = F.col("y") == F.get("classes", F.lit(1))
    stranger = ~F.array_contains("classes", F.col("y"))
    by_score = durable(
        known.groupBy(*keys, "score").agg(
            F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"), F.count_if(stranger).alias("strangers")
        )
    )
    order = [*keys, "score"]
    dealt = by_score.repartitionByRange(ranges, *order) if ranges else by_score.repartitionByRange(*order)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            frame = batch.to_pandas()
            below = frame.groupby(keys, dropna=False, sort=False)["q"].cumsum() - frame["q"]
            frame["won"] = frame["p"] * (below + frame["q"] / 2)
            sums = frame.groupby(keys, dropna=False, sort=False)[["won", "p", "q", "strangers"]].sum().reset_index()
            columns = [pa.array([None if v != v else v for v in sums[k].tolist()], batch.schema.field(k).type) for k in keys]
            places = [pa.array([v] * len(sums), pa.int32()) for v in (part, number)]
            counts = [pa.array(sums[c], kind) for c, kind in (("won", pa.float64()), ("p", pa.int64()), ("q", pa.int64()), ("strangers", pa.int64()))]
            yield pa.record_batch([*columns, *places, *counts], [*keys, "part", "number", "won", "p", "q", "strangers"])

    names = ", ".join(f"`{k}` {by_score.schema[k].dataType.simpleString()}" for k in keys)
    per_stretch = dealt.sortWithinPartitions(*order).mapInArrow(
        stretches, f"{names}, part int, number int, won double, p bigint, q bigint, strangers bigint"
    )
    lower = Window.partitionBy(*keys).orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    total = per_stretch.withColumn("won", F.col("won") + F.col("p").cast("double") * F.coalesce(F.sum("q").over(lower), F.lit(0)))
    area = F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q"))
    return (
        total.groupBy(*keys)
        .agg(area.alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("strangers").alias("strangers"))
        .where(F.col("strangers") == 0)
        .drop("strangers")
    )


def run_metrics(
    scored: DataFrame, classes: DataFrame | Sequence[str], keys: Sequence[str] | None = None, with_auc: bool = True
) -> DataFrame:
    """The fact table of an experiment: (key, metric, value) with accuracy, macro and weighted F1 and AUC."""
    keys = keys_of(scored, keys)
    report = classification_report(scored, keys).where(F.col("place") > 0)
    facts = report.select(
        *keys,
        F.when(F.col("class") == "accuracy", "accuracy")
        .when(F.col("class") == "macro avg", "macro_f1")
        .otherwise("weighted_f1")
        .alias("metric"),
        F.col("f1").alias("value"),
    )
    if with_auc:
        area = roc_auc(scored, classes, keys).select(*keys, F.lit("auc").alias("metric"), F.col("auc").alias("value"))
        facts = facts.unionByName(area)
    return facts
