import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewlab.functions.scores import argmax_label, binarise, positive_score, softmax
from reviewlab.functions.student import fixed
from reviewlab.operators.metrics import (
    accuracy,
    auc_ready,
    classification_report,
    confusion_matrix,
    confusion_wide,
    roc_auc,
    run_metrics,
)

LABELS = ["Negatief", "Neutraal", "Positief"]

# Published confusion matrices with the report printed above each: (precision, recall, F1, support) per line.
GOLDEN = [
    (
        ["Negatief", "Positief"],
        [[42, 3], [2, 43]],
        {
            "Negatief": ("0.95", "0.93", "0.94", 45),
            "Positief": ("0.93", "0.96", "0.95", 45),
            "accuracy": (None, None, "0.94", 90),
            "macro avg": ("0.94", "0.94", "0.94", 90),
            "weighted avg": ("0.94", "0.94", "0.94", 90),
        },
    ),
    (
        LABELS,
        [[25, 3, 13], [14, 8, 5], [23, 1, 119]],
        {
            "Negatief": ("0.40", "0.61", "0.49", 41),
            "Neutraal": ("0.67", "0.30", "0.41", 27),
            "Positief": ("0.87", "0.83", "0.85", 143),
            "accuracy": (None, None, "0.72", 211),
            "macro avg": ("0.65", "0.58", "0.58", 211),
            "weighted avg": ("0.75", "0.72", "0.72", 211),
        },
    ),
    (
        LABELS,
        [[40, 0, 5], [0, 0, 0], [4, 1, 40]],
        {
            "Negatief": ("0.91", "0.89", "0.90", 45),
            "Neutraal": ("0.00", "0.00", "0.00", 0),
            "Positief": ("0.89", "0.89", "0.89", 45),
            "accuracy": (None, None, "0.89", 90),
            "macro avg": ("0.60", "0.59", "0.60", 90),
            "weighted avg": ("0.90", "0.89", "0.89", 90),
        },
    ),
    (
        ["Negatief", "Positief"],
        [[0, 16], [1, 102]],
        {
            "Negatief": ("0.00", "0.00", "0.00", 16),
            "Positief": ("0.86", "0.99", "0.92", 103),
            "accuracy": (None, None, "0.86", 119),
            "macro avg": ("0.43", "0.50", "0.46", 119),
            "weighted avg": ("0.75", "0.86", "0.80", 119),
        },
    ),
]


def scored_from(spark, labels, matrix, run=0, eval_set="s"):
    rows, at = [], itertools.count()
    for y, counts in zip(labels, matrix):
        for yhat, n in zip(labels, counts):
            rows += [("s", eval_set, run, next(at), y, yhat, None) for _ in range(n)]
    schema = "model_set string, eval_set string, run int, row_id bigint, y string, yhat string, score double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("labels, matrix, want", GOLDEN)
def test_report_and_matrix_of_published_results(spark, labels, matrix, want):
    scored = scored_from(spark, labels, matrix)
    two = F.lit(2)
    texts = classification_report(scored).select("class", *[fixed(F.col(c), two).alias(c) for c in ("precision", "recall", "f1")], "support")
    assert {r["class"]: tuple(r)[1:] for r in texts.collect()} == want
    cells = {(r.y, r.yhat): r.n for r in confusion_matrix(scored, labels).collect()}
    assert cells == {(y, p): n for y, row in zip(labels, matrix) for p, n in zip(labels, row)}
    wide = {r.y: [r[c] for c in labels] for r in confusion_wide(confusion_matrix(scored, labels), labels).collect()}
    assert wide == dict(zip(labels, matrix))
    report = {r["class"]: r for r in classification_report(scored).collect()}
    assert report["weighted avg"].recall == pytest.approx(accuracy(scored).first().accuracy)


def test_restricted_matrix_counts_only_shared_labels(spark):
    scored = scored_from(spark, LABELS, [[3, 1, 2], [4, 0, 1], [0, 2, 5]])
    restricted = confusion_matrix(scored, ["Negatief", "Positief"], restrict=True)
    assert {(r.y, r.yhat): r.n for r in restricted.collect()} == {
        ("Negatief", "Negatief"): 3,
        ("Negatief", "Positief"): 2,
        ("Positief", "Negatief"): 0,
        ("Positief", "Positief"): 5,
    }


def test_no_shared_label_gives_a_note(spark):
    scored = scored_from(spark, ["A", "B"], [[0, 3], [0, 0]])
    rows = confusion_matrix(scored, ["B", "C"], restrict=True).collect()
    assert [(r.y, r.yhat, r.n, r.note) for r in rows] == [(None, None, None, "no labels in common")]


def _brute_auc(rows):
    pos = [s for y, s in rows if y == "B"]
    neg = [s for y, s in rows if y == "A"]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("cells", [2, 7, 256])
@pytest.mark.parametrize("distinct", [3, 10**9])
def test_auc_equals_pair_counting_for_any_ranges(spark, cells, distinct):
    random.seed(distinct)
    rows = [(e, random.choice("AB"), random.randrange(distinct) / distinct) for e in ("x", "y") for _ in range(150)]
    df = spark.createDataFrame(rows, "eval_set string, y string, score double")
    got = {r.eval_set: r.auc for r in roc_auc(df, ["A", "B"], ranges=cells).collect()}
    flipped = {r.eval_set: r.auc for r in roc_auc(df.withColumn("score", -F.col("score")), ["A", "B"]).collect()}
    for name in ("x", "y"):
        assert got[name] == pytest.approx(_brute_auc([r[1:] for r in rows if r[0] == name]))
        assert got[name] + flipped[name] == pytest.approx(1)


def test_auc_gates(spark):
    rows = [("one", "B", 0.3), ("one", "B", 0.4), ("odd", "A", 0.1), ("odd", "C", 0.2), ("ok", "A", 0.1), ("ok", "B", 0.2)]
    df = spark.createDataFrame([(*r, "A") for r in rows], "eval_set string, y string, score double, yhat string")
    assert {r.eval_set: r.auc for r in roc_auc(df, ["A", "B"]).collect()} == {"one": None, "ok": 1.0}
    assert {r.eval_set for r in auc_ready(df, ["A", "B"]).collect()} == {"one", "ok"}
    assert roc_auc(df, ["A", "B", "C"]).count() == 0


def test_run_metrics_has_all_metrics(spark):
    df = scored_from(spark, ["Negatief", "Positief"], [[4, 1], [2, 3]]).withColumn("score", F.rand(1))
    facts = {r.metric: r.value for r in run_metrics(df, ["Negatief", "Positief"]).collect()}
    assert set(facts) == {"accuracy", "macro_f1", "weighted_f1", "auc"} and facts["accuracy"] == 0.7


def test_score_functions(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0], ["A", "B", "C"]), ([0.0, 1.0], ["A", "B"])], "z array<double>, c array<string>")
    z, c = F.col("z"), F.col("c")
    rows = df.select(softmax(z), argmax_label(z, c), binarise(F.lit("B"), c), positive_score(z)).collect()
    assert rows[0][0] == [0.5, 0.5, 0.0] and rows[0][1:] == ("A", None, 1000.0)
    assert sum(rows[1][0]) == pytest.approx(1) and rows[1][1:] == ("B", 1, 1.0)


def test_fixed_rounds_like_binary_values_print(spark):
    values = [0.155, 0.125, 0.375, 2.675, 1.005, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fixed(F.col("v"), F.lit(2))).collect()] == [
        None if v is None else f"{v:.2f}" for v in values
    ]
