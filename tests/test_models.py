import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.operators import densenet
from reviewlab.operators.densenet import (
    DenseNet,
    _forward,
    _gradient,
    _layers,
    _shapes,
    adam_logistic,
    plain_network,
    short_network,
    transform,
    weighted_network,
)
from reviewlab.operators.folds import Folds
from reviewlab.operators.linear import linear_svm, one_vs_rest_logistic, softmax_logistic
from reviewlab.operators.metrics import accuracy
from reviewlab.operators.trees import decision_tree, random_forest
from reviewlab.operators.weights import balanced_weights, train_class_counts, with_weights
from reviewlab.plans import protocols
from reviewlab.plans.protocols import Knn, make_folds, own_train_eval, retrain_eval, transfer_eval
from reviewlab.session import durable

RUNS = 2


@pytest.fixture(scope="module")
def folds(points):
    return make_folds(points, "own", None, RUNS).stored()


@pytest.fixture(scope="module")
def easy(spark):
    """Two well separated classes, three to one."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        label = "Positief" if i % 4 else "Negatief"
        centre = 2.0 if i % 4 else -2.0
        rows.append(("d", i, label, [float(v) for v in rng.normal(centre, 0.6, 4)]))
    df = spark.createDataFrame(rows, "dataset string, row_id bigint, label string, embedding array<float>")
    return make_folds(df, "own", None, RUNS).stored()


def test_balanced_weights_sum_to_the_rows(folds):
    counts = train_class_counts(folds.rows, runs=RUNS)
    columns = ["model_set", "run", "label", "n"]
    assert sorted(counts.select(columns).collect()) == sorted(folds.train_counts.select(columns).collect())
    weights = balanced_weights(counts)
    sums = weights.groupBy("model_set", "run").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("w"))
    assert all(r.n == pytest.approx(r.w) for r in sums.collect())
    per_class = weights.where("model_set = 'two' and run = 0").collect()
    assert all(r.weight == pytest.approx(64 / (3 * r.n)) for r in per_class)
    rows = folds.rows.where("model_set = 'two' and train_mask & 1 = 1").withColumn("run", F.lit(0))
    assert with_weights(rows, weights).agg(F.sum("weight")).first()[0] == pytest.approx(64)


def test_each_run_of_a_bounded_network_draws_its_own_rows(easy):
    net = DenseNet(max_fit_rows=40)
    entries = easy.weights.groupBy("model_set", "run").agg(F.sum("n").alias("n"))
    drawn = {run: set() for run in range(RUNS)}
    for r in net.drawn(easy, entries).collect():
        drawn[r.run].add(r.row_id)
    train = [{r.row_id for r in easy.rows.where(f"train_mask >> {run} & 1 = 1").collect()} for run in range(RUNS)]
    both = train[0] & train[1]
    ours, theirs = drawn[0] & both, drawn[1] & both
    assert ours and theirs and len(ours & theirs) < 0.7 * min(len(ours), len(theirs))


MODELS = [
    random_forest(5),
    random_forest(5, depth=15, weighted=False),
    decision_tree(),
    softmax_logistic(),
    one_vs_rest_logistic(),
    linear_svm(),
    DenseNet((16,), 20, 16, learning_rate=0.01),
    DenseNet((8,), 40, 16, learning_rate=0.01, weighted=False, tolerance=1e-4, early_stopping=True),
    DenseNet((), 20, 16, learning_rate=0.05),
]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: m.name)
def test_models_score_every_test_row(folds, easy, model):
    scored = durable(model.score(easy))
    assert scored.count() == RUNS * 48
    assert min(r.accuracy for r in accuracy(scored).collect()) > 0.9
    rows = scored.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    agree = sum((r.score > 0.5) == (r.yhat == "Positief") for r in rows)
    assert agree >= 0.9 * len(rows)


@pytest.mark.parametrize("model", [MODELS[0], MODELS[4], MODELS[5], MODELS[6]], ids=lambda m: m.name)
def test_three_classes_have_labels_but_no_score(folds, model):
    two = Folds.of(folds.rows.where("model_set = 'two'"), RUNS)
    rows = model.score(two).collect()
    assert len(rows) == RUNS * 28
    assert all(r.score is None and r.yhat in ("Negatief", "Neutraal", "Positief") for r in rows)


@pytest.mark.parametrize("model", [softmax_logistic(), random_forest(3), DenseNet((4,), 3, 8)], ids=lambda m: m.name)
def test_same_seed_same_scores(easy, model):
    def run():
        return sorted((r.run, r.row_id, r.yhat, r.score) for r in model.score(easy).collect())

    assert run() == run()


def test_a_single_training_class_is_predicted_everywhere(spark):
    rows = [("d", i, "A", [float(i)]) for i in range(10)]
    one = make_folds(spark.createDataFrame(rows, "dataset string, row_id bigint, label string, embedding array<float>"), "own", None, 1)
    for model in (softmax_logistic(), linear_svm(), decision_tree(), random_forest(3), DenseNet((2,), 1, 4), Knn()):
        assert {(r.yhat, r.score) for r in model.score(one).collect()} == {("A", None)}


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    shapes = _shapes(5, (4,), 3)
    flat = rng.normal(size=sum((a + 1) * b for a, b in shapes))
    x, y, w = rng.normal(size=(7, 5)), rng.integers(0, 3, 7), rng.uniform(0.5, 2, 7)

    def loss(v):
        _, p = _forward(x, _layers(v, shapes))
        return float(-(w / w.sum() * np.log(p[np.arange(7), y])).sum())

    slope, value = _gradient(x, y, w, flat, shapes, 0.0)
    assert value == pytest.approx(loss(flat), rel=1e-6)
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, rel=1e-3, abs=1e-6)


def test_networks_depend_on_nothing_but_their_rows(spark, easy, points):
    """Another dataset, another partitioning or a stored and reloaded model leave the scores as they are."""
    net = DenseNet((8,), 30, 8, learning_rate=0.02, tolerance=1e-4, early_stopping=True, max_fit_rows=60)

    def scores(df):
        return {(r.run, r.row_id): r.score for r in df.where("model_set = 'd'").collect()}

    alone = scores(net.score(easy))
    others = easy.rows.unionByName(
        easy.rows.withColumn("model_set", F.lit("e")).withColumn("eval_set", F.lit("e")).withColumn("row_id", F.col("row_id") + 1000)
    )
    assert scores(net.score(Folds.of(others.repartition(13), RUNS))) == pytest.approx(alone)


def test_fitted_networks_are_kept_and_reloaded(spark, easy, tmp_path):
    net = DenseNet((8,), 5, 8)
    direct = sorted((r.run, r.row_id, r.score) for r in net.score(easy).collect())
    net.fit(easy).write.parquet(str(tmp_path / "models"))
    models = spark.read.parquet(str(tmp_path / "models"))
    again = transform(models, easy.rows.where("test_mask <> 0"))
    assert sorted((r.run, r.row_id, r.score) for r in again.collect()) == direct


def test_forests_depend_on_nothing_but_their_rows(easy):
    model = random_forest(5)
    runs = []
    for parts in (1, 9):
        folds = Folds.of(easy.rows.repartition(parts), RUNS)
        runs.append({(r.run, r.row_id): r.score for r in model.score(folds).collect()})
    assert runs[0] == pytest.approx(runs[1])


def test_weights_shift_an_unbalanced_fit(spark):
    rng = np.random.default_rng(5)
    rows = [("d", i, "AB"[i % 10 > 0], [float(rng.normal(0.7 * (i % 10 > 0)))]) for i in range(300)]
    df = spark.createDataFrame(rows, "dataset string, row_id bigint, label string, embedding array<float>")
    one = make_folds(df, "own", None, 1).stored()
    minority = {}
    for weighted in (True, False):
        net = DenseNet((), 60, 32, learning_rate=0.02, weighted=weighted)
        minority[weighted] = net.score(one).where("yhat = 'A'").count()
    assert minority[True] > minority[False]


def test_protocols_end_to_end(points):
    models = [Knn(), adam_logistic()]
    metrics, summary, tests = own_train_eval(points, models, [("base", "one"), ("one", "two")], RUNS)
    assert {r.model for r in summary.collect()} == {"KNN", "REGRESSION_ADAM"}
    assert tests.count() == 4
    metrics, tests = retrain_eval(points, "base", [Knn()], RUNS)
    assert {(r.a, r.b, r.df) for r in tests.collect()} == {("base", "one", 1.0), ("base", "two", 1.0)}
    metrics, none = retrain_eval(points, "base", [Knn()], RUNS, mix=False)
    assert none is None and {r.eval_set for r in metrics.select("eval_set").collect()} == {"base", "one", "two"}
    moved = transfer_eval(points, "base", [Knn()], RUNS)
    rows = moved.where("metric = 'auc'").collect()
    assert {r.eval_set for r in rows} == {"base", "one"}  # "two" has a class the base model does not know


def test_protocol_needs_a_model(points):
    with pytest.raises(ValueError):
        protocols.score_protocol(points, "own", [])


def test_rows_are_put_in_order_part_by_part():
    rng = np.random.default_rng(3)
    whole, order = rng.random((50, 4)).astype("float32"), rng.permutation(50)
    parts = [whole[:7].copy(), whole[7:30].copy(), whole[30:].copy()]
    assert (densenet._in_order(parts, order) == whole[order]).all() and not parts


def test_a_network_learns_from_all_training_rows(spark):
    rows = spark.range(200_000).select(
        F.lit("d").alias("dataset"),
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("label"),
        F.array(F.lit(0.5).cast("float")).alias("embedding"),
    )
    one = make_folds(rows, "own", None, 1)
    entries = one.weights.groupBy("model_set", "run").agg(F.sum("n").alias("n"))
    for net in (plain_network(), weighted_network(), short_network(), adam_logistic()):
        assert net.drawn(one, entries).count() == one.rows.where("train_mask <> 0").count() == 140_000


def test_vectors_in_a_file_give_the_same_network(easy):
    nets = [DenseNet((8,), 6, 8, tolerance=1e-4, early_stopping=True, held_bytes=size) for size in (1 << 27, 300)]
    held, filed = (sorted((r.run, r.row_id, r.score) for r in net.score(easy).collect()) for net in nets)
    assert held == filed and len(held) == RUNS * 48
