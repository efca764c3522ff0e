import numpy as np
import pytest

from reviewlab.operators import neighbors
from reviewlab.operators.neighbors import class_shares, nearest_neighbors
from reviewlab.plans.protocols import Knn, make_folds

RUNS = 3


def _brute(folds, k):
    rows = folds.collect()
    found = {}
    for run in range(RUNS):
        for test in rows:
            if not test.test_mask >> run & 1:
                continue
            x = np.array(test.embedding, dtype="float64")
            near = sorted(
                (float(np.sqrt(((np.array(t.embedding, dtype="float64") - x) ** 2).sum())), t.row_id, t.label)
                for t in rows
                if t.model_set == test.model_set and t.train_mask >> run & 1
            )
            found[(test.model_set, run, test.row_id)] = near[:k]
    return found


def _spark(found):
    got = {}
    for r in found.collect():
        got.setdefault((r.model_set, r.run, r.row_id), []).append((r.place, r.distance, r.neighbor_id, r.label))
    return {key: [x[1:] for x in sorted(rows)] for key, rows in got.items()}


@pytest.mark.parametrize("block_rows", [None, 16])
@pytest.mark.parametrize("protocol", ["own", "mix"])
def test_neighbors_equal_brute_force(points, protocol, block_rows):
    folds = make_folds(points, protocol, None if protocol == "own" else "base", RUNS).rows.cache()
    got = _spark(nearest_neighbors(folds, 5, RUNS, block_rows))
    want = _brute(folds, 5)
    assert set(got) == set(want)
    for key, near in want.items():
        assert [(i, label) for _, i, label in got[key]] == [(i, label) for _, i, label in near], key
        assert np.allclose([d for d, *_ in got[key]], [d for d, *_ in near])


def test_tiles_and_chunks_change_nothing(points, monkeypatch):
    from reviewlab.operators import neighbors

    folds = make_folds(points, "own", None, RUNS).rows.cache()
    want = _spark(nearest_neighbors(folds, 5, RUNS))
    monkeypatch.setattr(neighbors, "TILE_CELLS", 150)
    assert _spark(nearest_neighbors(folds, 5, RUNS)) == want
    monkeypatch.setattr(neighbors, "SHARED_LIST", 1)
    assert _spark(nearest_neighbors(folds, 5, RUNS)) == want
    monkeypatch.setattr(neighbors, "SHARED_LIST", 1000)
    assert _spark(nearest_neighbors(folds, 5, RUNS)) == want


def test_fewer_training_rows_than_k(spark):
    rows = [("s", "s", 1, "A", [0.0], 1, 0), ("s", "s", 2, "B", [1.0], 1, 0), ("s", "s", 3, "B", [0.4], 0, 1)]
    schema = "model_set string, eval_set string, row_id bigint, label string, embedding array<float>, train_mask bigint, test_mask bigint"
    got = _spark(nearest_neighbors(spark.createDataFrame(rows, schema), 5, 1))
    assert [i for _, i, _ in got[("s", 0, 3)]] == [1, 2]


def _votes(spark, ballots, classes, weights):
    rows = [("s", "s", 0, 1, "A", i, n, label, d) for i, (n, label, d) in enumerate(ballots, 1)]
    schema = "model_set string, eval_set string, run int, row_id bigint, y string, place int, neighbor_id bigint, label string, distance double"
    lists = spark.createDataFrame([("s", 0, classes)], "model_set string, run int, classes array<string>")
    return class_shares(spark.createDataFrame(rows, schema), lists, weights).first()


def test_votes(spark):
    tie = [(1, "B", 1.0), (2, "A", 2.0)]
    assert _votes(spark, tie, ["A", "B"], "uniform").yhat == "A"
    assert _votes(spark, tie, ["A", "B"], "distance").yhat == "B"
    exact = [(1, "B", 0.0), (2, "A", 0.1), (3, "A", 0.1)]
    row = _votes(spark, exact, ["A", "B", "C"], "distance")
    assert (row.yhat, row.shares) == ("B", [0.0, 1.0, 0.0])
    with pytest.raises(ValueError):
        _votes(spark, tie, ["A", "B"], "other")


def test_scores_are_second_class_shares_of_binary_models_only(points):
    folds = make_folds(points, "own", None, RUNS)
    rows = Knn().score(folds).collect()
    assert all((r.score is None) == (r.model_set == "two") for r in rows)
    assert all(0 <= r.score <= 1 for r in rows if r.score is not None)
    lists = {r.model_set: r.classes for r in folds.classes.collect()}
    assert lists["two"] == ["Negatief", "Neutraal", "Positief"] and lists["one"] == ["Negatief", "Positief"]


@pytest.mark.parametrize("columns", [5, 300, 2000])
def test_limits_let_enough_rows_through(columns):
    rng = np.random.default_rng(columns)
    rough = rng.random((40, columns))
    rough[:5, 3:] = np.inf
    rough[5:10, rng.integers(0, columns, columns // 3)] = np.nan
    limit = neighbors._limit(rough, 3)
    for row, top in zip(rough, limit):
        assert (row <= top).sum() >= min(3, np.isfinite(row).sum())
    if columns == 2000:
        assert (rough[10:] <= limit[10:, None]).sum() <= 30 * 6
