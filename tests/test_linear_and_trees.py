"""Linear models and trees: optima against plain solvers, both ways of fitting, certificates, stored models."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.operators import linear, trees
from reviewlab.operators.folds import Folds
from reviewlab.plans.protocols import make_folds

RUNS = 2


@pytest.fixture(scope="module")
def folds(points):
    return make_folds(points, "own", None, RUNS).stored()


def _rows(folds, name, run):
    rows = folds.rows.where((F.col("model_set") == name) & (F.expr(f"getbit(train_mask, {run})") == 1)).orderBy("row_id").collect()
    return np.array([[*map(float, r.embedding), 1.0] for r in rows]), [r.label for r in rows], [r.row_id for r in rows]


def _gradient(x, labels, m, weights, loss, step=1e-5):
    """By differences of the written-out objective."""

    def objective(w):
        total = 0.0
        for row, label in zip(x, labels):
            s = dict(zip(m.classes, m.weights))[label]
            z = w @ row
            if loss.one_vs_rest or len(z) == 1:
                named = [m.classes[k] for k in loss.outputs(m)]
                total += s * sum(math.log1p(math.exp(-v if c == label else v)) for c, v in zip(named, z))
            else:
                total += s * (math.log(sum(map(math.exp, z))) - z[m.classes.index(label)])
        free = w if loss.one_vs_rest else w[:, :-1]
        return total + 0.5 / loss.c * (free**2).sum()

    out = np.zeros_like(weights)
    for i in np.ndindex(*weights.shape):
        move = np.zeros_like(weights)
        move[i] = step
        out[i] = (objective(weights + move) - objective(weights - move)) / (2 * step)
    return out


@pytest.mark.parametrize("model", [linear.softmax_logistic(), replace(linear.one_vs_rest_logistic(), c=0.5)], ids=lambda m: m.kind)
def test_logistic_models_are_optimal_either_way(folds, model):
    found = {way: {(r.model_set, r.run): r for r in replace(model, local_rows=rows).fit(folds).collect()} for way, rows in (("task", 10**6), ("job", 0))}
    for m in linear.models_of(folds):
        task, job = (np.array(found[way][m.model_set, m.run].rows) for way in ("task", "job"))
        assert task == pytest.approx(job, abs=1e-6)
        x, labels, _ = _rows(folds, m.model_set, m.run)
        slope = _gradient(x, labels, m, task, linear.LogisticLoss(model.c, model.one_vs_rest if hasattr(model, "one_vs_rest") else model.kind == "sigmoid"))
        assert np.abs(slope).max() < 1e-5


def _svm_by_coordinates(x, side, weight, rounds=4000):
    """Dual ascent over pairs of rows, the plainest exact way with a free constant."""
    n = len(x)
    dual, kernel = np.zeros(n), (x * side[:, None]) @ (x * side[:, None]).T
    slope = np.ones(n)
    for _ in range(rounds):
        up = np.where(((side > 0) & (dual < weight - 1e-12)) | ((side < 0) & (dual > 1e-12)), side * slope, -np.inf)
        low = np.where(((side < 0) & (dual < weight - 1e-12)) | ((side > 0) & (dual > 1e-12)), side * slope, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < 1e-9:
            break
        curve = kernel[i, i] + kernel[j, j] - 2 * side[i] * side[j] * kernel[i, j]
        step = (up[i] - low[j]) / max(curve, 1e-12)
        room_i = weight[i] - dual[i] if side[i] > 0 else dual[i]
        room_j = dual[j] if side[j] > 0 else weight[j] - dual[j]
        step = min(step, room_i, room_j)
        dual[i] += side[i] * step
        dual[j] -= side[j] * step
        slope -= step * (side[i] * kernel[:, i] - side[j] * kernel[:, j])
    return dual.sum() - 0.5 * dual @ kernel @ dual


@pytest.mark.parametrize("shift, n, d", [(0.0, 40, 3), (1.0, 60, 5), (3.0, 25, 40)])
def test_machines_reach_the_dual_optimum(shift, n, d):
    rng = np.random.default_rng(n)
    side = np.where(rng.random(n) < 0.35, 1.0, -1.0)
    x = rng.normal(size=(n, d)) + shift * side[:, None] / math.sqrt(d)
    weight = rng.uniform(0.2, 2.0, n)
    w = linear.fit_machine(np.column_stack([x, np.ones(n)]), side, weight)
    objective = 0.5 * w[:-1] @ w[:-1] + weight @ np.maximum(1 - side * (x @ w[:-1] + w[-1]), 0)
    best = _svm_by_coordinates(x, side, weight)
    assert best - 1e-6 <= objective <= best * (1 + 2e-4) + 1e-6


def test_dual_weights_keep_their_product():
    margin, weight = np.array([-50.0, 0.2, 1.0, 1.5, 400.0]), np.array([1.0, 0.3, 2.0, 1.0, 5.0])
    for softness in (1.0, 1e-3, 1e-9):
        dual = linear.dual_weights(margin, weight, softness)
        assert ((0 <= dual) & (dual <= weight)).all()
        slack = np.where(dual > 0, softness / np.maximum(dual, 1e-300), 0) - np.where(dual < weight, softness / np.maximum(weight - dual, 1e-300), 0)
        inner = (dual > 1e-6) & (weight - dual > 1e-6)
        assert slack[inner] == pytest.approx(margin[inner] - 1, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("model", [linear.softmax_logistic(), linear.one_vs_rest_logistic(), linear.linear_svm()], ids=lambda m: m.kind)
def test_certificates_tell_fits_from_other_weights(folds, model):
    bound = 1e-3 if model.kind == "pairs" else 1e-8
    models = model.fit(folds)
    assert all(r.measure <= bound for r in model.certificates(models, folds).collect())
    others = {
        "constant": F.transform("rows", lambda row: F.transform(row, lambda v: v * 0.0)),
        "moved": F.transform("rows", lambda row: F.transform(row, lambda v: v * 1.1)),
    }
    for rows in others.values():
        assert all(r.measure > bound for r in model.certificates(models.withColumn("rows", rows), folds).collect())


def test_large_sets_draw_by_hash_for_machines(folds):
    model = replace(linear.linear_svm(), max_fit_rows=30)
    kept = {(m.model_set, m.run): 0 for m in linear.models_of(folds)}
    for r in model.rows(folds).collect():
        for run in range(RUNS):
            if (r.model_set, run) in kept:
                kept[r.model_set, run] += r.train_mask >> run & 1
    assert all(10 <= n <= 55 for n in kept.values())
    assert all(r.measure <= 1e-3 for r in model.certificates(model.fit(folds), folds).collect())


@pytest.mark.parametrize("model, score", [(linear.linear_svm(), linear.transform), (linear.softmax_logistic(), linear.transform), (trees.random_forest(4), trees.transform)], ids=["svm", "logistic", "forest"])
def test_fitted_models_are_kept_and_reloaded(spark, folds, tmp_path, model, score):
    rows = folds.rows.where("test_mask <> 0")
    models = model.fit(folds)
    models.write.parquet(str(tmp_path / "models"))
    direct, again = (sorted(map(repr, score(m, rows).collect())) for m in (models, spark.read.parquet(str(tmp_path / "models"))))
    assert direct == again and direct


def _nodes(model, folds):
    return {tuple(r[:4]): r for r in model.fit(folds).select("model_set", "run", "tree", "node", "n", "votes", "component", "cell", "gain").collect()}


@pytest.mark.parametrize("model", [trees.decision_tree(), trees.random_forest(3), trees.random_forest(2, depth=2, weighted=False)], ids=["tree", "forest", "shallow"])
def test_trees_grow_alike_in_tasks_and_by_passes(folds, model):
    whole = _nodes(model, folds)
    assert _nodes(replace(model, local_rows=12), folds) == whole
    assert _nodes(replace(model, local_rows=0), Folds.of(folds.rows.repartition(7), RUNS)) == whole
    depth = max(r.node.bit_length() - 1 for r in whole.values())
    assert depth <= model.depth and depth > 1


def test_every_split_is_the_best_and_counts_add_up(folds):
    """All thresholds of all components, tried one by one on the rows of each node."""
    nodes = _nodes(trees.decision_tree(), folds)
    weights = {(r.model_set, r.run, r.label): r.weight for r in folds.weights.collect()}
    bins = trees.find_bins(folds.rows.where("train_mask <> 0").select("model_set", "embedding"))
    for name, run in sorted({k[:2] for k in nodes}):
        x, labels, _ = _rows(folds, name, run)
        cells = trees.cells_of(x[:, :-1], bins[name].low, bins[name].high)
        coded = bins[name].of_cell[np.arange(cells.shape[1]), cells]
        s = np.array([weights[name, run, c] for c in labels])
        classes = sorted(set(labels))

        def gini(rows):
            total = s[rows].sum()
            return total, 1 - sum((s[rows][np.array(labels)[rows] == c].sum() / total) ** 2 for c in classes)

        def walk(node, rows):
            r = nodes[name, run, 0, node]
            assert r.n == len(rows) and sum(r.votes) == pytest.approx(s[rows].sum())
            best = 0.0
            for component in range(coded.shape[1]):
                for cut in sorted(set(coded[rows, component]))[:-1]:
                    left = rows[coded[rows, component] <= cut]
                    right = rows[coded[rows, component] > cut]
                    (a, ga), (b, gb), (t, gt) = gini(left), gini(right), gini(rows)
                    best = max(best, gt - (a * ga + b * gb) / t)
            if r.component is None:
                assert best <= 1e-6 or len({labels[i] for i in rows}) == 1
                return
            assert r.gain == pytest.approx(best, abs=1e-8)
            goes = cells[rows, r.component] <= r.cell
            walk(2 * node, rows[goes])
            walk(2 * node + 1, rows[~goes])

        walk(1, np.arange(len(labels)))


def test_bags_draw_about_one_of_each_row():
    growth = trees.Growth(("a", "b"), np.ones(2), 30, True, 42)
    drawn = np.stack([growth.copies(np.arange(5000), 0, tree) for tree in range(5)])
    assert abs(drawn.mean() - 1) < 0.03 and abs((drawn == 0).mean() - math.exp(-1)) < 0.02
    assert (drawn[0] != drawn[1]).mean() > 0.4
    used = growth.components(0, np.zeros(200, int), np.arange(1, 201), 100)
    assert used.shape == (200, 10) and all(len(set(u)) == 10 for u in used.tolist()) and len(set(map(tuple, used.tolist()))) > 190


def test_forests_score_in_slices_that_hold_one_tree_at_a_time(folds, monkeypatch):
    models, rows = trees.random_forest(12).fit(folds), folds.rows.where("test_mask <> 0")
    whole = sorted(map(repr, trees.transform(models, rows).collect()))
    monkeypatch.setattr(trees, "SLICE_ROWS", 7)
    context = type(folds.rows.sparkSession.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda *_: pytest.fail("nodes reach the driver"))
    shuffled = models.orderBy("gain", "node")
    assert sorted(map(repr, trees.transform(shuffled, rows).collect())) == whole and whole


@pytest.mark.parametrize("most", [2, 5, 32])
def test_nodes_of_few_rows_split_as_their_histograms_say(most):
    rng = np.random.default_rng(most)
    bins, label = rng.integers(0, 6, (400, 9)).astype(np.uint8), rng.integers(0, 3, 400)
    size = rng.integers(2, most + 1, 60)
    row = rng.integers(0, 400, size.sum())
    copies, weights = rng.integers(1, 4, len(row)), np.array([0.7, 1.0, 3.1])
    components = np.sort(np.argsort(rng.random((60, 9)), axis=1)[:, :4], axis=1)
    node = np.repeat(np.arange(60), size)
    counts = trees._histograms(bins, row, label[row], copies, node, components, 3)
    whole = np.zeros((60, 4, trees.BINS, 3))
    for r, n, c in zip(row, node, copies):
        for j, component in enumerate(components[n]):
            whole[n, j, bins[r, component], label[r]] += c
    assert (counts == whole).all()
    expected = trees.best_splits(counts, components, weights)
    found = trees._few_rows_splits(bins, row, label[row], copies, size, components, weights)
    split = expected[0] >= 0
    assert split.any() and (found[0] == expected[0]).all() and (found[2] == expected[2]).all()
    assert (found[1][split] == expected[1][split]).all()


@pytest.mark.parametrize("base", [1, 2**40])
def test_trees_travel_in_few_bytes_and_score_alike(base):
    """A node costs at most 24 bytes of two classes' pieces; numbers beyond four bytes and pieces in any order score alike."""
    import pyarrow as pa

    growth = trees.Growth(("A", "B"), np.array([1.0, 2.0]), 12, True, 7)
    rng = np.random.default_rng(2)
    coded, label, ids = rng.integers(0, trees.BINS, (3_000, 6)).astype(np.uint8), rng.integers(0, 2, 3_000), np.arange(3_000)
    x = (rng.random((500, 6)) * 3).astype(np.float32)
    of_cell = np.repeat(np.arange(trees.BINS, dtype=np.uint8), trees.CELLS // trees.BINS)
    bins = trees.Bins(np.zeros(6), np.full(6, 3.0), np.tile(of_cell, (6, 1)))
    level = trees._joined(list(trees.grow(growth, 0, {0: 1}, coded, label, {0: growth.copies(ids, 0, 0)})))
    table = trees._node_table("s", 0, growth, level, bins).combine_chunks()
    nodes = {r["node"]: r for r in table.to_pylist()}
    pieces = pa.Table.from_batches(list(trees._pieces(reversed(table.to_batches(400)))))
    assert sum(pieces[name].nbytes for name in trees.PIECES) <= 24 * len(nodes)
    if base > 1:  # the same tree with numbers that need eight bytes: a chain of right turns above its root
        top = [1]
        while top[-1] < base:
            top.append(2 * top[-1] + 1)
        root = top[-1]
        moved = [dict(r, node=(root << (n.bit_length() - 1)) + n - (1 << (n.bit_length() - 1))) for n, r in nodes.items()]
        leaf = next(r for r in nodes.values() if r["component"] is None)
        for above in top[:-1]:
            moved += [dict(nodes[1], node=above, component=0, cell=-1), dict(leaf, node=2 * above)]
        pieces = pa.Table.from_batches(list(trees._pieces(pa.Table.from_pylist(moved, table.schema).to_batches())))

    held = pa.array(list(x), pa.list_(pa.float32()))
    batch = pa.record_batch([pa.array(["s"] * 500), pa.array(["s"] * 500), np.arange(500), pa.array(["A"] * 500), held], ["model_set", "eval_set", "row_id", "label", "embedding"])
    rows = trees._Slice([batch])
    rows.add(pieces)
    for row, found in zip(x, rows.shares):
        at, cells = 1, trees.cells_of(row[None, :], bins.low, bins.high)[0]
        while nodes[at]["component"] is not None:
            at = 2 * at + int(cells[nodes[at]["component"]] > nodes[at]["cell"])
        votes = np.array(nodes[at]["votes"])
        assert found.tolist() == (votes / votes.sum()).tolist()
