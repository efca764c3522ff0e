import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlab.operators.sampling import (
    allocate_quota,
    explode_runs,
    mix_size,
    stratified_split,
    train_rows_for_target,
    train_rows_for_test_fraction,
)
from reviewlab.plans.protocols import make_folds


def _brute_quota(counts, n_train):
    n = sum(counts.values())
    whole = {c: k * n_train // n for c, k in counts.items()}
    spare = n_train - sum(whole.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * n_train % n), c))[:spare]:
        whole[c] += 1
    return whole


def _quotas(spark, counts, n_train):
    n = sum(counts.values())
    rows = [("d", c, k, n, n_train) for c, k in counts.items()]
    df = spark.createDataFrame(rows, "dataset string, sentiment string, n bigint, n_group bigint, n_train bigint")
    return {r.sentiment: r.quota for r in allocate_quota(df, ["dataset"]).collect()}


@pytest.mark.parametrize(
    "counts, n_train, test_rows",
    [
        # Class sizes and test supports of published runs.
        ({"Negatief": 150, "Positief": 150}, 210, {"Negatief": 45, "Positief": 45}),
        ({"Negatief": 58, "Neutraal": 39, "Positief": 204}, 210, {"Negatief": 17, "Neutraal": 12, "Positief": 62}),
        ({"Negatief": 58, "Neutraal": 39, "Positief": 204}, 90, {"Negatief": 41, "Neutraal": 27, "Positief": 143}),
        ({"Negatief": 54, "Positief": 340}, 275, {"Negatief": 16, "Positief": 103}),
        ({"Negatief": 54, "Positief": 340}, 90, {"Negatief": 42, "Positief": 262}),
    ],
)
def test_quotas_give_the_published_supports(spark, counts, n_train, test_rows):
    quotas = _quotas(spark, counts, n_train)
    assert {c: counts[c] - q for c, q in quotas.items()} == test_rows


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=5), st.floats(0, 1))
def test_quotas_sum_and_match_largest_remainder(spark, sizes, share):
    counts = {f"c{i}": n for i, n in enumerate(sizes)}
    n_train = int(share * sum(sizes))
    quotas = _quotas(spark, counts, n_train)
    assert sum(quotas.values()) == n_train
    assert quotas == _brute_quota(counts, n_train)


def test_quota_products_beyond_64_bits(spark):
    quotas = _quotas(spark, {"a": 3 * 10**10, "b": 7 * 10**10}, 7 * 10**10)
    assert quotas == {"a": 21 * 10**9, "b": 49 * 10**9}


def test_train_sizes(spark):
    df = spark.range(1).select(
        train_rows_for_test_fraction(F.lit(301), "0.3").alias("a"),
        train_rows_for_test_fraction(F.lit(10), "0.8").alias("b"),
        mix_size(F.lit(210)).alias("c"),
        train_rows_for_target(F.lit(112), F.lit(90)).alias("d"),
        train_rows_for_target(F.lit(90), F.lit(90)).alias("e"),
    )
    assert list(df.first()) == [210, 2, 90, 90, 81]


def _brute_split(rows, by_class, seed, quotas):
    train = set()
    for label, ids in by_class.items():
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        train |= set(ranked[: quotas[label]])
    return train


@pytest.mark.parametrize("runs", [3, 12])
def test_split_is_the_hash_ranked_quota_for_every_run(spark, runs):
    rows = [("d", i, "AB"[i % 3 == 0]) for i in range(700)]
    df = spark.createDataFrame(rows, "dataset string, row_id bigint, sentiment string")
    split = stratified_split(df, runs=runs)
    masks = {r.row_id: r.train_mask for r in split.collect()}
    assert len(masks) == 700
    by_class = {c: [i for _, i, label in rows if label == c] for c in "AB"}
    quotas = _brute_quota({c: len(ids) for c, ids in by_class.items()}, 490)
    for run in range(3):
        assert {i for i, m in masks.items() if m >> run & 1} == _brute_split(rows, by_class, 42 + run, quotas)


def test_whole_and_empty_quotas(spark):
    df = spark.createDataFrame([("d", i, "A") for i in range(5)] + [("e", 9, "B")], "dataset string, row_id bigint, sentiment string")
    n_train = F.when(F.col("dataset") == "d", F.col("n_group")).otherwise(0)
    masks = {r.row_id: r.train_mask for r in stratified_split(df, n_train, runs=2).collect()}
    assert masks == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 9: 0}


def test_too_many_runs(spark):
    with pytest.raises(ValueError):
        stratified_split(spark.createDataFrame([("d", 1, "A")], "dataset string, row_id bigint, sentiment string"), runs=63)


@pytest.mark.parametrize("protocol", ["own", "transfer", "fraction", "mix"])
def test_folds_partition_each_dataset(spark, points, protocol):
    folds = make_folds(points, protocol, None if protocol == "own" else "base", runs=2)
    rows = explode_runs(folds.rows, 2).groupBy("model_set", "eval_set", "run", "part").count().collect()
    got = {(r.model_set, r.eval_set, r.run, r.part): r["count"] for r in rows}
    sizes = {"base": 110, "one": 55, "two": 92}
    want = {
        "own": {("base", "base"): 77, ("one", "one"): 38, ("two", "two"): 64},
        "transfer": {("base", "base"): 77, ("base", "one"): 0, ("base", "two"): 0},
        "fraction": {("one", "base"): 77, ("two", "base"): 77, ("one", "one"): 11, ("two", "two"): 18},
        "mix": {("one", "base"): 77, ("two", "base"): 77, ("one", "one"): 33, ("two", "two"): 33},
    }[protocol]
    for (model_set, eval_set), n_train in want.items():
        for run in range(2):
            assert got.get((model_set, eval_set, run, "train"), 0) == n_train
            assert got.get((model_set, eval_set, run, "test"), 0) == sizes[eval_set] - n_train
    assert {key[:2] for key in got} == set(want)


def test_fold_arguments_are_checked(points):
    with pytest.raises(ValueError):
        make_folds(points, "own", "base")
    with pytest.raises(ValueError):
        make_folds(points, "other", "base")
