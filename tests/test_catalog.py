import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
CHECKED = [
    "clean_reviews",
    "rare_class_drop",
    "strat_split_30",
    "mix_fallback_90_10",
    "knn_predict_distance",
    "confusion_overlap",
    "roc_auc_vectors",
    "embed_cached_lookup",
    "fit_dt",
    "fit_svm",
]


def _cell(value):
    return round(value, 5) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, database, name):
    frame = contract.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(_cell(row[c]) for c in columns) for row in frame.collect()), key=repr)
    answer = database.execute(contract.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    theirs = sorted((tuple(_cell(row[names.index(c)]) for c in columns) for row in answer.fetchall()), key=repr)
    assert columns == sorted(names) and ours == theirs


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.eval_set for r in rows} == {"base", "ext1", "ext2", "ext3"} and all(r.runs == 10 for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
