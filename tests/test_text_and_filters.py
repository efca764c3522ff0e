from pyspark.sql import functions as F

from reviewlab.functions.text import WHITE_SPACE, cap_tokens, clean_label, clean_text
from reviewlab.operators.filters import (
    class_counts,
    class_lists,
    clean_reviews,
    count_rejected,
    decode_labels,
    drop_rare_class,
    filter_min_length,
    index_labels,
)


def test_white_space_is_what_python_strips():
    assert set(WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_clean_text_strips_then_removes_triple_quotes(spark):
    raw = ["  spaced \t", '""" kept space', 'a"""b""c', None, " \n"]
    df = spark.createDataFrame([(v,) for v in raw], "t string")
    got = [r[0] for r in df.select(clean_text(F.col("t"))).collect()]
    assert got == ["spaced", " kept space", 'ab""c', None, ""]
    assert [r[0] for r in df.select(clean_label(F.col("t"))).collect()][0] == "spaced"


def test_length_filter_is_strict_and_counts_code_points(spark):
    rows = [("d", 1, "A", "x" * 10), ("d", 2, "A", "x" * 11), ("d", 3, "A", None), ("d", 4, "A", "é" * 11), ("d", 5, None, "x" * 20)]
    df = spark.createDataFrame(rows, "dataset string, row_id int, sentiment string, review string")
    kept = filter_min_length(clean_reviews(df))
    assert sorted(r.row_id for r in kept.collect()) == [2, 4]
    assert count_rejected(df).collect()[0].n_rejected == 1


def _reviews(spark, counts):
    rows = [(d, label) for d, label, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "dataset string, sentiment string")


def test_rare_class_rule_only_touches_the_neutral_class_of_its_dataset(spark):
    df = _reviews(spark, [("a", "Neutraal", 9), ("a", "Positief", 3), ("b", "Neutraal", 10), ("c", "Negatief", 2)])
    left = {(r.dataset, r.sentiment): r.n for r in class_counts(drop_rare_class(df)).collect()}
    assert left == {("a", "Positief"): 3, ("b", "Neutraal"): 10, ("c", "Negatief"): 2}
    left = {(r.dataset, r.sentiment): r.n for r in class_counts(drop_rare_class(df, rare=None)).collect()}
    assert left == {("b", "Neutraal"): 10}


def test_labels_are_indexed_in_alphabetical_order_and_back(spark):
    df = _reviews(spark, [("a", "Positief", 1), ("a", "Negatief", 1), ("b", "Positief", 2)])
    assert {r.dataset: r.classes for r in class_lists(df).collect()} == {"a": ["Negatief", "Positief"], "b": ["Positief"]}
    rows = decode_labels(index_labels(df)).collect()
    assert {(r.dataset, r.sentiment, r.label_index) for r in rows} == {
        ("a", "Negatief", 0),
        ("a", "Positief", 1),
        ("b", "Positief", 0),
    }
    assert all(r.label == r.sentiment for r in rows)


def test_token_cap(spark):
    df = spark.createDataFrame([("Één, twee -- drie 4!",)], "t string")
    assert df.select(cap_tokens(F.col("t"), 3)).first()[0] == ["één", "twee", "drie"]
