from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlab.operators.filters import clean_reviews, filter_min_length
from reviewlab.session import durable
from reviewlab.sources.reports import report_lines, write_lines, write_metrics
from reviewlab.sources.tables import Source, ingest_registry, read_registry, read_reviews
from test_metrics import LABELS, scored_from

BASE = (
    "Label;Text\n"
    ' Positief ;"line one\nline two"\n'
    'Negatief;"a ""quoted"" word"\n'
    'Neutraal;"""""""triple"""""" quotes inside"\n'
    "Positief;\n"
    ";no label here at all\n"
    "Negatief;0123456789\n"
    "Negatief;01234567890\n"
    "Negatief;  padded text  \n"
)


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "base.csv").write_text(BASE, encoding="utf-8")
    (tmp_path / "other.csv").write_text("a,b\nPositief,\"one, two, three\"\n", encoding="utf-8")
    return [Source("base", str(tmp_path / "base.csv"), ";"), ("other", str(tmp_path / "other.csv"))]


def test_reads_the_dialect(spark, sources):
    rows = [tuple(r) for r in read_reviews(spark, sources[0].path, ";").collect()]
    assert rows[:4] == [
        (" Positief ", "line one\nline two"),
        ("Negatief", 'a "quoted" word'),
        ("Neutraal", '"""triple""" quotes inside'),
        ("Positief", None),
    ]
    assert len(rows) == 8
    kept = filter_min_length(clean_reviews(read_registry(spark, sources)))
    assert sorted((r.dataset, r.sentiment, r.review) for r in kept.collect()) == [
        ("base", "Negatief", "01234567890"),
        ("base", "Negatief", 'a "quoted" word'),
        ("base", "Negatief", "padded text"),
        ("base", "Neutraal", "triple quotes inside"),
        ("base", "Positief", "line one\nline two"),
        ("other", "Positief", "one, two, three"),
    ]


def test_other_than_two_columns_is_an_error(spark, tmp_path):
    (tmp_path / "three.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(ValueError):
        read_reviews(spark, str(tmp_path / "three.csv"))


def test_ingest_fixes_row_ids_and_can_be_repeated(spark, sources, tmp_path):
    for _ in range(2):
        table = ingest_registry(spark, sources, str(tmp_path / "reviews"))
    assert table.count() == 9 == table.select("row_id").distinct().count()
    assert {r.dataset for r in table.select("dataset").distinct().collect()} == {"base", "other"}


def test_names_and_ids_survive_the_registry(spark, tmp_path):
    text = "a,b\n" + "Positief,same text twice\n" * 2 + "Negatief,another text\n"
    paths = []
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(text)
        paths.append(str(tmp_path / f"{i}.csv"))
    sources = [Source("007", paths[0]), Source("1.50", paths[1])]
    first = ingest_registry(spark, sources, str(tmp_path / "one"))
    second = ingest_registry(spark, sources[::-1], str(tmp_path / "two"))
    assert {r.dataset for r in first.collect()} == {"007", "1.50"} and first.count() == 6
    ids = {(r.dataset, r.sentiment, r.row_id) for r in first.collect()}
    assert len(ids) == 6 and ids == {(r.dataset, r.sentiment, r.row_id) for r in second.collect()}


def test_metrics_round_trip(spark, tmp_path):
    rows = [("own", "KNN", "a", 0, "accuracy", 0.5), ("own", "RF", "a", 0, "accuracy", 0.75)]
    df = spark.createDataFrame(rows, "protocol string, model string, eval_set string, run int, metric string, value double")
    write_metrics(df, str(tmp_path / "metrics"))
    write_metrics(df, str(tmp_path / "metrics"))
    back = spark.read.parquet(str(tmp_path / "metrics"))
    assert back.where("model = 'RF'").first().value == 0.75 and back.count() == 2


# Parts of two published run reports, apart from the names of the datasets.
EXPECTED_MIX = """\


=== Run 10 met extra dataset: SecondHospital ===

--- Evaluatie op base testset ---
              precision    recall  f1-score   support

    Negatief       0.91      0.89      0.90        45
    Neutraal       0.00      0.00      0.00         0
    Positief       0.89      0.89      0.89        45

    accuracy                           0.89        90
   macro avg       0.60      0.59      0.60        90
weighted avg       0.90      0.89      0.89        90


Confusion Matrix (base):
          Negatief  Neutraal  Positief
Negatief        40         0         5
Neutraal         0         0         0
Positief         4         1        40
--- Evaluatie op SecondHospital (externe testset) ---
              precision    recall  f1-score   support

    Negatief       0.40      0.61      0.49        41
    Neutraal       0.67      0.30      0.41        27
    Positief       0.87      0.83      0.85       143

    accuracy                           0.72       211
   macro avg       0.65      0.58      0.58       211
weighted avg       0.75      0.72      0.72       211


Confusion Matrix (SecondHospital):
          Negatief  Neutraal  Positief
Negatief        25         3        13
Neutraal        14         8         5
Positief        23         1       119
Accuracy base: 0.8889
Accuracy SecondHospital: 0.7204
"""
EXPECTED_OWN = """\
=== Run 1 Evaluaties ===
--- Evaluatie SecondHospital (70/30 split) ---
              precision    recall  f1-score   support

    Negatief       0.50      0.41      0.45        17
    Neutraal       1.00      0.08      0.15        12
    Positief       0.75      0.92      0.83        62

    accuracy                           0.71        91
   macro avg       0.75      0.47      0.48        91
weighted avg       0.74      0.71      0.67        91

Confusion Matrix:
          Negatief  Neutraal  Positief
Negatief         7         0        10
Neutraal         2         1         9
Positief         5         0        57


"""


def _written(lines, path):
    write_lines(lines, str(path))
    files = list(path.glob("run=*/*.txt"))
    assert len(files) == 1
    return files[0].read_text()


def test_mix_report_reads_as_published(spark, tmp_path):
    base = scored_from(spark, LABELS, [[40, 0, 5], [0, 0, 0], [4, 1, 40]], 9, "base")
    other = scored_from(spark, LABELS, [[25, 3, 13], [14, 8, 5], [23, 1, 119]], 9, "SecondHospital")
    scored = base.unionByName(other).withColumn("model_set", F.lit("SecondHospital"))
    classes = spark.createDataFrame([("SecondHospital", 9, LABELS)], "model_set string, run int, classes array<string>")
    assert _written(report_lines(scored, classes, "mix", "base"), tmp_path / "report") == EXPECTED_MIX


def test_own_report_reads_as_published(spark, tmp_path):
    scored = scored_from(spark, LABELS, [[7, 0, 10], [2, 1, 9], [5, 0, 57]], 0, "SecondHospital")
    scored = scored.withColumn("model_set", F.lit("SecondHospital"))
    classes = spark.createDataFrame([("SecondHospital", 0, LABELS)], "model_set string, run int, classes array<string>")
    assert _written(report_lines(scored, classes, "own"), tmp_path / "report") == EXPECTED_OWN


def test_report_of_disjoint_labels_and_binary_auc(spark):
    rows = [("base", "x", 0, 1, "C", "A", 0.2), ("base", "base", 0, 2, "A", "A", 0.1), ("base", "base", 0, 3, "B", "B", 0.9)]
    scored = spark.createDataFrame(rows, "model_set string, eval_set string, run int, row_id int, y string, yhat string, score double")
    classes = spark.createDataFrame([("base", 0, ["A", "B"])], "model_set string, run int, classes array<string>")
    lines = [r.line for r in report_lines(scored, classes, "transfer", "base").orderBy("eval_place", "part", "line_no").collect()]
    assert "AUC-ROC score (base): 1.0000" in lines
    assert lines[0] == "=== EVALUATIE OP BASE TESTDATA ===" and "--- Evaluatie op x (100% test) ---" in lines
    assert "Confusion Matrix x: \u26a0\ufe0f Geen overlappende klassen met base." in lines
    assert not any(line.startswith("AUC-ROC score x") for line in lines)


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {f.name for folder in folders for f in Path(folder).rglob("shuffle_*")}

    before, set_before = shuffled(), spark.conf.get(key, None)
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    table = durable(rows)
    assert not shuffled() - before
    assert spark.conf.get(key, None) == set_before
    assert table.agg(F.count("*"), F.sum("n")).first()[:] == (700, 5000)
    spark.conf.set(key, "false")
    try:
        durable(rows)
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key)
