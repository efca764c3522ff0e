import math

import pytest

from reviewlab.functions.student import _two_sided, fixed, paired_p_ten_runs, t_pvalue
from reviewlab.operators.comparison import compare_models, paired_t, run_summary, welch_t
from reviewlab.sources.reports import mix_summary_lines, own_summary_lines
from pyspark.sql import functions as F

# Published test results as right answers per run.
MIX = {
    "Feedback": ([74, 77, 81, 84, 72, 71, 80, 75, 74, 82], 90, [14, 13, 14, 14, 15, 18, 14, 17, 16, 12], 22),
    "SecondHospital": ([72, 77, 75, 85, 73, 74, 80, 77, 76, 82], 90, [152, 148, 156, 155, 155, 143, 151, 147, 144, 144], 211),
    "Amazon": ([72, 76, 75, 84, 73, 74, 81, 75, 77, 82], 90, [262, 259, 263, 247, 251, 253, 262, 252, 254, 249], 304),
}
OWN = {
    "base": ([73, 77, 75, 85, 73, 74, 81, 77, 76, 82], 90),
    "Feedback": ([24, 22, 25, 21, 25, 25, 23, 23, 22, 20], 34),
    "SecondHospital": ([65, 65, 66, 67, 65, 68, 72, 65, 62, 68], 91),
    "Amazon": ([102, 102, 102, 102, 101, 102, 103, 101, 100, 102], 119),
}
PAIRS = [("base", "Feedback"), ("base", "SecondHospital"), ("base", "Amazon"), ("Feedback", "SecondHospital")]
SCHEMA = "model_set string, eval_set string, run int, metric string, value double"


@pytest.fixture(scope="module")
def mix(spark):
    rows = []
    for name, (base, n_base, other, n_other) in MIX.items():
        for run in range(10):
            rows.append((name, "base", run, "accuracy", base[run] / n_base))
            rows.append((name, name, run, "accuracy", other[run] / n_other))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def own(spark):
    rows = [(d, d, run, "accuracy", right[run] / n) for d, (right, n) in OWN.items() for run in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


def test_published_means_and_deviations(mix, own):
    four = F.lit(4)
    texts = [fixed(F.col(c), four).alias(c) for c in ("mean", "std")]
    got = {(r.model_set, r.eval_set): (r[2], r[3]) for r in run_summary(mix).select("model_set", "eval_set", *texts).collect()}
    assert got[("Feedback", "base")] == ("0.8556", "0.0500") and got[("Feedback", "Feedback")] == ("0.6682", "0.0831")
    assert got[("Amazon", "Amazon")] == ("0.8395", "0.0192") and got[("SecondHospital", "base")] == ("0.8567", "0.0458")
    got = {r.eval_set: (r[1], r[2]) for r in run_summary(own).select("eval_set", *texts).collect()}
    assert got == {
        "base": ("0.8589", "0.0454"),
        "Feedback": ("0.6765", "0.0519"),
        "SecondHospital": ("0.7286", "0.0293"),
        "Amazon": ("0.8546", "0.0069"),
    }


def test_published_paired_tests(mix):
    rows = paired_t(mix, "base").withColumn("p9", paired_p_ten_runs(F.col("t"))).collect()
    assert {r.b: (f"{r.t:.4f}", f"{r.p:.6f}") for r in rows} == {
        "Feedback": ("4.8171", "0.000951"),
        "SecondHospital": ("9.0654", "0.000008"),
        "Amazon": ("0.8501", "0.417294"),
    }
    assert all(r.df == 9 and r.p9 == pytest.approx(r.p, abs=1e-9) for r in rows)


def test_published_welch_tests(own):
    rows = {(r.a, r.b): (f"{r.t:.4f}", f"{r.p:.6f}") for r in welch_t(own, PAIRS).collect()}
    assert rows == {
        ("base", "Feedback"): ("8.3697", "0.000000"),
        ("base", "SecondHospital"): ("7.6275", "0.000001"),
        ("base", "Amazon"): ("0.2940", "0.775153"),
        ("Feedback", "SecondHospital"): ("-2.7647", "0.015025"),
    }


def test_constant_differences_give_null(spark):
    rows = [("m", s, run, "accuracy", v) for run in range(3) for s, v in (("base", 0.5), ("x", 0.25))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.t, r.p) for r in paired_t(df, "base").collect()] == [(None, None)]
    assert [(r.t, r.p) for r in welch_t(df, [("base", "x")]).collect()] == [(None, None)]


def test_p_values_against_closed_forms(spark):
    for t in (0.0, 0.3, 1.0, 2.5, 8.0, 40.0):
        assert _two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9, abs=1e-12)
        assert _two_sided(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-7, abs=1e-12)
    df = spark.createDataFrame([(2.262157, 9.0), (None, 9.0)], "t double, df double")
    got = [r[0] for r in df.select(t_pvalue("t", "df")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None


def test_summaries_read_as_published(mix, own):
    lines = [r.line for r in mix_summary_lines(mix.where("model_set = 'Feedback'"), "base").orderBy("set_place", "line_no").collect()]
    assert lines == [
        "=== STATISTISCHE SAMENVATTING OVER 10 RUNS ===",
        "",
        "--- Vergelijking base vs Feedback ---",
        "base (mean acc)= 0.8556, std= 0.0500",
        "Feedback (mean acc)= 0.6682, std= 0.0831",
        "Gepaarde t-test: t-stat= 4.8171, p-value= 0.000951",
        "",
    ]
    lines = [r.line for r in own_summary_lines(own, PAIRS).orderBy("set_place", "line_no").collect()]
    assert lines[0] == "=== STATISTISCHE SAMENVATTING OVER 10 RUNS ==="
    assert "base: Mean Accuracy = 0.8589, Std Dev = 0.0454" in lines[1:5]
    assert lines[5:] == [
        "T-test base vs Feedback: t = 8.3697, p = 0.000000",
        "T-test base vs SecondHospital: t = 7.6275, p = 0.000001",
        "T-test base vs Amazon: t = 0.2940, p = 0.775153",
        "T-test Feedback vs SecondHospital: t = -2.7647, p = 0.015025",
    ]


def test_compare_models(own):
    both = own.withColumn("model", F.lit("KNN")).unionByName(own.withColumn("model", F.lit("RF")).withColumn("value", F.lit(0.5)))
    rows = {r.eval_set: (round(r.KNN, 4), r.RF) for r in compare_models(both, ["KNN", "RF"]).collect()}
    assert rows["base"] == (0.8589, 0.5) and len(rows) == 4
