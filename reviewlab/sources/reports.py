"""Result sinks: metric tables as Parquet, run reports and summaries as text.

Report lines are a table (``run``, ordering columns, ``line``) built from result rows, so rendering is a Spark job
whose size depends on the number of models and classes only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.student import fixed
from reviewlab.operators.comparison import paired_t, run_summary, welch_t
from reviewlab.operators.metrics import accuracy, classification_report, confusion_matrix, roc_auc

ORDER = ("run", "set_place", "eval_place", "part", "line_no")

# The wording and column widths of the reports.
REPORT_COLUMNS = ("precision", "recall", "f1-score", "support")
NAME_WIDTH = 12
NUMBER_WIDTH = 9
SUMMARY_TITLE = "=== STATISTISCHE SAMENVATTING OVER {runs} RUNS ==="
NO_OVERLAP = "\u26a0\ufe0f Geen overlappende klassen met {base}."
PROTOCOL_TITLES = {
    "transfer": "100% test",
    "fraction": "80% test",
    "mix": "externe testset",
    "own": "70/30 split",
}


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store result rows by protocol and model, so that one model's results are read without the others."""
    df.write.mode(mode).partitionBy("protocol", "model").parquet(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write report lines in order, one folder and file per run (one file where there are no runs)."""
    order = [name for name in ORDER if name in lines.columns]
    if "run" in lines.columns:
        ready = lines.repartition("run").sortWithinPartitions(*order).select("run", F.col("line").alias("value"))
        ready.write.mode(mode).partitionBy("run").text(path)
    else:
        lines.coalesce(1).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.mode(mode).text(path)


def _right(text: Column, width: int | Column) -> Column:
    """Right-align without ever cutting."""
    return F.concat(F.repeat(F.lit(" "), (F.lit(width) - F.length(text)).cast("int")), text)


def _left(text: Column, width: Column) -> Column:
    return F.concat(text, F.repeat(F.lit(" "), (width - F.length(text)).cast("int")))


def _report_lines(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The classification report: head, classes, then accuracy and the two averages."""
    rows = classification_report(scored, keys)
    names = rows.groupBy(*keys).agg(F.greatest(F.max(F.length("class")), F.lit(NAME_WIDTH)).alias("width"))
    digits = F.lit(2)
    blank = F.lit("")
    is_accuracy = (F.col("class") == "accuracy") & (F.col("place") > 0)
    numbers = [F.when(is_accuracy, blank).otherwise(fixed(F.col(c), digits)) for c in ("precision", "recall")]
    numbers.append(fixed(F.col("f1"), digits))
    cells = [_right(number, NUMBER_WIDTH) for number in (*numbers, F.col("support").cast("string"))]
    line = F.concat(_right(F.col("class"), F.col("width")), F.lit(" "), *[F.concat(F.lit(" "), cell) for cell in cells])
    body = rows.join(names, keys).select(
        *keys, F.concat(F.lit("2"), F.col("place").cast("string"), F.col("class")).alias("line_no"), line.alias("line")
    )
    head = F.concat(
        F.repeat(F.lit(" "), F.col("width")),
        F.lit(" "),
        *[F.lit(" " + title.rjust(NUMBER_WIDTH)) for title in REPORT_COLUMNS],
    )
    frame = F.array(
        F.struct(F.lit("0").alias("line_no"), head.alias("line")),
        F.struct(F.lit("1").alias("line_no"), blank.alias("line")),
        F.struct(F.lit("205").alias("line_no"), blank.alias("line")),
        F.struct(F.lit("3").alias("line_no"), blank.alias("line")),
    )
    rest = names.select(*keys, F.explode(frame).alias("f")).select(*keys, "f.*")
    # The blank before the accuracy line sorts after every class ("20...") and before it ("21...").
    rest = rest.withColumn("line_no", F.when(F.col("line_no") == "205", "20\U0010fffd").otherwise(F.col("line_no")))
    return body.unionByName(rest)


def _matrix_lines(matrix: DataFrame, keys: list[str], base: str) -> DataFrame:
    """The confusion matrix as an aligned table, or the note that there is none."""
    cells = matrix.withColumn("text", F.col("n").cast("string"))
    rows = cells.where(F.col("y").isNotNull())
    column = rows.groupBy(*keys, "yhat").agg(
        F.max(F.greatest(F.length("yhat"), F.length("text"))).alias("column_width"), F.max(F.length("y")).alias("index_width")
    )
    wide = rows.join(column, [*keys, "yhat"])

    def joined(text: Column) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct("yhat", F.concat(F.lit("  "), _right(text, F.col("column_width"))))))
        return F.array_join(F.transform(ordered, lambda cell: cell["col2"]), "")

    body = (
        wide.groupBy(*keys, "y", "index_width")
        .agg(joined(F.col("text")).alias("cells"))
        .select(
            *keys,
            F.concat(F.lit("2"), F.col("y")).alias("line_no"),
            F.concat(_left(F.col("y"), F.col("index_width")), F.col("cells")).alias("line"),
        )
    )
    head = (
        column.groupBy(*keys, "index_width")
        .agg(joined(F.col("yhat")).alias("cells"))
        .select(
            *keys,
            F.lit("1").alias("line_no"),
            F.concat(F.repeat(F.lit(" "), F.col("index_width")), F.col("cells")).alias("line"),
        )
    )
    return body.unionByName(head)


def report_lines(
    scored: DataFrame,
    classes: DataFrame,
    protocol: str,
    base: str | None = None,
    order: Sequence[str] = (),
    model: str = "",
) -> DataFrame:
    """Lines of the per-run reports of one protocol and model, as they are published.

    ``own``: a run title, then per set a report, matrix, AUC and two blank lines. ``mix`` and ``fraction``: per external
    a title, the base's and the external's part, and for ``mix`` both accuracies at the end. ``transfer``: the base's
    part under a title of its own, then the externals. ``order`` lists the sets in the order wanted; others follow by
    name.
    """
    keys = ["model_set", "eval_set", "run"]
    own, transfer = protocol == "own", protocol == "transfer"
    name, title = F.col("eval_set"), PROTOCOL_TITLES[protocol]
    of_base = F.coalesce(name == F.lit(base), F.lit(False))
    shown = F.when(of_base | F.lit(not transfer), F.concat(F.lit("("), name, F.lit(")"))).otherwise(name)
    if own:
        head = F.concat(F.lit("--- Evaluatie "), name, F.lit(f" ({title}) ---"))
    else:
        kind = f" ({model})" if model else ""
        base_head = f"=== EVALUATIE OP {base.upper()} TESTDATA{kind} ===" if transfer else f"--- Evaluatie op {base} testset ---"
        head = F.when(of_base, F.lit(base_head)).otherwise(F.concat(F.lit("--- Evaluatie op "), name, F.lit(f" ({title}) ---")))
    facts = accuracy(scored, keys).join(roc_auc(scored, classes, keys).select(*keys, "auc"), keys, "left")
    four = F.lit(4)
    score = fixed(F.col("auc"), four)
    auc = F.concat(F.lit("AUC-ROC: "), score) if own else F.concat(F.lit("AUC-ROC score "), shown, F.lit(": "), score)
    accuracy_line = F.concat(F.lit("Accuracy "), name, F.lit(": "), fixed(F.col("accuracy"), four))

    matrix = confusion_matrix(scored, classes, restrict=False, keys=keys)
    if not own:
        restricted = confusion_matrix(scored, classes, restrict=True, keys=keys).where(~of_base)
        matrix = matrix.where(of_base).unionByName(restricted)
    overlaps = matrix.groupBy(*keys).agg(F.max(F.col("y").isNotNull()).alias("overlaps"))
    facts = facts.join(overlaps, keys, "left")
    matrix_title = F.lit("Confusion Matrix:") if own else F.concat(F.lit("Confusion Matrix "), shown, F.lit(":"))
    none = F.lit(" " + NO_OVERLAP.format(base=base))
    matrix_title = F.concat(matrix_title, F.when(F.coalesce("overlaps", F.lit(False)), F.lit("")).otherwise(none))

    def part(number: int, frame: DataFrame) -> DataFrame:
        return frame.select(*keys, F.lit(number).alias("part"), "line_no", "line")

    def single(number: int, text: Column, when: Column | None = None, times: int = 1) -> DataFrame:
        rows = facts if when is None else facts.where(when)
        numbered = rows.select(*keys, F.explode(F.array(*[F.lit(str(i)) for i in range(times)])).alias("line_no"), text.alias("line"))
        return part(number, numbered)

    blank, has_auc = F.lit(""), F.col("auc").isNotNull()
    pieces = [
        single(0, head),
        part(1, _report_lines(scored, keys)),
        single(2, blank, F.lit(not own)),
        single(3, matrix_title),
        part(4, _matrix_lines(matrix.where(F.col("y").isNotNull()), keys, base or "")),
        single(5, blank, has_auc & F.lit(not own)),
        single(6, auc, has_auc),
    ]
    if own:
        pieces.append(single(7, blank, times=2))
    elif transfer:
        pieces.append(single(7, blank, of_base))
    lines = pieces[0]
    for piece in pieces[1:]:
        lines = lines.unionByName(piece)
    known = F.array(*[F.lit(value) for value in order]) if order else F.array().cast("array<string>")

    def place(col: str, first: Column) -> Column:
        rank = F.array_position(known, F.col(col))
        listed = F.when(rank > 0, F.lpad(rank.cast("string"), 6, "0")).otherwise(F.concat(F.lit("x"), F.col(col)))
        return F.when(first, F.lit("")).otherwise(listed)

    ordered = ["run", "set_place", "eval_place", "part", "line_no", "line"]
    whole = lines.select(
        "run", place("model_set", F.lit(False)).alias("set_place"), place("eval_set", of_base).alias("eval_place"),
        "part", "line_no", "line",
    )
    run_title = F.concat(F.lit("=== Run "), (F.col("run") + 1).cast("string"))
    sets = facts.select("run", "model_set").distinct()
    if own:
        text = F.concat(run_title, F.lit(" Evaluaties ==="))
        titles = sets.select("run", blank.alias("set_place"), blank.alias("eval_place"), F.lit(-1).alias("part"), F.lit("0").alias("line_no"), text.alias("line"))
        whole = whole.unionByName(titles.distinct().select(ordered))
    elif not transfer:
        placed = sets.withColumn("set_place", place("model_set", F.lit(False)))
        firsts = placed.groupBy("run").agg(F.min("set_place").alias("first"))
        text = F.concat(run_title, F.lit(" met extra dataset: "), F.col("model_set"), F.lit(" ==="))
        above = F.when(F.col("set_place") == F.col("first"), F.array(blank, blank, text, blank)).otherwise(F.array(blank, text, blank))
        titles = placed.join(firsts, "run").select("run", "set_place", F.posexplode(above).alias("line_no", "line"))
        titles = titles.withColumns({"eval_place": blank, "part": F.lit(-1), "line_no": F.col("line_no").cast("string")})
        whole = whole.unionByName(titles.select(ordered))
    if protocol == "mix":
        after = facts.select(
            "run", place("model_set", F.lit(False)).alias("set_place"), F.lit("~").alias("eval_place"), F.lit(8).alias("part"),
            place("eval_set", of_base).alias("line_no"), accuracy_line.alias("line"),
        )
        whole = whole.unionByName(after)
    return whole


def mix_summary_lines(metrics: DataFrame, base: str) -> DataFrame:
    """Summary of a protocol with paired tests: per external the two means and deviations, and the test."""
    rows = metrics.where(F.col("metric") == "accuracy")
    stats = run_summary(rows, ["model_set", "eval_set"])
    tests = paired_t(rows, base)
    sides = stats.groupBy("model_set").agg(
        *[
            F.max(F.when(F.col("eval_set") == base if own else F.col("eval_set") != base, F.col(c))).alias(f"{c}_{side}")
            for side, own in (("a", True), ("b", False))
            for c in ("mean", "std")
        ]
    )
    four, six = F.lit(4), F.lit(6)

    def mean_line(name: Column, side: str) -> Column:
        mean, std = fixed(F.col(f"mean_{side}"), four), fixed(F.col(f"std_{side}"), four)
        return F.concat(name, F.lit(" (mean acc)= "), mean, F.lit(", std= "), std)

    ready = sides.join(tests.select("model_set", "t", "p"), "model_set")
    test = F.concat(F.lit("Gepaarde t-test: t-stat= "), fixed("t", four), F.lit(", p-value= "), fixed("p", six))
    lines = F.array(
        F.concat(F.lit(f"--- Vergelijking {base} vs "), F.col("model_set"), F.lit(" ---")),
        mean_line(F.lit(base), "a"),
        mean_line(F.col("model_set"), "b"),
        F.coalesce(test, F.lit("Gepaarde t-test: t-stat= nan, p-value= nan")),
        F.lit(""),
    )
    body = ready.select(F.col("model_set").alias("set_place"), F.posexplode(lines).alias("line_no", "line"))
    runs = rows.agg(F.countDistinct("run").alias("runs"))
    return _titled(runs, blank=True).unionByName(body)


def own_summary_lines(metrics: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Summary of the own-train protocol: mean and deviation per dataset, then the Welch tests."""
    rows = metrics.where(F.col("metric") == "accuracy")
    four, six = F.lit(4), F.lit(6)
    means = run_summary(rows, ["eval_set"]).select(
        F.concat(F.lit("1"), F.col("eval_set")).alias("set_place"),
        F.lit(0).alias("line_no"),
        F.concat(
            "eval_set", F.lit(": Mean Accuracy = "), fixed("mean", four), F.lit(", Std Dev = "), fixed("std", four)
        ).alias("line"),
    )
    places = F.array(*[F.lit(f"{a}\t{b}") for a, b in pairs])
    tests = welch_t(rows, pairs).select(
        F.lit("2").alias("set_place"),
        F.array_position(places, F.concat("a", F.lit("\t"), "b")).cast("int").alias("line_no"),
        F.concat(
            F.lit("T-test "),
            "a",
            F.lit(" vs "),
            "b",
            F.lit(": t = "),
            F.coalesce(fixed("t", four), F.lit("nan")),
            F.lit(", p = "),
            F.coalesce(fixed("p", six), F.lit("nan")),
        ).alias("line"),
    )
    runs = rows.agg(F.countDistinct("run").alias("runs"))
    return _titled(runs, blank=False).unionByName(means).unionByName(tests)


def _titled(runs: DataFrame, blank: bool) -> DataFrame:
    before, after = SUMMARY_TITLE.split("{runs}")
    title = F.concat(F.lit(before), F.col("runs").cast("string"), F.lit(after))
    lines = F.array(title, F.lit("")) if blank else F.array(title)
    return runs.select(F.lit("").alias("set_place"), F.posexplode(lines).alias("line_no", "line"))
