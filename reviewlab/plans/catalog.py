"""The catalogue of checkable queries: every operator on the shared test tables, whole tables only.

Floats are rounded to six decimals and counts are BIGINT, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType

from reviewlab.functions.scores import argmax_label, binarise, softmax
from reviewlab.functions.student import paired_p_ten_runs
from reviewlab.functions.text import cap_tokens, clean_text
from reviewlab.operators import densenet, linear, trees
from reviewlab.operators.comparison import compare_models, paired_t, run_summary, welch_t
from reviewlab.operators.densenet import adam_logistic, plain_network, short_network, weighted_network
from reviewlab.operators.embedding import (
    HashedTfEmbedder,
    ModelEmbedder,
    distinct_texts,
    embed,
    embed_cached,
    transform_runs,
)
from reviewlab.operators.filters import (
    class_counts,
    class_lists,
    clean_reviews,
    decode_labels,
    drop_rare_class,
    filter_min_length,
    index_labels,
)
from reviewlab.operators.folds import Folds
from reviewlab.operators.metrics import (
    accuracy,
    auc_ready,
    classification_report,
    confusion_matrix,
    confusion_wide,
    label_counts,
    roc_auc,
    run_metrics,
    shared_labels,
)
from reviewlab.operators.neighbors import class_shares, nearest_neighbors
from reviewlab.operators.sampling import (
    allocate_quota,
    explode_runs,
    group_sizes,
    in_run,
    stratified_split,
    train_rows_for_target,
    train_rows_for_test_fraction,
    with_runs,
)
from reviewlab.operators.weights import balanced_weights, train_class_counts, with_weights
from reviewlab.plans.protocols import Knn, accuracy_metrics, make_folds, own_train_eval, retrain_eval
from reviewlab.session import durable, shared_folder
from reviewlab.sources.reports import mix_summary_lines, own_summary_lines, report_lines, write_metrics
from reviewlab.sources.tables import VECTOR_SETS, Source, ingest_registry, points_from_embeddings, reviews_from_documents

Query = Callable[[SparkSession, str], DataFrame]

RUNS = 10
BASE = VECTOR_SETS[0]
PAIRS = [("base", "ext1"), ("base", "ext2"), ("base", "ext3"), ("ext1", "ext2")]
LABELS = ["Negatief", "Neutraal", "Positief"]


def _plain(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, floats rounded."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, IntegerType):
            column = column.cast("bigint")
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            column = F.round(column.cast("double"), 6)
        columns.append(column.alias(f.name))
    return df.select(columns)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_from_documents(spark, sf_dir)


def _long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_min_length(clean_reviews(_raw(spark, sf_dir)))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_rare_class(_long_enough(spark, sf_dir))


def _review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews without their texts: one read of the documents, whatever is counted, split and marked afterwards."""
    return drop_rare_class(durable(_long_enough(spark, sf_dir).select("dataset", "row_id", "sentiment")))


def _text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(_reviews(spark, sf_dir), HashedTfEmbedder()).select(
        "dataset", "row_id", F.col("sentiment").alias("label"), "embedding"
    )


def _folds(spark: SparkSession, sf_dir: str, protocol: str = "own") -> Folds:
    base = None if protocol == "own" else BASE
    return make_folds(points_from_embeddings(spark, sf_dir), protocol, base, RUNS)


def _scored(spark: SparkSession, sf_dir: str, protocol: str = "own", weights: str = "uniform") -> DataFrame:
    """Scored rows of the neighbour model."""
    return Knn(weights=weights).score(_folds(spark, sf_dir, protocol))


def _scored_with_classes(
    spark: SparkSession, sf_dir: str, protocol: str = "own", weights: str = "uniform"
) -> tuple[DataFrame, DataFrame]:
    """Scored rows of the neighbour model and the class lists of its models."""
    folds = _folds(spark, sf_dir, protocol)
    return Knn(weights=weights).score(folds), folds.classes


# -- cleaning, filters, labels --------------------------------------------------------------------


def clean_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_reviews(_raw(spark, sf_dir)).select("dataset", "row_id", "sentiment", "review")


def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several named sources as one table: here one source per document source value and one of stored vectors."""
    text = _raw(spark, sf_dir).select("dataset", F.col("sentiment").alias("label"), "row_id")
    return text.unionByName(points_from_embeddings(spark, sf_dir).select("dataset", "label", "row_id"))


def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews as one delimited file set per dataset, read again through a registry and its ingest."""
    raw = _raw(spark, sf_dir)
    place = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    names = [r["dataset"] for r in raw.select("dataset").distinct().orderBy("dataset").collect()]
    sources = [Source(name, f"{place}/{n}", ",;"[n % 2]) for n, name in enumerate(names)]
    for name, path, sep in sources:
        one = raw.where(F.col("dataset") == name).select("sentiment", "review")
        one.write.csv(path, sep=sep, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return ingest_registry(spark, sources, f"{place}/table").select("dataset", "sentiment", "review")


def short_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _long_enough(spark, sf_dir)
    return _plain(kept.select("dataset", "row_id", F.length("review").alias("n_chars")))


def rare_class_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("dataset", "row_id", "sentiment")


def rare_any_class_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_rare_class(_long_enough(spark, sf_dir), rare=None).select("dataset", "row_id", "sentiment")


def class_count_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_counts(_long_enough(spark, sf_dir))


def class_list_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lists(_reviews(spark, sf_dir)).select("dataset", F.array_join("classes", ",").alias("classes"))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_labels(index_labels(_reviews(spark, sf_dir)))
    flag = binarise(F.col("sentiment"), F.col("classes")).alias("positive")
    return _plain(coded.select("dataset", "row_id", "sentiment", "label_index", "label", flag))


# -- sampling -------------------------------------------------------------------------------------


def _parts(df: DataFrame) -> DataFrame:
    return _plain(explode_runs(df, RUNS).select("dataset", "row_id", "run", "part"))


def strat_split_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(stratified_split(_review_keys(spark, sf_dir), runs=RUNS, test_fraction="0.3"))


def strat_split_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(stratified_split(_review_keys(spark, sf_dir), runs=RUNS, test_fraction="0.8"))


def strat_sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of training rows, or 90 % where a dataset has no more rows than that."""
    target = train_rows_for_target(F.col("n_group"), F.lit(50))
    return _parts(stratified_split(_review_keys(spark, sf_dir), n_train=target, runs=RUNS))


def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = group_sizes(_review_keys(spark, sf_dir), ["dataset"])
    n_train = train_rows_for_test_fraction(F.col("n_group"), "0.3")
    return _plain(allocate_quota(sizes.withColumn("n_train", n_train), ["dataset"]))


def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(with_runs(_review_keys(spark, sf_dir).select("dataset", "row_id"), RUNS))


def _fold_parts(spark: SparkSession, sf_dir: str, protocol: str) -> DataFrame:
    """One row per model set, run and row: in the training union or in the test remainder."""
    parts = explode_runs(_folds(spark, sf_dir, protocol).rows, RUNS)
    return _plain(parts.select("model_set", "eval_set", "row_id", "label", "run", "part"))


def mix_70_30_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_parts(spark, sf_dir, "mix")


def fraction_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_parts(spark, sf_dir, "fraction")


def transfer_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_parts(spark, sf_dir, "transfer")


def mix_fallback_90_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 70:30 mix over reviews, where the small datasets fall back to a 90:10 split."""
    points = _review_keys(spark, sf_dir).select("dataset", "row_id", F.col("sentiment").alias("label"))
    parts = explode_runs(make_folds(points, "mix", "en", RUNS).rows, RUNS)
    return _plain(parts.select("model_set", "eval_set", "row_id", "label", "run", "part"))


# -- weights --------------------------------------------------------------------------------------


def balanced_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = train_class_counts(_folds(spark, sf_dir, "mix").rows, runs=RUNS)
    return _plain(balanced_weights(counts))


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _folds(spark, sf_dir)
    rows = explode_runs(folds.rows, RUNS).where(F.col("part") == "train")
    return _plain(with_weights(rows, folds.weights).select("model_set", "run", "row_id", "label", "weight"))


def model_class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _folds(spark, sf_dir, "mix").classes
    return _plain(lists.withColumn("classes", F.array_join("classes", ",")))


# -- nearest neighbours ---------------------------------------------------------------------------


def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_neighbors(_folds(spark, sf_dir).rows, 5, RUNS)
    return _plain(found.select("model_set", "run", "row_id", "place", "neighbor_id", "label", "distance"))


def knn_predict_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_scored(spark, sf_dir))


def knn_predict_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_scored(spark, sf_dir, weights="distance"))


def knn_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _folds(spark, sf_dir)
    shares = class_shares(nearest_neighbors(folds.rows, 5, RUNS), folds.classes, "distance")
    long = shares.select("model_set", "run", "row_id", F.explode(F.arrays_zip("classes", "shares")).alias("c"))
    return _plain(long.select("model_set", "run", "row_id", F.col("c.classes").alias("label"), F.col("c.shares").alias("share")))


# -- metrics --------------------------------------------------------------------------------------


def match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return _plain(scored.select("model_set", "run", "row_id", (F.col("y") == F.col("yhat")).alias("matched")))


def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(accuracy(_scored(spark, sf_dir)))


def confusion_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, classes = _scored_with_classes(spark, sf_dir)
    return _plain(confusion_matrix(scored, classes).drop("note"))


def confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, classes = _scored_with_classes(spark, sf_dir)
    return _plain(confusion_wide(confusion_matrix(scored, classes), LABELS))


def confusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, classes = _scored_with_classes(spark, sf_dir, "transfer")
    return _plain(confusion_matrix(scored, classes, restrict=True))


def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test labels, model classes and what both have; and whether an AUC is due."""
    scored, classes = _scored_with_classes(spark, sf_dir, "transfer")
    counts = label_counts(scored)
    keys = ["model_set", "eval_set", "run"]
    lists = shared_labels(counts, classes, keys)
    due = auc_ready(scored, classes).select(*keys, F.lit(True).alias("due"))
    joined = lists.join(due, keys, "left").withColumn("due", F.coalesce("due", F.lit(False)))
    names = [F.array_join(c, ",").alias(c) for c in ("test_labels", "classes", "labels")]
    return _plain(joined.select(*keys, *names, "due"))


def classification_report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(classification_report(_scored(spark, sf_dir, "mix")).drop("place"))


def roc_auc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, classes = _scored_with_classes(spark, sf_dir, "mix", "distance")
    return _plain(roc_auc(scored, classes))


def roc_auc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of every vector's first component as a score for its label, per dataset."""
    points = points_from_embeddings(spark, sf_dir).where(F.col("label") != LABELS[1])
    rows = points.select(
        F.col("dataset").alias("eval_set"), F.col("label").alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("score")
    )
    return _plain(roc_auc(rows, [LABELS[0], LABELS[2]], ["eval_set"]))


def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three vector components as logits: class probabilities and the winner."""
    classes = F.array(*[F.lit(label) for label in LABELS])
    points = points_from_embeddings(spark, sf_dir).withColumn("p", softmax(F.slice("embedding", 1, 3)))
    shares = [F.get("p", F.lit(i)).alias(f"p_{label.lower()}") for i, label in enumerate(LABELS)]
    return _plain(points.select("row_id", *shares, argmax_label(F.col("p"), classes).alias("yhat")))


# -- statistics over runs -------------------------------------------------------------------------


def _accuracies(spark: SparkSession, sf_dir: str, protocol: str) -> DataFrame:
    return accuracy_metrics(_scored(spark, sf_dir, protocol))


def own_train_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the accuracy over ten runs, trained and tested within each dataset."""
    return _plain(run_summary(_accuracies(spark, sf_dir, "own")).drop("metric"))


def retrain_mix_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(run_summary(_accuracies(spark, sf_dir, "mix")).drop("metric"))


def retrain_frac_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(run_summary(_accuracies(spark, sf_dir, "fraction")).drop("metric"))


def transfer_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(run_summary(_accuracies(spark, sf_dir, "transfer")).drop("metric"))


def run_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, classes = _scored_with_classes(spark, sf_dir)
    return _plain(run_metrics(durable(scored), classes))


def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric table of a protocol, written twice to the same place and read again."""
    metrics, _, _ = own_train_eval(points_from_embeddings(spark, sf_dir), [Knn()], PAIRS, RUNS)
    place, metrics = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}", durable(metrics)
    for _ in range(2):
        write_metrics(metrics, place)
    return _plain(spark.read.parquet(place).select("protocol", "model", "model_set", "eval_set", "run", "metric", "value"))


def paired_t_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(paired_t(_accuracies(spark, sf_dir, "mix"), BASE).drop("metric"))


def paired_t_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = paired_t(_accuracies(spark, sf_dir, "mix"), BASE)
    return _plain(tests.select("a", "b", "t", paired_p_ten_runs(F.col("t")).alias("p")))


def welch_t_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(welch_t(_accuracies(spark, sf_dir, "own"), PAIRS).drop("metric"))


def compare_knn_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both neighbour models side by side over the own-train protocol."""
    folds = _folds(spark, sf_dir).stored()
    rows = None
    for name, weights in (("uniform", "uniform"), ("distance", "distance")):
        part = Knn(weights=weights).score(folds).withColumn("model", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    facts = accuracy_metrics(rows).withColumn("protocol", F.lit("own"))
    return _plain(compare_models(facts, ["uniform", "distance"]))


# -- reports --------------------------------------------------------------------------------------


def run_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, classes = _scored_with_classes(spark, sf_dir)
    lines = report_lines(durable(scored), classes, "own", order=VECTOR_SETS)
    order = Window.partitionBy("run").orderBy("set_place", "eval_place", "part", "line_no")
    return _plain(lines.select("run", F.row_number().over(order).alias("line_no"), "line"))


def own_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = durable(_accuracies(spark, sf_dir, "own"))
    return own_summary_lines(facts, PAIRS).select("set_place", F.col("line_no").cast("bigint").alias("line_no"), "line")


def mix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = durable(_accuracies(spark, sf_dir, "mix"))
    return mix_summary_lines(facts, BASE).select("set_place", F.col("line_no").cast("bigint").alias("line_no"), "line")


# -- embedding ------------------------------------------------------------------------------------


def _all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cleaned text, labelled or not."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("doc_id").alias("row_id"), clean_text(F.col("text")).alias("review"))


def token_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cap_tokens(F.col("review"), 512)
    rows = _all_texts(spark, sf_dir).withColumn("words", words)
    return _plain(
        rows.select(
            "row_id",
            F.size("words").alias("n_words"),
            F.md5(F.array_join("words", " ")).alias("words_md5"),
        )
    )


def _entries(rows: DataFrame, *columns: str) -> DataFrame:
    """The entries of the vectors that are not zero."""
    spread = rows.select(*columns, F.posexplode("embedding").alias("place", "value"))
    return _plain(spread.where(F.col("value") != 0))


def embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed term frequencies of every document."""
    return _entries(embed(_all_texts(spark, sf_dir), HashedTfEmbedder(normalise=False)), "row_id")


def embed_hashed_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed tf-idf of the reviews, with the weights learned on the training part of every run in turn."""
    split = durable(stratified_split(_reviews(spark, sf_dir), runs=RUNS).select("row_id", "review", "train_mask"))
    embedders = HashedTfEmbedder(width=64, precision="double").fit_runs(split, "train_mask", RUNS)
    per_run = transform_runs(split, embedders).select("row_id", F.posexplode("embeddings").alias("run", "embedding"))
    return _entries(per_run, "run", "row_id")


def embed_user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen user model in Arrow batches: a fixed projection of the counts of some characters."""

    def load():
        import numpy as np

        letters = ["a", "e", "i", "n", " "]
        projection = np.array([[1, 0], [1, 0], [1, 0], [0, 2], [0, 1]], dtype="float32")

        def model(texts):
            counts = np.stack([np.char.count(texts.astype(str), letter) for letter in letters], axis=1)
            return counts.astype("float32") @ projection

        return model

    rows = embed(_all_texts(spark, sf_dir), ModelEmbedder(load))
    return _plain(rows.select("row_id", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(1)).alias("second")))


def embed_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to encode when copies are encoded once."""
    texts = distinct_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")
    return _plain(texts.select("content_key", F.length("text").alias("n_chars")))


def embed_cached_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of distinct texts through the store: embedded once, found again for every document by content."""
    texts = _all_texts(spark, sf_dir)
    embedder = HashedTfEmbedder(width=16, normalise=False)
    store = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    return _entries(embed_cached(texts, embedder, store, "hashed-16"), "row_id", "content_key")


# -- fitted models --------------------------------------------------------------------------------


def _text_folds(spark: SparkSession, sf_dir: str, protocol: str = "own", base: str | None = None) -> Folds:
    return make_folds(_text_points(spark, sf_dir), protocol, base, RUNS).stored()


def _scores(rows: DataFrame, digits: int) -> DataFrame:
    columns = ["model_set", "eval_set", "run", "row_id", "y", "yhat"]
    return _plain(rows.select(*columns, F.round("score", digits).alias("score")))


def _exact_fit(model, digits: int = 6) -> Query:
    """Fit and score over all runs: labels and scores of every test row, which SQL finds on its own."""
    return lambda spark, sf_dir: _scores(model.score(_text_folds(spark, sf_dir)), digits)


def _stored_fit(model, transform: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 6) -> Query:
    """Fit on the base, keep the models as files, read them again and score the other datasets with them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folds = _text_folds(spark, sf_dir, "transfer", "en")
        place = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
        model.fit(folds).write.parquet(place)
        return _scores(transform(spark.read.parquet(place), folds.rows.where(F.col("test_mask") != 0)), digits)

    return query


LEARNED = 0.6


def _fitted(model, transform: Callable[[DataFrame, DataFrame], DataFrame], measured: bool = True) -> Query:
    """Fit once and score over all runs; every test row with its checks.

    ``label_known``: the predicted label is a class of its model; ``score_fits``: there is a score in [0, 1] just where the
    model has two classes; ``argmax_agrees``: that score points to the label; ``learned``: over the training rows of the
    model, the share that it gets right, averaged over the classes, is over ``LEARNED`` (a predictor that ignores the rows
    has 1 / number of classes; not ``measured`` where a model stops before that can be asked of it).
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folds = _text_folds(spark, sf_dir)
        models = model.fit(folds)
        seen = transform(models, folds.rows.withColumn("test_mask", F.col("train_mask")).where(F.col("test_mask") != 0))
        recall = seen.groupBy("model_set", "run", "y").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("recall"))
        learned = recall.groupBy("model_set", "run").agg((F.avg("recall") > LEARNED).alias("learned"))
        rows = transform(models, folds.rows.where(F.col("test_mask") != 0))
        rows = rows.join(folds.classes, ["model_set", "run"], "left").join(learned, ["model_set", "run"], "left")
        checks = [*_label_checks(), _argmax_agrees()]
        if measured:
            checks.append(F.coalesce("learned", F.lit(False)).alias("learned"))
        return _plain(rows.select("model_set", "eval_set", "run", "row_id", "y", *checks))

    return query


def _label_checks() -> list[Column]:
    known = F.coalesce(F.array_contains("classes", F.col("yhat")), F.lit(False))
    fits = F.when(F.size("classes") == 2, F.coalesce(F.col("score").between(0, 1), F.lit(False))).otherwise(F.col("score").isNull())
    return [known.alias("label_known"), fits.alias("score_fits")]


def _argmax_agrees() -> Column:
    score, second = F.col("score"), F.col("yhat") == F.get("classes", F.lit(1))
    agrees = (F.size("classes") != 2) | (F.abs(score - 0.5) < 1e-6) | ((score > 0.5) == second)
    return F.coalesce(agrees, F.lit(False)).alias("argmax_agrees")


def fit_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support vector machines of all runs. ``optimal``: the duality gap of every pair of classes, found again from the
    stored weights and the training rows, is at most a thousandth of the objective."""
    folds, model = _text_folds(spark, sf_dir), linear.linear_svm()
    models = model.fit(folds)
    gaps = model.certificates(models, folds).select("model_set", "run", "classes", (F.col("measure") <= 1e-3).alias("optimal"))
    rows = linear.transform(models, folds.rows.where(F.col("test_mask") != 0)).join(gaps, ["model_set", "run"], "left")
    return _plain(rows.select("model_set", "eval_set", "run", "row_id", "y", *_label_checks(), F.coalesce("optimal", F.lit(False)).alias("optimal")))


def own_train_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of a tree's accuracy over ten runs, through the own-train protocol."""
    _, summary, _ = own_train_eval(_text_points(spark, sf_dir), [trees.decision_tree()], [("en", "de")], RUNS)
    return _plain(summary.where("metric = 'accuracy'").select("model_set", "eval_set", "mean", "std", "runs"))


def retrain_mix_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired tests of logistic regression, retrained with a 70:30 mix per external dataset."""
    _, tests = retrain_eval(_text_points(spark, sf_dir), "en", [linear.softmax_logistic()], RUNS)
    return _plain(tests.select("a", "b", "model_set", "kind", "mean_difference", "t", "df", "p"))


def own_train_knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour votes over the hashed texts."""
    folds = make_folds(_text_points(spark, sf_dir), "own", None, RUNS).stored()
    return _plain(Knn().score(folds).select("model_set", "eval_set", "run", "row_id", "y", "yhat", "score"))


def compare_fitted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of several model kinds over the reviews, own-train, ten runs."""
    folds = make_folds(_text_points(spark, sf_dir), "own", None, RUNS).stored()
    models = [Knn(), trees.decision_tree(), short_network()]
    rows = None
    for model in models:
        part = model.score(folds).withColumn("model", F.lit(model.name))
        rows = part if rows is None else rows.unionByName(part)
    facts = accuracy_metrics(rows).withColumn("protocol", F.lit("own"))
    return _plain(compare_models(facts, [model.name for model in models]))


QUERIES: dict[str, Query] = {
    "clean_reviews": clean_text_columns,
    "registry_union": registry_union,
    "registry_files": registry_files,
    "short_text_filter": short_text_filter,
    "rare_class_drop": rare_class_drop,
    "rare_any_class_drop": rare_any_class_drop,
    "class_counts": class_count_table,
    "class_lists": class_list_table,
    "label_encode": label_encode,
    "strat_split_30": strat_split_30,
    "strat_split_80": strat_split_80,
    "strat_sample_fixed": strat_sample_fixed,
    "quota_allocation": quota_allocation,
    "repeated_runs": repeated_runs,
    "mix_70_30_train": mix_70_30_train,
    "fraction_train": fraction_train,
    "transfer_train": transfer_train,
    "mix_fallback_90_10": mix_fallback_90_10,
    "balanced_weights": balanced_weight_table,
    "sample_weights": sample_weights,
    "model_classes": model_class_lists,
    "knn_neighbors": knn_neighbors,
    "knn_predict_uniform": knn_predict_uniform,
    "knn_predict_distance": knn_predict_distance,
    "knn_proba": knn_proba,
    "match_flags": match_flags,
    "accuracy": accuracy_table,
    "confusion_matrix": confusion_full,
    "confusion_wide": confusion_pivot,
    "confusion_overlap": confusion_overlap,
    "label_overlap": label_overlap,
    "classification_report": classification_report_table,
    "roc_auc": roc_auc_table,
    "roc_auc_vectors": roc_auc_vectors,
    "softmax_argmax": softmax_argmax,
    "own_train_knn": own_train_knn,
    "retrain_mix_knn": retrain_mix_knn,
    "retrain_frac_knn": retrain_frac_knn,
    "transfer_knn": transfer_knn,
    "run_metrics": run_metrics_table,
    "stored_metrics": stored_metrics,
    "paired_t": paired_t_table,
    "paired_t_pvalue": paired_t_pvalue,
    "welch_t": welch_t_table,
    "compare_models": compare_knn_votes,
    "report_lines": run_report_lines,
    "own_summary_lines": own_summary,
    "mix_summary_lines": mix_summary,
    "token_cap": token_cap,
    "embed_hashed": embed_hashed,
    "embed_hashed_idf": embed_hashed_idf,
    "embed_user_model": embed_user_model,
    "embed_distinct_texts": embed_distinct_texts,
    "embed_cached_lookup": embed_cached_lookup,
    "fit_rf": _fitted(trees.random_forest(), trees.transform),
    "fit_rf_depth_15": _fitted(trees.random_forest(depth=15, weighted=False), trees.transform),
    "fit_dt": _exact_fit(trees.decision_tree()),
    "transfer_dt": _stored_fit(trees.decision_tree(), trees.transform),
    "own_train_dt": own_train_dt,
    "fit_logreg": _exact_fit(linear.softmax_logistic(), 4),
    "fit_logreg_one_vs_rest": _exact_fit(linear.one_vs_rest_logistic(), 4),
    "transfer_logreg": _stored_fit(linear.softmax_logistic(), linear.transform, 4),
    "retrain_mix_logreg": retrain_mix_logreg,
    "fit_svm": fit_svm,
    "fit_densenet": _fitted(short_network(), densenet.transform),
    "fit_densenet_weighted": _fitted(weighted_network(), densenet.transform),
    "fit_densenet_early_stopping": _fitted(plain_network(), densenet.transform, measured=False),
    "fit_logreg_adam": _fitted(adam_logistic(), densenet.transform, measured=False),
    "own_train_knn_text": own_train_knn_text,
    "compare_fitted_models": compare_fitted_models,
}
