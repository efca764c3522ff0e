"""Language ID, quality, toxicity and the pipeline: held-out accuracy, plain versions and awkward rows."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.llm import language, quality, toxicity
from reviewlab.llm.common import fold
from reviewlab.llm.queries import LLM_QUERIES
from reviewlab.session import durable

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `row` int, spans int"
AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !!"), (5, "x"), (6, "word " * 30000), (None, "no id here"), (5, "x"), (7, "é")]


@pytest.fixture(scope="module")
def awkward(spark):
    return durable(spark.createDataFrame([(i, t, None, "s", 0, 0.5, 1, 2) for i, t in AWKWARD], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    ones = labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def _labelled(spark, name, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    rows = LLM_QUERIES[name](spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    return np.array([r.label for r in held]), np.array([r.score for r in held]), np.array([r.predicted for r in held])


def test_quality_on_held_out_rows(spark):
    labels, scores, predicted = _labelled(spark, "op4_quality_discriminant", "quality")
    assert _auc(labels, scores) > 0.97 and (labels == predicted).mean() > 0.95
    assert ((scores >= 0.3) == (predicted == 1)).all() and ((scores >= 0) & (scores <= 1)).all()


def test_toxicity_on_held_out_rows(spark):
    labels, scores, predicted = _labelled(spark, "op7_toxicity_machine", "toxic")
    assert _auc(labels, scores) > 0.85 and (predicted[labels == 0] == 0).mean() > 0.98
    assert ((scores >= 0.7) == (predicted == 1)).all() and ((scores >= 0) & (scores <= 1)).all()


def test_language_on_held_out_rows(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = LLM_QUERIES["op10_language_id"](spark, SF).join(langs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_scores_of_awkward_rows(spark, awkward, empty):
    train = spark.createDataFrame(
        [(i, ("clean words in a row " if i % 2 else "JUNK!! ### ") * (i % 7 + 1), i % 2) for i in range(60)], "doc_id bigint, text string, label int"
    )
    for module, features, score in (
        (quality, quality.with_statistics, quality.score_quality),
        (toxicity, toxicity.with_terms, toxicity.score_toxicity),
    ):
        known, asked = features(train, "label"), features(awkward)
        model = module.train(known)
        rows = score(asked, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        assert score(features(empty), model).collect() == []
        for few in (known.limit(0), known.where("label = 1"), known.withColumn("label", F.lit(None).cast("int"))):
            assert len(score(asked, module.train(few)).collect()) == len(AWKWARD)


def test_machine_learns_pairs_that_weights_cannot():
    """Toxic only where an insult meets a mention: the exclusive-or of two terms has no additive solution."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([0] * a + [1] * b + [rng.randrange(2, 12)], np.int64))
        labels.append(float(a == b))
    machine = toxicity.fit_machine(np.arange(12), rows, np.array(labels), rank=4, epochs=60)
    raw = machine.raw(np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    assert ((raw > 0) == (np.array(labels) == 1)).mean() > 0.95


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, (80, 3)) for c in (0, 1)]
    counts = np.array([80.0, 80.0])
    model = quality.QuadraticDiscriminant.from_moments(
        counts, np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0
    )
    points, logs = rng.normal(0, 2, (20, 3)), []
    for v in x:
        cov, d = np.cov(v.T, bias=True), points - v.mean(axis=0)
        logs.append(-0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.scores(points) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    table = rng.normal(0, 2, (30, 3)).astype(np.float32)
    lengths = np.array([4, 0, 6, 1])
    rows = rng.integers(0, 30, lengths.sum())
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    path = language.viterbi(table, rows, starts, lengths, 1.5)

    def value(p, r):
        return sum(table[w, k] for k, w in zip(p, r)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))

    for s, n in zip(starts, lengths):
        r = rows[s : s + n]
        best = max((value(p, r) for p in product(range(3), repeat=int(n))), default=0)
        assert value(path[s : s + n], r) == pytest.approx(best, abs=1e-4)


def test_languages_of_mixed_and_awkward_rows(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where(fold(4) != 2))
    texts = {r.lang: r.text for r in docs.where("lang IN ('en', 'de') AND length(text) BETWEEN 600 AND 900").orderBy("doc_id").collect()}
    n = {k: len(t.split()) for k, t in texts.items()}
    mixed = docs.sparkSession.createDataFrame([(1, texts["en"] + " " + texts["de"]), (2, "слово за словом")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in language.label_languages(mixed, model).collect()}
    spans = rows[1].spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].after - n["en"]) <= 2 and spans[1].after == n["en"] + n["de"]
    assert rows[2].lang_pred in model.languages
    rows = language.label_languages(awkward, model).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in rows if r.doc_id and r.doc_id < 5) == [(i, "und", 0.0) for i in (1, 2, 3, 4)]
    assert all(r.lang_pred != "und" and 0 < r.score <= 1 for r in rows if r.doc_id is None or r.doc_id >= 5)
    kept = language.with_known_language(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == 5
    assert language.label_languages(empty, model).collect() == []
    none = language.train(awkward)
    assert {r.lang_pred for r in language.label_languages(awkward, none).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet").where(fold(4) != 2))
    texts = ["½", "²", "①", "Ⅷ", "12 ½ ²!", "½x", "ª", "word ½"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.lang_pred for r in language.label_languages(docs, model).collect()}
    assert [rows[i] == "und" for i in range(8)] == [True] * 5 + [False] * 3
    assert {r.doc_id for r in language.with_known_language(docs, model).collect()} == {5, 6, 7}


def test_toxicity_draws_whatever_the_share(spark):
    """A share that is tiny beside the table still draws rows, and a draw of one class is no silent constant."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 7, F.when(F.col("id") % 2 == 0, " awful stuff").otherwise(" fine thing")).alias("text"))
    labelled = durable(toxicity.with_terms(docs).withColumn("label", (F.col("doc_id") % 2 == 0).cast("int")))
    scores = toxicity.score_toxicity(labelled, toxicity.train(labelled, max_fit_rows=40)).collect()
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 0) for r in scores]) > 0.95
    marked = F.col("doc_id") % 200 == 0
    rare = docs.withColumn("text", F.when(marked, F.lit("strange words here")).otherwise(F.col("text")))
    rare = toxicity.with_terms(rare).withColumn("label", marked.cast("int"))
    with pytest.raises(ValueError, match="only one class"):
        toxicity.train(rare, max_fit_rows=4)


def test_scripts_narrow_the_candidates():
    model = language.LanguageModel(["el", "en"], np.zeros((language.BUCKETS, 2), np.float32), np.zeros((len(language.SCRIPTS), 2), bool))
    model.seen[language.SCRIPTS.index("Greek"), 0] = model.seen[language.SCRIPTS.index("Latin"), 1] = True
    scores, letters = model.token_scores(["λόγος", "word", "12"])
    assert scores.argmax(axis=1).tolist()[:2] == [0, 1] and scores[2].tolist() == [0, 0] and letters.tolist() == [5, 4, 0]


def test_pipeline_equals_the_plain_version(spark):
    import corpus_pipeline
    from test_llm_sets import _check_packing

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [" ".join(r.text.lower().split()).strip(" .") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    docs = [(i, out[2]) for i, out in brute.line_dedup(docs).items()]
    docs.sort()
    docs = [d for k, (d, r) in enumerate(zip(docs, brute.similar_classes([t for _, t in docs]))) if k == r]
    docs = [(i, t) for i, t in docs if not any(x in " ".join(t.lower().split()) for x in items)]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in docs}
    _check_packing(rows, docs, 1024)


def test_pipeline_stages_keep_the_columns_and_bear_awkward_rows(spark, awkward, empty):
    import corpus_pipeline

    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, SMALL))
            assert docs.columns == awkward.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_training_hashes_bounded_groups_of_words_and_counts_all(monkeypatch):
    taken, features = [], language.features
    monkeypatch.setattr(language, "features", lambda words: taken.append(len(words)) or features(words))
    texts = [" ".join(f"{a}{b}{c}" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz") for a in ("qu", "vo", "ze", "mi") * 2]

    def counted(cached: int, at_once: int):
        monkeypatch.setattr(language, "CACHED_TOKENS", cached)
        monkeypatch.setattr(language, "HASHED_AT_ONCE", at_once)
        counts = language._BucketCounts()
        for i, text in enumerate(texts):
            counts.add(text, "ab"[i % 2])
            assert sum(map(len, counts.words.values())) <= cached
        counts.flush()
        return counts.tables

    whole, parts = counted(10**6, 10**6), counted(1000, 100)
    assert max(taken) == 1352 and max(taken[2:]) == 100
    assert all((whole[x] == parts[x]).all() for x in "ab") and whole["a"].sum() > 0
