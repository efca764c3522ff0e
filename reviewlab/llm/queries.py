"""One registered query per corpus operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.llm import (
    audit,
    clusters,
    decontaminate,
    fingerprints,
    language,
    lines,
    packing,
    quality,
    repeats,
    sharding,
    simhash,
    toxicity,
    urls,
)
from reviewlab.llm.common import documents, fold
from reviewlab.session import durable

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 40
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER, width=1024, end_id=2)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(documents(spark, sf_dir), min_words=50, similarity=0.8)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir), radius=2, words_per_shingle=3, seed=42)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _labelled(spark: SparkSession, sf_dir: str, column: str, features: DataFrame) -> DataFrame:
    """Features of the rows with a label. Labels grow with the corpus, so neither side is ever broadcast."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    return features.join(labels.where("label IS NOT NULL").hint("merge"), "doc_id")


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = durable(quality.with_statistics(documents(spark, sf_dir)))
    model = quality.train(_labelled(spark, sf_dir, "quality", measured.where(fold(5) != 0)))
    scored = quality.score_quality(measured, model)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", predicted)


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), [1.0] * SHARDS)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = durable(toxicity.with_terms(documents(spark, sf_dir)))
    model = toxicity.train(_labelled(spark, sf_dir, "toxic", hashed.where(fold(3) != 1)), max_fit_rows=16_000)
    scored = toxicity.score_toxicity(hashed, model)
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", predicted)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir), min_chars=40, min_docs=5).drop("gone_words")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(fold(4) != 2))
    labelled = language.label_languages(docs, model)
    return labelled.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_ns_bounds_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return clusters.clustered(table, k=8, rounds=10, components=64, scale=1024, seed=3)


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rule_table(spark, URL_RULES))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_repeated_passages,
        op3_simhash_near_dedup,
        op4_quality_discriminant,
        op5_rendezvous_sharding,
        op6_benchmark_decontamination,
        op7_toxicity_machine,
        op8_line_dedup,
        op9_document_fingerprints,
        op10_language_id,
        op11_ns_bounds_clustering,
        op12_filter_interaction_audit,
        op13_url_filters,
    )
}

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES["pipeline"] = pipeline

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _clustering_sql(k: int = 8, rounds: int = 10, components: int = 64, seed: int = 3) -> str:
    """Plain k-means: every vector against every centroid in each round. A floor division of a negative sum rounds down."""
    steps = [
        f"""
        v AS MATERIALIZED (
            SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
            WHERE len(embedding) = {components} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM v
            ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (
            SELECT v.vec_id, v.q, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.q, c{i}.q)])::BIGINT AS d
            FROM v CROSS JOIN c{i}),
        a{i} AS MATERIALIZED (
            SELECT vec_id, any_value(q) AS q, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{i} GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (
            SELECT c, place, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM a{i}) GROUP BY c, place),
        m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS q FROM s{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
            sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
    """


_AUDIT = """
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        f AS (
            SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
                regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
            FROM d),
        g AS (
            SELECT part, [a, b, c, d, e] AS fails, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
            FROM f LEFT JOIN labels l ON f.doc_id = l.doc_id),
        letters AS (SELECT unnest(range(1, 6)) AS x),
        orders AS (
            SELECT [a.x, b.x, c.x, d.x, e.x] AS o
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
        marks AS (
            SELECT part, o, step, good, toxic, fails[o[step]] AS failing, list_sum([fails[x]::INT FOR x IN fails_at])::INT AS earlier,
                list_sum([x::INT FOR x IN fails]) AS failed
            FROM (SELECT g.*, o, step, o[1:step - 1] AS fails_at FROM g CROSS JOIN steps)),
        counted AS (
            SELECT part, array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order, step::INT AS step,
                substr('ABCDE', o[step]::INT, 1) AS letter,
                count(*) FILTER (coalesce(earlier, 0) = 0 AND NOT failing) AS kept,
                count(*) FILTER (coalesce(earlier, 0) = 0 AND failing) AS removed,
                count(*) FILTER (coalesce(earlier, 0) > 0 AND failing) AS redundant,
                count(*) FILTER (failing AND failed = 1) AS unique_fails,
                count(*) FILTER (coalesce(earlier, 0) = 0 AND failing AND good) AS good_lost,
                count(*) FILTER (coalesce(earlier, 0) = 0 AND failing AND toxic) AS toxic_lost
            FROM marks GROUP BY part, o, step)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
        FROM counted
"""

_URLS = f"""
        WITH p AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(rule_host, rule_path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (
            SELECT DISTINCT ON (host, path) host, path, rule_host || rule_path AS rule, verdict FROM (SELECT DISTINCT host, path FROM p)
            JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            ORDER BY length(rule_host || rule_path) DESC)
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""

LLM_ORACLE: dict[str, str] = {
    "op8_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
        keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k
            FROM lines),
        common AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id < keeper AS gone
            FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_ns_bounds_clustering": _clustering_sql(),
    "op12_filter_interaction_audit": _AUDIT,
    "op13_url_filters": _URLS,
}
