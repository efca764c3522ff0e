"""Clustering with ns-bounds, the filter audit and the URL filters against plain versions, their SQL and awkward rows."""

import hashlib
import math
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.llm import audit, clusters, urls
from reviewlab.llm.queries import LLM_ORACLE, LLM_QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ns_bounds_clustering", "op12_filter_interaction_audit", "op13_url_filters"])
def test_queries_equal_their_sql(spark, name):
    database = duckdb.connect()
    for table in ("embeddings", "documents", "labels", "pages"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    answer = database.execute(LLM_ORACLE[name])
    names = [c[0] for c in answer.description]
    got = LLM_QUERIES[name](spark, SMALL).select(names).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, answer.fetchall()))


# -- clustering -----------------------------------------------------------------------------------


def _lloyd(rows, k, rounds, components, seed):
    """[(vec_id, vector)] -> {vec_id: (cluster, distance)}, centroids: plain rounds over all pairs, in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**27), min(2**27, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted((repr(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def _clustered(spark, rows, k, rounds, components, kind="float", seed=3):
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("cluster", F.lit("clash")).withColumn("kind", F.lit(9))
    return clusters.cluster_vectors(table.repartition(3), k, rounds, components, seed=seed)


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 4), (1, 2)])
def test_clusters_equal_the_plain_version(spark, k, rounds):
    rng = np.random.default_rng(k)
    spots = rng.normal(size=(6, 5))
    rows = [(i, [float(np.float32(x)) for x in spots[i % 6] + rng.normal(scale=0.4, size=5)]) for i in range(160)]
    rows += [(200 + i, [0.5, 0.25, -0.5, 0.0, 1.0]) for i in range(20)]
    want, centroids = _lloyd(rows, k, rounds, 5, 3)
    got = _clustered(spark, rows, k, rounds, 5)
    assert got.centroids == centroids
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.rows.collect()) == want
    assert got.evaluated[0] <= len(rows) * (k + 1) and len(got.evaluated) <= rounds + 1


def test_bounds_skip_most_distances(spark):
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(8, 16)) * 20
    rows = [(i, [float(x) for x in spots[i % 8] + rng.normal(size=16)]) for i in range(400)]
    evaluated = _clustered(spark, rows, 8, 10, 16, "double").evaluated
    assert sum(evaluated[2:]) < 0.2 * evaluated[0] * len(evaluated[2:])


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(60)]
    want, centroids = _lloyd(rows, 6, 10, 2, 3)
    got = _clustered(spark, rows, 6, 10, 2)
    assert got.centroids == centroids and sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.rows.collect()) == want


def test_displacement_bounds_never_exclude_the_nearest():
    """Random walks of centroids: after each round the bounded assignment is that over all pairs."""
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (300, 4))
    history = clusters.History([rng.integers(-50, 50, (7, 4))])
    state = (np.zeros(300, np.int64), np.full(300, np.inf), np.zeros(300, np.int64), np.zeros((300, 7)), np.zeros((300, 7), np.int64))
    for _ in range(30):
        clusters.reassign(points, state, history)
        gaps = ((points[:, None, :] - history.rounds[-1][None]) ** 2).sum(axis=2)
        assert (state[0] == gaps.argmin(axis=1)).all()
        history.rounds.append(history.rounds[-1] + rng.integers(-4, 5, (7, 4)) * (rng.random((7, 1)) < 0.6))


def test_clustering_of_awkward_vectors(spark):
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0])]
    rows += [(None, [3.0, 4.0]), (8, [-0.00001, 0.0]), (9, [3e38, -3e38]), (10, [1.0, 2.0, 3.0])]
    want, centroids = _lloyd([(i, v) for i, v in rows], 4, 3, 2, 3)
    got = _clustered(spark, rows, 4, 3, 2, "double")
    assert got.centroids == centroids and sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.rows.collect()) == want
    assert [r.distance for r in _clustered(spark, rows, 50, 3, 2, "double").rows.collect()] == [0] * 5
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    empty = clusters.clustered(table, 8, 10, 64)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# -- audit ----------------------------------------------------------------------------------------


def _audit(docs, labels):
    """[(doc_id, text, lang)], [(doc_id, quality, toxic)] -> rows, order by order and document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words)}
        fails["C"] = 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)
        fails["D"] = bool(re.search("[#$%&*|]", text))
        fails["E"] = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        failing.append((lang or "", doc_id, {c for c, f in fails.items() if f}))
    out, removed_by = {}, {}
    for order in map("".join, permutations("ABCDE")):
        alive = list(failing)
        for step, letter in enumerate(order, 1):
            for part in {p for p, _, _ in failing}:
                mine = [(i, f) for p, i, f in alive if p == part]
                gone = [i for i, f in mine if letter in f]
                everyone = [f for p, _, f in failing if p == part and letter in f]
                out[part, order, step] = [
                    len(mine) - len(gone), len(gone), len(everyone) - len(gone), sum(f == {letter} for f in everyone),
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
            alive = [d for d in alive if letter not in d[2]]
    return sorted((*key, *counts, removed_by[key[0], key[1][key[2] - 1]]) for key, counts in out.items())


def _audited(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns({"hash": F.lit(1), "part": F.lit("x"), "n": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("y"))
    return sorted(tuple(r) for r in audit.filter_audit(frame.repartition(3), marks).collect())


def test_audit_equals_the_plain_version(spark):
    rng = random.Random(4)
    docs = []
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "c#", "GAMMA", "delta"][: rng.randrange(1, 6)]) + str(rng.randrange(rng.choice((3, 500)))) for _ in range(rng.choice((20, 199, 200, 300)))]
        docs.append((i, " ".join(words), rng.choice(["en", "de", None])))
    docs += [(100 + i, docs[rng.randrange(20)][1], "en") for i in range(15)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(115), 70)]
    assert _audited(spark, docs, labels) == _audit(docs, labels)


def test_audit_of_awkward_rows(spark):
    docs = [(1, None, None), (2, "", "en"), (3, " \x0b\n", "en"), (4, "same", "en"), (4, "same", "en"), (5, "same", "de"), (None, "same", "de")]
    docs += [(None, None, "de"), (6, "ÄÖ AZ", ""), (7, "w\u00a0x " * 20000, "en"), (8, "x", "en"), (8, "y", "en"), (9, "y", "en"), (-1, "x", "fr")]
    docs += [(50 + i, "copy of copy " * 100, "en") for i in range(30)]
    labels = [(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (51, 1, 1), (999, 1, 1)]
    assert _audited(spark, docs, labels) == _audit(docs, labels)
    assert _audited(spark, docs, []) == _audit(docs, [])
    assert _audited(spark, [], labels) == []


def test_limits_of_the_filters(spark):
    texts = ["w " * 199, " ".join(f"w{i}" for i in range(200)), "a b a b", "a b a", "ABC" + "x" * 97, "ABCD" + "x" * 96, "a|b", "50%"]
    fails = audit.own_failures(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(*[c.alias(n) for n, c in fails.items()]).collect()
    assert [r.A for r in rows] == [True, False] + [True] * 6
    assert [r.B for r in rows][2:4] == [False, False] and rows[0].B
    assert [r.C for r in rows][4:6] == [False, True]
    assert [r.D for r in rows] == [False] * 6 + [True, True]


# -- urls -----------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.B.net/x?y#z", "http://example.net/en/1", "http://example.net/en",
    "http://m.example.com/de/", "http://notexample.com/de/", "http://example.com/DE/", "http://a.org/fr/?q", "http://org/fr/x", "http://xnet/",
    "x://a.net?u=http://b.org/fr/", "http://a.net#/en/", "http://.net/", "http://net./", "http://a.net:80/", "http://example.net/en/" + "x" * 50000,
    "HTTP://EXAMPLE.NET/en/", "http://ÄÖ.net/é", "http://a.net/ new\nline", "://net/",
]


def _judge(url, rules, unlisted="allow"):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m.group().lower(), found.group(1)), found.group(2)) if found else ("", "")
    fits = []
    for rule, verdict in rules.items():
        rule_host, slash, rest = rule.partition("/")
        if rule_host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fits.append((len(rule), len(rule_host), rule, verdict))
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, unlisted)


def test_url_verdicts_equal_the_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, rule string, first string")
    rows = urls.judge_urls(pages.repartition(3), urls.rule_table(spark, URL_RULES)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: _judge(u, URL_RULES) for i, u in enumerate(URLS)}
    assert len(rows) == len(URLS)


@pytest.mark.parametrize("max_bytes, limit", [(1 << 20, 100_000), (64, 100_000), (1 << 20, 50)])
def test_long_lists_lose_nothing(spark, monkeypatch, max_bytes, limit):
    """A filter that is far too small lets more pass, and a list beyond the broadcast bound is shuffled: the same verdicts."""
    import reviewlab.session as session

    monkeypatch.setattr(session.control_rows, "__defaults__", (limit,))
    rng = random.Random(3)
    rules = {f"h{rng.randrange(300)}.{rng.choice(['com', 'net'])}/{'ab'[: rng.randrange(3)]}": rng.choice(["allow", "block"]) for _ in range(400)}
    seen = [f"http://{rng.choice(['', 'm.', 'a.b.'])}h{rng.randrange(400)}.com/{rng.choice(['', 'a', 'ab/x', 'b', 'axe'])}" for _ in range(600)] + ["http://h1.com/ab"] * 300
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id bigint, url string")
    rows = urls.judge_urls(pages, urls.rule_table(spark, rules), max_filter_bytes=max_bytes).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: _judge(u, rules) for i, u in enumerate(seen)}
    assert {None} < {r.rule for r in rows}


def test_awkward_lists_and_pages(spark):
    listed = [("A.com/X", "allow"), ("a.com/X", "block"), ("b.com", "allow"), (None, "block"), ("/path", "block"), ("c.com/", None), ("", "block")]
    pages = spark.createDataFrame([(1, "http://a.com/Xy"), (1, "http://a.com/Xy"), (None, "http://b.com"), (2, "http://s.c.com/"), (3, None)], "page_id bigint, url string")
    entries = spark.createDataFrame(listed, "rule string, verdict string")
    rows = sorted((str(r.page_id), r.rule, r.verdict) for r in urls.judge_urls(pages, entries).collect() if r.rule)
    assert rows == [("1", "a.com/X", "block"), ("1", "a.com/X", "block"), ("2", "c.com/", "block"), ("None", "b.com", "allow")]
    none = urls.judge_urls(pages, entries.limit(0), unlisted="block").collect()
    assert len(none) == 5 and {(r.rule, r.verdict) for r in none} == {(None, "block")}
    assert urls.judge_urls(pages.limit(0), entries).collect() == []


def test_filter_has_no_false_misses_and_few_false_hits(spark):
    listed = urls.url_list(spark.range(20_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com/")).alias("rule"), F.lit("block").alias("verdict")))
    words = urls.bloom_blocks(listed, 1 + 20_000 * urls.BITS_PER_KEY // 256)

    def asked(frame):
        rows = frame.select(F.xxhash64("rule").alias("a")).withColumn("b", F.xxhash64("a")).toArrow()
        return urls.may_contain(words, rows.column("a").to_numpy(), rows.column("b").to_numpy())

    assert asked(listed).all()
    assert asked(spark.range(50_000).select(F.concat(F.lit("other"), F.col("id")).alias("rule"))).mean() < 0.01
