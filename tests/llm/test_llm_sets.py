"""Packing, sharding, line dedup and fingerprints against plain versions and on awkward rows."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.llm import fingerprints, lines, packing, sharding
from reviewlab.llm.queries import LLM_QUERIES, TOKENIZER
from reviewlab.session import durable

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, piece string, `row` int, gone int, zone int"
LINE = "this boilerplate line is long enough to count"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "é" * 3000), (6, LINE + "\n" + "Ab c\n" * 700), (7, LINE), (8, " " + LINE.upper()),
    (9, LINE + "\n" + LINE), (10, LINE), (11, "a b c d\n\n" + LINE), (12, "<|endoftext|> in a text"), (None, LINE), (None, None),
    (13, "same text"), (14, "same text"), (13, "same text"), (13, "other text of a repeated id"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s", 0, "p", 1, 2, 3) for i, t in AWKWARD]
    return durable(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _check_packing(rows, texts, width):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted(sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in texts)
    assert sum(r.length for r in rows) == sum(map(len, want))
    places = {}
    for r in rows:
        assert 0 < r.length <= width and r.start >= 0
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(places), math.ceil(sum(map(len, want)) / width)


def test_packing_is_whole_and_tight(spark, documents):
    rows = LLM_QUERIES["op1_best_fit_packing"](spark, SF).collect()
    used, bound = _check_packing(rows, documents, 1024)
    assert used <= bound + 3
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in documents}
    for r in rows:
        assert r.ids_crc32 == brute.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for doc_id in ids:
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == doc_id)
        assert [(s, n) for _, s, n in own] == packing.piece_bounds(len(ids[doc_id]), 1024)


def test_packing_merges_over_many_partitions(spark, documents):
    pieces = packing.token_pieces(spark.read.parquet(f"{SF}/documents.parquet").repartition(40), TOKENIZER, 1024)
    packed = packing.pack(pieces, 1024, fan_in=3)
    used, bound = _check_packing(packed.collect(), documents, 1024)
    assert used <= 1.03 * bound  # with five documents to a partition
    sequences = packing.token_sequences(packed).collect()
    assert len(sequences) == used and all(len(s.ids) == 4 * sum(s.lengths) for s in sequences)


def test_packing_of_awkward_rows(awkward, empty):
    rows = packing.pack_documents(awkward, TOKENIZER, 64).collect()
    _check_packing(rows, AWKWARD, 64)
    assert packing.pack_documents(empty, TOKENIZER).collect() == []


def test_chunked_tokens_equal_whole_texts():
    tokenizer = packing.ChunkedTokenizer(TOKENIZER)
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab. ,\n\t'!A1é   (", k=rng.randint(0, 14))) for _ in range(2000)]
    texts += ["<|endoftext|> a<|endoftext|>b", "\x1cq \x1d w", "end.\nNext 'll x", "ａ. ½! ²?", "a　b c"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.encode_batch(texts) == want


@pytest.mark.parametrize("width", [10, 100])
def test_best_fit_never_overflows(width):
    sizes = np.random.default_rng(1).integers(1, width + 1, 500)
    bins, offsets, used = packing.best_fit(sizes, width)
    assert np.bincount(bins, sizes).astype(int).tolist() == used and max(used) <= width
    assert sum(2 * u <= width for u in used) <= 1


def test_sharding_follows_the_key(spark, documents):
    rows = LLM_QUERIES["op5_rendezvous_sharding"](spark, SF).collect()
    texts = dict(documents)
    assert len(rows) == len(documents)
    for r in rows:
        assert (r.shard, r.grown_shard) == (brute.rendezvous(r.doc_id, 40), brute.rendezvous(r.doc_id, 41))
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 16, brute.crc32(data), "key")
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_sharding_by_weight_and_of_awkward_rows(spark, awkward, empty):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.shard_documents(keys, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.7 < counts[1] / 4000 < 0.8
    rows = sharding.shard_documents(awkward, [1.0] * 3).collect()
    assert len(rows) == len(AWKWARD) and {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(16, 0)}
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    numbered = sharding.number_in_shard(durable(sharding.shard_documents(keys, [1.0] * 2).drop("slot")), block_rows=100)
    for shard in (0, 1):
        slots = sorted(r.slot for r in numbered.where(F.col("shard") == shard).collect())
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty, [1.0]).collect() == []


def test_line_dedup_equals_the_plain_version(spark, documents):
    want = brute.line_dedup(documents)
    rows = LLM_QUERIES["op8_line_dedup"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n, dropped, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, brute.sha256(kept))
    assert sum(r.n_dropped for r in rows) > 0


def test_line_dedup_equals_its_sql(spark):
    import duckdb

    from reviewlab.llm.queries import LLM_ORACLE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = {tuple(r) for r in con.execute(LLM_ORACLE["op8_line_dedup"]).fetchall()}
    assert {tuple(r) for r in LLM_QUERIES["op8_line_dedup"](spark, SF).collect()} == theirs


def test_line_dedup_of_awkward_rows(awkward, empty):
    kept = {(r.doc_id, r.text) for r in lines.dedup_lines(awkward).collect()}
    # The line is in documents 6 to 11 and in one without id; 11 is the last and keeps it.
    assert {(7, ""), (8, ""), (9, ""), (10, ""), (11, "a b c d\n\n" + LINE), (None, ""), (None, None), (1, None), (2, "")} <= kept
    assert (6, "Ab c\n" * 700) in kept
    report = [r for r in lines.line_report(awkward).collect() if r.doc_id in (1, 2, 6, 9)]
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in report} == {(1, 1, 0), (2, 1, 0), (6, 702, 1), (9, 2, 2)}
    assert lines.dedup_lines(awkward).columns == awkward.columns
    assert lines.line_report(empty).collect() == [] and lines.dedup_lines(empty).collect() == []


def test_fingerprints_equal_the_plain_version(spark, documents):
    want = brute.edited(documents)
    rows = LLM_QUERIES["op9_document_fingerprints"](spark, SF).collect()
    assert len(rows) == len(documents)
    by_text = {}
    for r in rows:
        text, changed, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha256(changed))
        assert r.near_edited == pytest.approx(brute.overlap_likeness(text, changed))
        assert r.near_next == pytest.approx(brute.overlap_likeness(text, after))
        by_text.setdefault(text, set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len(set.union(*by_text.values())) == len(by_text)


def test_fingerprints_of_awkward_rows(spark, awkward, empty):
    rows = fingerprints.edited_neighbours(awkward, zones=5).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.near_edited for r in rows if r.n_chars < 3} == {1.0}
    assert fingerprints.edited_neighbours(empty).collect() == []
    single = awkward.where("doc_id = 4")
    assert fingerprints.edited_neighbours(single).first().near_next == 1.0
    assert fingerprints.fingerprint_documents(awkward).count() == len(AWKWARD)


def test_rows_without_id_and_repeated_ids_are_dealt_out(spark):
    """Ids in descending order, none last, equal ids by text hash from the greatest; hot ids fill many partitions."""
    rng = random.Random(2)
    rows = [(None, f"none {i} " * 5) for i in range(300)] + [(7, f"seven {i} " * 5) for i in range(300)]
    rows += [(i, "".join(rng.choices("ab c", k=rng.randrange(40)))) for i in range(-100, 200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = {(r.doc_id, r.text): r.h for r in frame.withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda d: (d[0] is None, -(d[0] or 0), -hashes[d]))
    want = sorted(repr((i, len(t), brute.sha256(t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]))) for k, (i, t) in enumerate(order))
    for zones in (1, 6, 40):
        found = fingerprints.edited_neighbours(frame, zones).collect()
        assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in found) == want
    cuts, hot = fingerprints.zone_cuts(frame.select("doc_id"), 12)
    assert hot == [7] and {7, 8} <= set(cuts)


def test_spans_and_extensions():
    rng = random.Random(3)
    a = "".join(rng.choices("ab", k=400))
    b = a[50:250] + "".join(rng.choices("ab", k=100))
    ha, hb = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
    for _ in range(300):
        i, j = rng.randrange(400), rng.randrange(300)
        n = rng.randint(0, min(400 - i, 300 - j))
        assert ha.equal(i, hb, j, n) == (a[i : i + n] == b[j : j + n])
        ext = next((k for k in range(min(400 - i, 300 - j)) if a[i + k] != b[j + k]), min(400 - i, 300 - j))
        assert ha.forward(i, hb, j) == ext
        back = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
        assert ha.backward(i, hb, j) == back


def test_plain_texts_are_cut_by_the_pre_tokenizers_pattern():
    tokenizer = packing.ChunkedTokenizer(TOKENIZER)
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab. ,\n'sdté09–“Яω(!", k=rng.randint(1, 16))) for _ in range(2000)]
    texts += ["don't we'll 's x", "end.\nNext,  two \n ", " ", "\n\n"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    tokenizer.tokenizer = None  # pre-tokens need the merges only, and no chunk is kept beside them
    assert tokenizer.encode_batch(texts) == want and not tokenizer.known and " a" in tokenizer.parts
