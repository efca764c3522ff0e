"""SimHash classes, repeated passages and benchmark leaks against plain versions and on awkward rows."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.llm import decontaminate, repeats, simhash
from reviewlab.llm.queries import LLM_QUERIES
from reviewlab.session import durable

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, `row` int, k int"
WORDS = [f"word{i}" for i in range(5000)]


def _text(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


PASSAGE = _text("passage", 60)
AWKWARD = [
    (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one two"), (6, "ONE Two"), (7, "same same"), (8, "same same"), (7, "same same"),
    (7, "a repeated id"), (None, "same same"), (None, "alone without id"), (None, "alone without id"), (9, "for " * 5000), (10, "for " * 5000),
    (20, _text(20, 80) + " " + PASSAGE + " " + _text(21, 40)), (21, PASSAGE + " " + _text(22, 300)), (22, _text(23, 90) + " " + PASSAGE),
    (23, _text(24, 400)), (24, _text(25, 30)), (None, PASSAGE),
]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    return durable(spark.createDataFrame([(i, t, "en", "s", 0, "p", 1, 2) for i, t in AWKWARD], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_classes_equal_the_plain_version(spark, documents):
    rows = LLM_QUERIES["op3_simhash_near_dedup"](spark, SF).collect()
    order = sorted(documents)
    prints = [brute.simhash(t) for _, t in order]
    first = {i: order[r][0] for (i, _), r in zip(order, brute.components(prints))}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (i, f"{p:016x}", first[i]) for (i, _), p in zip(order, prints)
    }


@pytest.mark.parametrize("tile", [1024, 8])
def test_crowded_fingerprints_connect_as_all_pairs_do(spark, tile):
    """A dense cloud around one value, so that block values are hot and cut into tiles."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    values = {base}
    for _ in range(250):
        flips = rng.choice(64, rng.integers(1, 7), replace=False)
        values.add(base ^ sum(1 << int(f) for f in flips))
    values = sorted(values | {int(x) for x in rng.integers(0, 2**63, 50)} | {0, 2**64 - 1})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    links = simhash.near_links(frame, 2, tile)
    found = {r.node: r.root for r in simhash.connected(links).collect()}
    want = {}
    for v, r in zip(values, brute.components(values)):
        want.setdefault(r, set()).add(v)
    got = {}
    for v in values:
        signed = v - (1 << 64) if v >> 63 else v
        got.setdefault(found.get(signed, signed), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in simhash.connected(links).collect()} == {(i, 0) for i in range(1, 301)}


def test_one_of_each_class_stays(awkward, empty):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    ids = [i for i, _ in rows]
    # Null, empty and blank texts are one class; so are texts that differ in case only, and rows without id among them.
    assert {1, 4, 5, 7, 9}.issubset(ids) and not {2, 3, 6, 8, 10} & set(ids)
    assert rows.count((None, "alone without id")) == 1 and (None, "same same") not in rows
    assert simhash.keep_one(empty).collect() == [] and simhash.classes(empty).collect() == []


def test_the_near_copies_stage_equals_all_pairs(spark, documents, awkward):
    """Against all pairs of five-word shingle sets at 0.8, over the table and edited copies down to that similarity."""
    import corpus_pipeline

    rng, rows = random.Random(8), [*documents, (None, "no id"), (10**6, None), (10**6 + 1, " ")]
    for n in range(120):
        words = rng.choices(WORDS, k=rng.choice((25, 60, 100, 300)))
        edited = list(words)
        for _ in range(max(1, rng.randrange(len(words) // 40 + 1))):
            edited[rng.randrange(6, len(words) - 6)] = f"new{n}"
        rows += [(10**7 + 2 * n, " ".join(words)), (10**7 + 2 * n + 1, " ".join(edited).upper())]
    split = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]
    root = list(range(len(rows)))
    for j, b in enumerate(sets):
        for i in range(j):
            a = sets[i]
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    classes = {}
    for (doc_id, text), r in zip(rows, root):
        classes.setdefault(r, []).append((doc_id is None, -1 if doc_id is None else doc_id))
    want = {min(c)[1] for c in classes.values()}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.near_copies(spark, frame, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want and len(want) < len(rows) - 60
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, awkward, SF).collect()]
    assert {1, 4, 5, 7, 9} <= {i for i, _ in rows} and not {2, 3, 6, 8, 10} & {i for i, _ in rows}


def test_repeated_passages_are_found(spark, documents):
    rows = LLM_QUERIES["op2_repeated_passages"](spark, SF).collect()
    words = {i: [w for w in (re.sub(r"[\W_]+", "", t.lower()) for t in x.split()) if w] for i, x in documents}
    seen = {}
    for i, w in words.items():
        for at in range(len(w) - 49):
            seen.setdefault(tuple(w[at : at + 50]), set()).add(i)
    groups = [g for g in seen.values() if len(g) > 1]
    found = {r.doc_id: r.class_id for r in rows}
    assert groups and all(len({found.get(i) for i in g}) == 1 and g <= found.keys() for g in groups)


def test_repeated_passages_of_awkward_rows(awkward, empty):
    rows = {r.doc_id: r for r in repeats.repeated_passages(awkward).collect()}
    assert rows.keys() == {9, 10, 20, 21, 22}
    assert len({rows[i].class_id for i in (20, 21, 22)}) == 1 and rows[9].class_id == 9
    for i, start in ((20, 80), (21, 0), (22, 90)):
        assert [(p["first"], p["after"]) for p in rows[i].passages] == [(start, start + 60)]
    assert repeats.repeated_passages(empty).collect() == []


def test_edited_passages_are_found(spark):
    words = PASSAGE.split()
    swapped = " ".join([*words[:30], "changed", *words[31:]])
    longer = " ".join([*words[:30], "inserted", *words[30:]])
    texts = [_text(1, 70) + " " + PASSAGE, _text(2, 50) + " " + swapped + " " + _text(3, 50), longer + " " + _text(4, 90), _text(5, 200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in repeats.repeated_passages(frame).collect()} == {0, 1, 2}


def _meet(a, b):
    """Whether two texts have a key in common."""
    hasher, keys = decontaminate.WordHasher(), []
    for text in (a, b):
        values = repeats.shingles(hasher.words(text))
        columns = []
        for f in range(repeats.HASHES):
            found = repeats.ranks(values, f)
            at = np.array(repeats.compact_windows(found, 46), np.int64).reshape(-1, 3)
            columns.append(((found[at[:, 1]] ^ np.uint64(f)).view(np.int64), np.full(len(at), f), *at[:, [0, 1, 2]].T))
        keys.append(set(repeats._join_intervals(*map(np.concatenate, zip(*columns)), 46)[0].tolist()))
    return bool(keys[0] & keys[1])


@pytest.mark.parametrize("kind", ["substituted", "inserted"])
@pytest.mark.parametrize("edits, size", [(1, 50), (2, 100), (3, 150)])
def test_edited_passages_of_similarity_meet(kind, edits, size):
    """Brute force knows which pairs reach 0.8; at most one in fifty of them may share no key."""
    rng, similar, lost = random.Random(size), 0, 0
    for _ in range(100):
        passage = rng.choices(WORDS, k=size)
        edited = list(passage)
        for _ in range(edits):
            at = rng.randrange(6, len(edited) - 6)
            edited[at : at + (kind == "substituted")] = [f"new{rng.random()}"]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, edited))
        if len(a & b) < 0.8 * len(a | b):
            continue
        similar += 1
        one, two = (" ".join([*rng.choices(WORDS, k=rng.randrange(150)), *x, *rng.choices(WORDS, k=80)]) for x in (passage, edited))
        lost += not _meet(one, two)
    assert similar >= 20 and lost <= similar / 50


def test_all_texts_of_a_passage_are_partners_and_frequent_words_hide_none(spark):
    common, texts = _text("common", 40), [f"{_text(f'a{i}', 70)} {PASSAGE} {_text(f'b{i}', 70)}" for i in range(7)]
    for i in range(25):
        texts.append(f"{_text(f'c{i}', 90)} {common} {_text(f'd{i}', 90)}")
    for i in range(20):
        passage = f"{_text(f'e{i}', 10)} {common} {_text(f'f{i}', 10)}"
        texts += [f"{_text(f'{side}{i}', 80)} {passage} {_text(f'{side}{i}+', 80)}" for side in "gh"]
    rows = {r.doc_id: r for r in repeats.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows.keys() == {*range(7), *range(32, 72)}
    assert all(rows[i].n_links == 6 for i in range(7)) and all(rows[i].n_links == 1 for i in range(32, 72))
    assert all(rows[i].class_id == rows[i + 1].class_id == i for i in range(32, 72, 2))


def test_every_passage_of_an_alignment_is_found(spark):
    head, foot = _text("head", 60), _text("foot", 55)
    texts = [f"{head} {_text(seed, 200)} {foot}" for seed in ("x", "y")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = repeats.repeated_passages(frame).collect()
    assert {r.doc_id for r in rows} == {0, 1}
    assert all([(p["first"], p["after"]) for p in r.passages] == [(0, 60), (260, 315)] for r in rows)


def test_texts_with_only_a_frequent_line_in_common_do_not_meet(spark):
    """A line of 30 words in 40 texts made 38 of them meet all 40; two of them share a passage beyond the line."""
    line, passage = _text("line", 30), f"{_text('before', 15)} {_text('line', 30)} {_text('after', 15)}"
    texts = [f"{_text(f'p{i}', 90)} {passage if i in (20, 30) else line} {_text(f'q{i}', 90)}" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("text_id", F.col("doc_id"))
    copies = rows.select("text_id", F.col("doc_id").alias("first_doc"))
    place = "key bigint, text_id bigint, anchor int, first int, last int"
    keys = durable(spark.createDataFrame([(1, i, 100, 60, 145) for i in range(40)], place))
    failed = keys.where("text_id NOT IN (0, 39)")
    pairs = repeats.likely_pairs(keys, failed, rows, copies, 50, 0.8)
    assert {(r.text_id, r.other) for r in pairs.collect()} == {(20, 30), (30, 20)}
    second = repeats.second_candidates(keys, failed, pairs).collect()
    assert {(r.text_id, r.other, r["shift"], r["first"], r["last"]) for r in second} == {(20, 30, 0, 60, 145), (30, 20, 0, 60, 145)}


def test_rare_places_are_in_every_recurring_stretch():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(46, 250))
        rare = repeats._rare_places(rng.integers(1, 4, n) ** 3, 46, 8 / 9)
        size = int(rng.integers(46, n + 1))
        at, same = int(rng.integers(0, n - size + 1)), np.zeros(n, bool)
        same[at : at + size] = True
        same[at + rng.choice(size, int(size / 9), replace=False)] = False
        # The worst case: what is missed are rare places, as many as the share allows.
        worst = same.copy()
        worst[at : at + size] = True
        worst[at + np.flatnonzero(rare[at : at + size])[: int(size / 9)]] = False
        assert (rare & same).any() and (rare & worst).any()


def test_windows_of_many_texts_equal_those_of_each():
    rng = np.random.default_rng(4)
    for least in (2, 10, 46):
        texts = [rng.integers(1, high, int(rng.integers(least, 300))).astype(np.uint64) for high in (2**62, 6, 2, 2**62)]
        text, *at = repeats.compact_windows_of(np.concatenate(texts), np.cumsum([len(x) for x in texts]), least)
        for i, values in enumerate(texts):
            assert sorted(zip(*(x[text == i].tolist() for x in at))) == sorted(repeats.compact_windows(values, least))


def test_longest_stretch_equals_the_plain_version():
    rng = np.random.default_rng(5)
    for _ in range(200):
        equal = rng.random(int(rng.integers(0, 40))) < rng.random()
        best = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].sum() * 1000 >= 800 * (b - a)), default=0)
        start, end = decontaminate.longest_stretch(equal, 0.8)
        assert end - start <= best and equal[start:end].sum() * 10 >= 8 * (end - start) and bool(best) == (end > start)


def test_compact_windows_cover_every_span():
    rng = np.random.default_rng(2)
    for distinct in (True, False):
        values = rng.permutation(120).astype(np.uint64) if distinct else rng.integers(0, 6, 120).astype(np.uint64)
        windows = repeats.compact_windows(values, 10)
        for i in range(120):
            for j in range(i + 9, 120):
                holding = [c for l, c, r in windows if l <= i <= c <= j <= r]  # noqa: E741
                assert len(holding) == 1 and values[holding[0]] == values[i : j + 1].min()


def test_leaks_equal_the_plain_version(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = {i: " ".join(t.lower().split()).strip(" .") for i, t in items}
    want = {(d, i) for d, t in documents for i, x in flat.items() if x in " ".join(t.lower().split())}
    rows = LLM_QUERIES["op6_benchmark_decontamination"](spark, SF).collect()
    assert want and {(r.doc_id, r.item_id) for r in rows} == want


def test_leaks_bear_substitutions_and_awkward_rows(spark, awkward, empty):
    item = _text("item", 30).split()
    worn = [w if k % 6 else "other" for k, w in enumerate(item)]
    far = [w if k % 3 else "other" for k, w in enumerate(item)]
    texts = [" ".join(["x", "y", *item, "z"]).upper(), _text(7, 40) + " " + " ".join(worn), " ".join(far), " ".join(item[:12]), None, ""]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "too short", 0), (None, "", 0)], "item_id bigint, text string, doc_id int")
    for block_words in (10**6, 10):
        rows = decontaminate.leaks(docs, bench, block_words=block_words).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(0, 1), (1, 1)}
        assert {(r.doc_start, r.item_start, r.n_words, r.n_equal) for r in rows if r.doc_id == 0} == {(2, 0, 30, 30)}
        kept = decontaminate.without_leaks(docs, bench, block_words=block_words)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}
    assert decontaminate.leaks(empty, bench).collect() == [] == decontaminate.without_leaks(empty, bench).collect()
    assert decontaminate.without_leaks(awkward, bench.limit(0)).count() == len(AWKWARD)


def test_short_items_are_judged_as_a_whole():
    hasher = decontaminate.WordHasher()
    for n in range(1, 14):
        words = _text(f"short{n}", n).split()
        table = decontaminate.SeedTable.build([(1, " ".join(words))])
        for gone in range(-1, n):
            held = [w if k != gone else "other" for k, w in enumerate(words)]
            found = table.matches(hasher.words(" ".join(["x", "y", *held, "z"])), 13, 0.8)
            assert bool(found) == (gone < 0 or n >= 5), (n, gone)


def test_masks_catch_two_of_thirteen_and_three_of_fifteen():
    from itertools import combinations

    for n, k in ((13, 2), (15, 3)):
        for gone in combinations(range(n), k):
            assert any(not any(p + o in gone for o in m) for m in decontaminate.MASKS for p in range(n - m[-1]))


def test_longest_stretch_is_the_longest():
    rng = np.random.default_rng(6)
    for _ in range(60):
        equal = rng.random(25) < 0.7
        best = 0
        for i in range(25):
            for j in range(i + 1, 26):
                if equal[i] and equal[j - 1] and 10 * equal[i:j].sum() >= 8 * (j - i):
                    best = max(best, j - i)
        start, end = decontaminate.longest_stretch(equal, 0.8)
        assert end - start <= best and (best == 0 or end - start >= best - 4)


def test_near_pairs_skip_tiles_by_population_count(monkeypatch):
    """All pairs by hand; sparse fingerprints and dense ones are never compared."""
    import pyarrow as pa

    rng, seen = np.random.default_rng(4), []
    n = np.concatenate([rng.integers(1, 40, 500), rng.integers(0, 4, 100)]).astype(np.int32)
    fp = np.array([int.from_bytes(rng.bytes(8), "little") & int.from_bytes(rng.bytes(8), "little") for _ in range(600)], np.uint64)
    fp[::2] = ~fp[::2]
    batch = pa.record_batch([np.arange(600), fp.view(np.int64), fp.view(np.int64), n, np.arange(600) // 2], ["row_key", "fp", "fp2", "n", "part"])
    rows = simhash._by_band(batch, 0.8)
    within = simhash._within
    monkeypatch.setattr(simhash, "_within", lambda *a: (seen.append((a[3], a[4], rows[6][t[0] : t[1]])) or t for t in within(*a)))
    found = {(int(a), int(b)) for x, y in simhash._similar(rows, rows, (16, 32), 0.8, False) for a, b in zip(x, y)}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 16
    want = {(a, b) for a, b in zip(*map(lambda v: v.tolist(), np.nonzero(near))) if a // 2 != b // 2 and (n[a], a) < (n[b], b) and n[a] >= 0.8 * n[b] - 1e-6}
    assert found == want and len(want) > 50
    assert all(((least <= ones) & (ones <= most)).all() for least, most, ones in seen)


def test_near_copies_meet_under_shared_keys_only(spark, monkeypatch):
    """Every pair alike by 0.8 shares a key in any order of shingles; unlike texts make no pairs, whatever their number."""
    rng, similarity = random.Random(21), 0.8
    vocabulary = [f"w{k}" for k in range(4_000)]
    texts = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(300)]
    for t in texts[:80]:
        words = t.split()
        words[rng.randrange(6, 74)] = f"new{len(texts)}"
        texts.append(" ".join(words))
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    common = np.unique(np.concatenate(sets))[::3]
    order = (common, np.arange(3, 3 + len(common)))
    keys = [set(simhash.prefix(s, order, similarity).tolist()) for s in sets]
    for i, (a, b) in enumerate(zip(sets[:80], sets[300:])):
        if len(np.intersect1d(a, b)) >= similarity * len(np.union1d(a, b)):
            assert keys[i] & keys[300 + i]

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made, near = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a: made.append((a, near(*a))) or made[0][1])
    found = {r.doc_id: r.root for r in simhash.similar_classes(rows).collect()}
    assert sum(found[i] == found[300 + i] for i in range(80)) > 70 and len(set(found.values())) == 380 - sum(found[i] == found[300 + i] for i in range(80))
    (shared, parted, _), pairs = made[0]
    assert shared.select("row_key").distinct().count() <= 160 and pairs.count() <= 10
    alone = parted.withColumn("part", F.col("row_key"))
    want = {(r.a, r.b) for r in near(shared, alone, similarity).collect()}
    monkeypatch.setattr(simhash, "SMALL_GROUP", 1)
    assert len(want) > 70 and want == {(r.a, r.b) for r in near(shared, alone, similarity, 1).collect()}


def test_similar_texts_with_distant_fingerprints_are_near_copies(spark):
    """Texts alike by 0.8 whose 128-bit fingerprints differ in more than 38 bits, or in more than 22 of the first 64."""
    import corpus_pipeline

    rng, rows = random.Random(5), []
    while len(rows) < 6:
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        bits = []
        for text in (words, words[:8]):
            distinct = np.unique(simhash.shingle_hashes(" ".join(text), 5))
            mixed = (distinct ^ (distinct >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits.append((simhash.majority(distinct), simhash.majority(mixed ^ (mixed >> np.uint64(32)))))
        first, second = ((a ^ b).bit_count() for a, b in zip(*bits))
        if first > 22 or first + second > 38:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:8]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, SF).collect()} == {0, 2, 4}


def test_marks_rule_out_no_similar_pair():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n, own = int(rng.integers(1, 900)), int(rng.integers(0, 90))
        both, left, right = (rng.integers(0, 2**63, size, np.uint64) for size in (n, own, int(rng.integers(0, 90))))
        a, b = (np.frombuffer(simhash.marks_of(np.r_[both, x]), np.uint64)[None, :] for x in (left, right))
        x = np.zeros(1, np.int64)
        most = np.array([len(left) + len(right)])
        assert len(simhash._allowed(np.zeros(1, np.int64), x, x, a, b, most)[0]) == 1


def test_texts_alike_to_a_third_are_compared_themselves(spark):
    """Two texts each share an edited passage of 60 words with a third, at one word's difference; with each other not."""
    words = _text("hub", 60).split()
    passages = [" ".join([*words[:at], "edited", *words[at + 1 :]]) if at else " ".join(words) for at in (0, 20, 40)]
    texts = [f"{_text(f'u{i}', 70)} {p} {_text(f'v{i}', 70)}" for i, p in enumerate(passages)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.n_links for r in repeats.repeated_passages(frame).collect()}
    assert rows == {0: 2, 1: 1, 2: 1}


def test_every_place_of_a_key_meets_every_other(spark):
    """Five texts of a key, one of which holds it twice; all pairs that are likely are asked for, at each place."""
    place = "key bigint, text_id bigint, anchor int, first int, last int"
    keys = spark.createDataFrame([(1, i, 10 * i, 0, 90) for i in range(5)] + [(1, 4, 70, 30, 120)], place)
    every = [(a, b) for a in range(5) for b in range(5) if a != b]
    pairs = spark.createDataFrame(every, "text_id bigint, other bigint")
    found = {(r.text_id, r.other, r["shift"]) for r in repeats.second_candidates(keys, keys, pairs).collect()}
    at = {i: [10 * i] for i in range(4)} | {4: [40, 70]}
    assert found == {(a, b, x - y) for a, b in every for x in at[a] for y in at[b]}


def test_stretches_are_all_that_a_plain_search_finds():
    """Also those that the longest one overlaps, and in a part no place that the whole does not give."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        same = rng.random(90) < rng.choice([0.75, 0.85, 0.92, 1.0])
        want = np.zeros(90, bool)
        for i in np.flatnonzero(same):
            for j in np.flatnonzero(same) + 1:
                if j - i >= 20 and 9 * same[i:j].sum() >= 8 * (j - i):
                    want[i:j] = True
        found, part = np.zeros(90, bool), np.zeros(90, bool)
        for start, end in repeats.stretches(same, 8 / 9, 20):
            found[start:end] = True
        for start, end in repeats.stretches(same[10:70], 8 / 9, 20):
            part[10 + start : 10 + end] = True
        assert (found == want).all() and not (part & ~found).any()
