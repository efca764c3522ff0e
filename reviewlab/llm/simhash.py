"""SimHash near-dedup: 64-bit fingerprints, tiled exact comparison, connected classes.

Fingerprints within radius r agree on at least one of r + 1 bit blocks, so the equal values of each block bound where
partners can be. Inside a block value the fingerprints, sorted by population count, are compared tile against tile with
numpy (exclusive-or and bit counts); tile pairs whose population counts differ by more than the radius are skipped. A
block value with more than ``TILE`` fingerprints is cut into tiles by population count that are compared in tasks of
their own, so a hot value never gathers in one task. A task returns a spanning forest of the links it finds, never
all pairs, and exact copies are one fingerprint throughout: every class comes out whole.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; a null id gets a
fingerprint and the class of its group, which is named by the smallest id there (null if there is none); rows that
repeat an id stay rows; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are passed through.

``keep_one_similar`` works on similarity instead of a radius: texts are linked if the Jaccard similarity of their word
shingles reaches it. In any fixed order of all shingles, two such texts share one of the first n - ceil(similarity * n) + 1
of each (prefix filter, exact), so texts meet under these keys only. Shingles that many texts of a bounded probe hold come
last in the order; that decides how many texts meet, never which links are found. Of the texts that meet, those whose
numbers of shingles allow it and whose marks do not rule it out are verified on the shingles themselves. Marks are bits
that every shingle flips one of: bits that differ are at most the shingles that only one of the texts has (exact), so no
similar pair is lost by them; fingerprints only decide which pairs are tried first (``TIGHT``). Each text is tried on the first text of one of its keys, and then texts of a key
that are not connected yet on each other; a key with more than ``TILE`` texts is dealt over tasks in pairs of tiles, and
larger groups skip by population count like those above. Texts without a word are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import arrow_rows, keyed
from reviewlab.session import durable

TILE = 1_024
KERNEL = 512
TIGHT = 12, 22
"""Most differing bits of the first 64 and of all 128 of links looked for first."""
MARK_BITS = 512
SKETCH_ROWS = 1_000
SMALL_GROUP = 64
SEEN_TEXTS = 100_000
PROBE_ROWS, COMMON_TEXTS, COMMON_ROWS = 10_000, 3, 100_000
"""Texts whose shingles are counted for their order, how many of these hold a common one, and most common ones."""
VERIFIED_ROWS = 4_096
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of a text, one of all words if there are fewer; none without a word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, words_per_shingle
    if len(words) <= n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(n))))
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned fingerprint: bit set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def simhash(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: bit set if it is set in over half of the shingle hashes."""
    return majority(shingle_hashes(text, words_per_shingle, seed))


def with_fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, row_key (hash of the text, tells rows of one id apart), fp (bigint that holds the 64 bits)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), words_per_shingle, seed) for t in batch.column(1)], np.uint64)
            columns = [batch.column(0), batch.column(2), pa.array(prints.view(np.int64))]
            yield pa.record_batch(columns, names=["doc_id", "row_key", "fp"])

    rows = keyed(docs, row_key("text").alias("row_key"))
    return rows.mapInArrow(compute, "doc_id bigint, row_key bigint, fp bigint")


def row_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _compare(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between two runs sorted by population count: kernel tiles, skipped when their counts are too far apart."""
    links = []
    lp, rp = np.bitwise_count(left).astype(int), np.bitwise_count(right).astype(int)
    for i in range(0, len(left), KERNEL):
        a, top, low = left[i : i + KERNEL], lp[min(i + KERNEL, len(left)) - 1], lp[i]
        for j in range(i if same else 0, len(right), KERNEL):
            if rp[j] - top > radius:
                break
            if low - rp[min(j + KERNEL, len(right)) - 1] > radius:
                continue
            b = right[j : j + KERNEL]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if same and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                links.append((a[x], b[y]))
    return links


def _forest(links: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links: at most one per linked fingerprint."""
    parent: dict[int, int] = {}
    out = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    for xs, ys in links:
        for x, y in zip(xs.view(np.int64).tolist(), ys.view(np.int64).tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def _by_count(values: np.ndarray) -> np.ndarray:
    return values[np.lexsort((values, np.bitwise_count(values)))]


def _runs(radius: int):
    """mapInArrow over rows sorted by (key, side): compares each key's rows, or its two sides if side 1 occurs."""

    def links_of(fps: np.ndarray, sides: np.ndarray) -> list:
        left, right = fps[sides == 0], fps[sides == 1]
        if len(right):
            return _compare(_by_count(left), _by_count(right), radius, False)
        left = _by_count(left)
        return _compare(left, left, radius, True)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in (batch.column("key"), batch.column("fp"), batch.column("side"))]
            if carry is not None:
                part = [np.concatenate(x) for x in zip(carry, part)]
            keys = part[0]
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            carry = [x[last:] for x in part]
            yield from emit([x[:last] for x in part])
        if carry is not None:
            yield from emit(carry)

    def emit(part):
        keys, fps, sides = part
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        found = []
        for s, e in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends))):
            found += _forest(links_of(fps[s:e].view(np.uint64), sides[s:e]))
        if found:
            a, b = zip(*found)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    return compute


def near_links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """a, b: links that connect exactly the distinct fingerprints ``fp`` connected at ``radius`` or fewer bits."""
    blocks, keys, at = radius + 1, [], 0
    for k in range(blocks):
        width = 64 // blocks + (k < 64 % blocks)
        mask = ((1 << width) - 1) << at
        value = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))
        keys.append(F.xxhash64(F.lit(k), value))
        at += width
    rows = durable(
        prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("key"))
    )
    counts = rows.groupBy("key", "ones").agg(F.count(F.lit(1)).alias("n"))
    hot = durable(counts.groupBy("key").agg(F.sum("n").alias("rows")).where(F.col("rows") > tile).select("key"))

    plain = rows.join(hot, "key", "left_anti").select("key", "fp", F.lit(0).alias("side"))
    classes = counts.join(hot, "key", "left_semi").select("key", "ones", F.ceil(F.col("n") / tile).cast("int").alias("cuts"))
    other = classes.select("key", F.col("ones").alias("ones2"), F.col("cuts").alias("cuts2"))
    pairs = classes.join(other, "key").where((F.col("ones2") >= F.col("ones")) & (F.col("ones2") - F.col("ones") <= radius))
    numbered = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = pairs.withColumn("i", F.explode(numbered("cuts"))).withColumn("j", F.explode(numbered("cuts2")))
    pairs = durable(pairs.where((F.col("ones") < F.col("ones2")) | (F.col("i") <= F.col("j"))))
    tiles = F.xxhash64("key", "ones", "i", "ones2", "j")
    one = (F.col("ones") == F.col("ones2")) & (F.col("i") == F.col("j"))
    lefts = pairs.select("key", "ones", F.col("i").alias("cut"), tiles.alias("pair"), F.lit(0).alias("side"))
    rights = pairs.where(~one).select(
        "key", F.col("ones2").alias("ones"), F.col("j").alias("cut"), tiles.alias("pair"), F.lit(1).alias("side")
    )
    cut = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    crowded = rows.join(hot, "key", "left_semi").join(classes, ["key", "ones"]).select("key", "ones", "fp", cut.alias("cut"))
    members = crowded.join(lefts.union(rights), ["key", "ones", "cut"])
    dealt = plain.union(members.select(F.col("pair").alias("key"), "fp", "side"))
    swept = dealt.repartition("key").sortWithinPartitions("key", "side")
    return swept.mapInArrow(_runs(radius), "a bigint, b bigint").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root: every linked node and the smallest node of its component.

    Alternating large and small stars: each round links every node to the least neighbour seen, until nothing changes.
    Rounds are written tables, so a lost executor costs no more than its round; no link list reaches the driver.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("m", "hi").alias("m"))
        large = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = durable(large.distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        after = durable(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(down.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        roots = after.select("lo").distinct().join(after.select(F.col("hi").alias("lo")), "lo", "left_semi")
        twice = after.groupBy("hi").count().where("count > 1")
        if roots.isEmpty() and twice.isEmpty():
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        edges = after


def classes(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, row_key, fp, root (names the class), component_id for every row."""
    prints = durable(with_fingerprints(docs, words_per_shingle, seed))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.select("fp", "root").join(named, "root")
    return prints.join(by_print, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


SKETCH = pa.schema([("row_key", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("n", pa.int32()), ("marks", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _fresh_texts(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[int, str | None]]:
    """row_key and text of the rows (text, row_key) whose text this task has not just had: copies do not travel."""
    for key, text in zip(batch.column(1).to_pylist(), batch.column(0)):
        if key not in seen:
            if len(seen) >= SEEN_TEXTS:
                seen.clear()
            seen.add(key)
            yield key, text.as_py()


def common_shingles(texts: DataFrame, words_per_shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a probe of about ``PROBE_ROWS`` hold, and how many do."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, text in _fresh_texts(batch, seen):
                distinct = np.unique(shingle_hashes(text, words_per_shingle, seed))
                yield pa.record_batch([pa.array(distinct.view(np.int64))], names=["key"])

    part = F.pmod(F.xxhash64("row_key", F.lit("probe")), F.lit(max(1, texts.count() // PROBE_ROWS)))
    held = texts.where(part == 0).mapInArrow(compute, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = held.where(F.col("n") >= COMMON_TEXTS).orderBy(F.desc("n"), "key").limit(COMMON_ROWS).toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(distinct: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the sorted ``distinct`` shingles in order of (how common, hash), of which texts that are similar share one.

    Texts without a shingle share the key 0.
    """
    if not len(distinct):
        return np.zeros(1, np.uint64)
    keys, counts = common
    if len(keys):
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        distinct = distinct[np.argsort(np.where(keys[at] == distinct, counts[at], 0), kind="stable")]
    return distinct[: len(distinct) - int(np.ceil(similarity * len(distinct) - 1e-6)) + 1]


def marks_of(mixed: np.ndarray) -> bytes:
    """Bits flipped once by each of the distinct hashes: where those of two sets differ, so do the sets."""
    odd = np.bincount((mixed % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _marks(column: pa.Array) -> np.ndarray:
    """[row, word]: the marks of a column, without a copy."""
    if not len(column):
        return np.zeros((0, MARK_BITS // 64), np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(column), -1)


def _apart(similarity: float) -> float:
    """The share of the shingles of two texts, counted together, that at most only one of the two has if they are similar."""
    return (1 - similarity) / (1 + similarity)


def with_sketches(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float, words_per_shingle: int = 5, seed: int = 42) -> DataFrame:
    """row_key, fp and fp2 (128 bits), n (number of distinct shingles), marks and keys (their prefix) of texts; some of them repeat."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for key, text in _fresh_texts(batch, seen):
                distinct = np.unique(shingle_hashes(text, words_per_shingle, seed))
                mixed = (distinct ^ (distinct >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(32)
                prints = np.array([majority(distinct), majority(mixed)], np.uint64).view(np.int64)
                rows.append((key, *prints.tolist(), len(distinct), marks_of(mixed), prefix(distinct, shared.value, similarity).view(np.int64)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), SKETCH)], schema=SKETCH)

    return texts.mapInArrow(compute, "row_key bigint, fp bigint, fp2 bigint, n int, marks binary, keys array<bigint>")


def _by_band(batch, similarity: float) -> list[np.ndarray]:
    """row_key, first and further words of bits, n, part, band and number of bits set in order of the last two: sets of
    ``similarity`` have numbers of shingles of the same band or of two that follow each other.

    The bits are the marks, or the two fingerprints of rows without (of these the first counts).
    """
    key, n, part = (batch.column(c).to_numpy() for c in ("row_key", "n", "part"))
    if "marks" in batch.schema.names:
        words = _marks(batch.column("marks"))
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    else:
        words = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")], axis=1)
        ones = np.bitwise_count(words[:, 0]).astype(np.int64)
    band = np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / max(-np.log(similarity), 1e-3) + 1e-9), -2).astype(np.int64)
    order = np.lexsort((key, ones, band))
    return [c[order] for c in (key, words[:, 0], words[:, 1:], n.astype(np.int64), part, band, ones)]


def _similar(left: list, right: list, reach: tuple[int, int] | None, similarity: float, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of different parts, the left before the right in order of (n, row_key); with ``one`` the first of a row.

    Near are those of which at most ``reach`` bits differ, in the first word and in all, or (None) all that marks allow. Of the
    bands that a tile can meet, only tiles whose numbers of bits are within reach of its own are compared.
    """
    key, first_word, words, n, part, band, ones = left
    key2, first_word2, words2, m, part2, bands, ones2 = right
    share = _apart(similarity)
    ends = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
    for i, end in ((i, end) for first, end in zip(ends, ends[1:]) for i in range(first, end, KERNEL)):
        at = slice(i, min(i + KERNEL, end))
        open_rows = np.ones(len(key[at]), bool)
        # The right one of a similar pair has at most n / similarity shingles.
        away = reach[0] if reach else int(share * (1 + 1 / similarity) * int(n[at].max()) + 1e-3) + 1
        for j, top in _within(bands, ones2, int(band[i]), int(ones[at][0]) - away, int(ones[at][-1]) + away):
            to = slice(j, top)
            bits = np.bitwise_count(first_word[at][:, None] ^ first_word2[to][None, :]).astype(np.int64)
            x, y = np.nonzero(bits <= away)
            bits, x, y = bits[x, y], x + i, y + j
            good = (part[x] != part2[y]) & ((n[x] < m[y]) | ((n[x] == m[y]) & (key[x] < key2[y])))
            good &= n[x] >= similarity * m[y] - 1e-6
            bits, x, y = bits[good], x[good], y[good]
            x, y = _allowed(bits, x, y, words, words2, reach[1] if reach else share * (n[x] + m[y]) + 1e-6)
            if one:
                x, first = np.unique(x, return_index=True)
                fresh = open_rows[x - i]
                x, y = x[fresh], y[first[fresh]]
                open_rows[x - i] = False
            if len(x):
                yield key[x], key2[y]


def _allowed(bits: np.ndarray, x: np.ndarray, y: np.ndarray, words: np.ndarray, words2: np.ndarray, most: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs x, y of which at most so many bits differ, ``bits`` before the given words."""
    most = np.broadcast_to(most, len(x))
    for word in range(words.shape[1]):
        bits = bits + np.bitwise_count(words[x, word] ^ words2[y, word])
        good = bits <= most
        bits, x, y, most = bits[good], x[good], y[good], most[good]
    return x, y


def _within(bands: np.ndarray, ones: np.ndarray, band: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Kernel tiles of a band and the two behind it, of numbers of bits from ``least`` to ``most``."""
    for number in (band, band + 1, band + 2):
        start, stop = np.searchsorted(bands, [number, number + 1])
        first, last = start + np.searchsorted(ones[start:stop], least), start + np.searchsorted(ones[start:stop], most, "right")
        for j in range(int(first), int(last), KERNEL):
            yield j, min(j + KERNEL, int(last))


def shared_keys(sketches: DataFrame) -> DataFrame:
    """key, row_key, first: the texts of every key that several texts have, and the least of them."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, told, last = None, False, None
        for batch in batches:
            keys, texts = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            fresh = np.r_[last != (keys[0], texts[0]), (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])]
            last = keys[-1], texts[-1]
            keys, texts = keys[fresh], texts[fresh]
            if head is not None:  # the first row of the key that the batch before ended with
                keys, texts = np.r_[head[0], keys], np.r_[head[1], texts]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            out = np.repeat(sizes > 1, sizes)
            out[0] &= head is None or not told
            first = np.repeat(texts[starts], sizes)
            told = bool(sizes[-1] > 1) or (told and len(starts) == 1)
            head = keys[starts[-1]], texts[starts[-1]]
            yield pa.record_batch([pa.array(c[out]) for c in (keys, texts, first)], names=["key", "row_key", "first"])

    rows = sketches.select(F.explode("keys").alias("key"), "row_key").repartition("key").sortWithinPartitions("key", "row_key")
    return rows.mapInArrow(compute, "key bigint, row_key bigint, first bigint")


def first_pairs(shared: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """a, b: for every text at most one text that is the first of one of its keys and has a close fingerprint."""
    one, two = (sketches.select(*[F.col(c).alias(f"{c}_{x}") for c in ("row_key", "fp", "fp2", "n")]) for x in "ab")
    met = shared.where("first <> row_key").select(F.col("first").alias("row_key_a"), F.col("row_key").alias("row_key_b")).distinct()
    met = met.join(two, "row_key_b").join(one, "row_key_a")
    bits, more = (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ("fp", "fp2"))
    fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    near = met.where(fits & (bits <= TIGHT[0]) & (bits + more <= TIGHT[1]))
    return durable(near.groupBy(F.col("row_key_b").alias("b")).agg(F.min("row_key_a").alias("a")).select("a", "b"))


def _small_groups(part: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose marks allow it inside each run of rows, or between its rows of side 0 and 1 if the latter occur."""
    sizes = ends - starts
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    key, marks, n, of, side = (part[c][rows] for c in ("row_key", "marks", "n", "part", "side"))
    stop = np.cumsum(sizes)
    lefts = np.add.reduceat(side == 0, stop - sizes)
    two, middle = np.repeat(lefts < sizes, sizes), np.repeat(stop - sizes + lefts, sizes)
    low = np.where(two, middle, np.arange(len(rows)) + 1)
    counts = np.where(two & (side == 1), 0, np.repeat(stop, sizes) - low)
    x = np.repeat(np.arange(len(rows)), counts)
    y = np.arange(len(x)) + np.repeat(low - (np.cumsum(counts) - counts), counts)
    good = (of[x] != of[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
    x, y = x[good], y[good]
    x, y = _allowed(np.zeros(len(x), np.int64), x, y, marks, marks, _apart(similarity) * (n[x] + n[y]) + 1e-6)
    turned = (n[x] > n[y]) | ((n[x] == n[y]) & (key[x] > key[y]))
    return np.where(turned, key[y], key[x]), np.where(turned, key[x], key[y])


def near_pairs(shared: DataFrame, sketches: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """a, b: pairs of texts of a common key and different ``part`` that may be similar."""
    keyed_parts = shared.join(sketches.select("row_key", "part"), "row_key").groupBy("key")
    mixed = keyed_parts.agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    mixed = durable(mixed.select("key", F.ceil(F.col("n") / tile).cast("int").alias("cuts")))
    rows = shared.select("key", "row_key").join(mixed, "key").join(sketches.drop("fp", "fp2"), "row_key")
    own = F.pmod(F.xxhash64("row_key"), F.col("cuts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    columns = ["pair", "row_key", "n", "part", "side", "marks"]
    rows = rows.withColumn("pair", pair).withColumn("side", side).select(columns)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if carry is None else [carry, batch])
            carry = table.combine_chunks().to_batches()
            if not carry:
                carry = None
                continue
            pairs = carry[0].column("pair").to_numpy()
            last = int(np.searchsorted(pairs, pairs[-1]))
            done, carry = carry[0].slice(0, last), carry[0].slice(last)
            yield from emit(done)
        if carry is not None:
            yield from emit(carry)

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        part = {c: batch.column(c).to_numpy() for c in columns[:-1]} | {"marks": _marks(batch.column("marks"))}
        starts = np.flatnonzero(np.r_[True, part["pair"][1:] != part["pair"][:-1]])
        ends = np.r_[starts[1:], batch.num_rows]
        small = ends - starts <= SMALL_GROUP
        found = [_small_groups(part, starts[small], ends[small], similarity)] if small.any() else []
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
            lefts = int((part["side"][s:e] == 0).sum())
            left = _by_band(batch.slice(s, lefts), similarity)
            if lefts == e - s:
                found += _similar(left, left, None, similarity, False)
            elif lefts:
                right = _by_band(batch.slice(s + lefts, e - s - lefts), similarity)
                found += _similar(left, right, None, similarity, False)
                found += _similar(right, left, None, similarity, False)
        for a, b in found:
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=LINKS)

    met = rows.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(compute, "a bigint, b bigint")
    return durable(met.distinct())


def similar_links(pairs: DataFrame, texts: DataFrame, similarity: float, words_per_shingle: int = 5, seed: int = 42) -> DataFrame:
    """The pairs whose shingles have at least that Jaccard similarity.

    The text ``b`` of a pair travels to where ``a`` is; an ``a`` with many pairs is dealt over tasks.
    """
    # Written, so that the plan knows its size: while it is small, the texts are not shuffled to find the few.
    involved = durable(pairs.select(F.col("a").alias("row_key")).union(pairs.select("b")).distinct())
    held = durable(texts.join(involved, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", "text"))
    cuts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / VERIFIED_ROWS).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int")
    seconds = pairs.join(cuts, "a").select("a", cut.alias("cut"), F.lit(1).alias("side"), F.col("b").alias("row_key"))
    cut = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    firsts = cuts.select("a", cut.alias("cut"), F.lit(0).alias("side"), F.col("a").alias("row_key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, side, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                other = np.unique(shingle_hashes(text, words_per_shingle, seed))
                if side == 0:
                    own = other
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                    out.append((a, b))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=LINKS)

    sent = firsts.union(seconds).join(held, "row_key").repartition("a", "cut").sortWithinPartitions("a", "cut", "side")
    with arrow_rows(pairs.sparkSession, SKETCH_ROWS):
        return durable(sent.select("a", "side", "row_key", "text").mapInArrow(compare, "a bigint, b bigint"))


def similar_classes(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """doc_id, row_key, root (names the class) for every row: classes of texts linked by shingle similarity.

    Close fingerprints are linked first, at most one link a text; then every pair not yet connected is looked at.
    """
    rows = keyed(docs, row_key("text").alias("row_key"))
    texts = rows.select("text", "row_key")
    with arrow_rows(docs.sparkSession, SKETCH_ROWS):
        found = durable(with_sketches(texts, common_shingles(texts, words_per_shingle), similarity, words_per_shingle))
    shared = durable(shared_keys(found))
    involved = shared.select("row_key").distinct()
    sketches = durable(found.select("row_key", "fp", "fp2", "n", "marks").join(involved, "row_key", "left_semi").distinct())
    first = similar_links(first_pairs(shared, sketches, similarity), texts, similarity, words_per_shingle)
    roots = connected(first).select(F.col("node").alias("row_key"), F.col("root").alias("part"))
    parted = durable(sketches.join(roots, "row_key", "left").withColumn("part", F.coalesce("part", "row_key")))
    links = first.union(similar_links(near_pairs(shared, parted, similarity), texts, similarity, words_per_shingle))
    linked = connected(links).select(F.col("node").alias("row_key"), "root")
    return rows.select("doc_id", "row_key").join(linked, "row_key", "left").withColumn("root", F.coalesce("root", "row_key"))


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with one row left of each class of similar texts, chosen as in ``keep_one``."""
    return _first_rows(docs, similar_classes(docs, similarity, words_per_shingle))


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` with one row left of each class: the smallest id's, or the smallest text key's without ids."""
    return _first_rows(docs, classes(docs, radius))


def _first_rows(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """The first row of each class.

    The narrow table of kept rows is joined back to the texts on (id, text key); rows that repeat both are one row.
    """
    no_id = F.lit(-(1 << 63))
    first = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", no_id).alias("id"), F.col("row_key").alias("text"))
    kept = classed.groupBy("root").agg(F.min(first).alias("keep")).select("keep.id", "keep.text")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), no_id).alias("id"),
        row_key("text").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return rows.join(kept, ["id", "text"], "left_semi").dropDuplicates(["id", "text"]).select("row.*")
