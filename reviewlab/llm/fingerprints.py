"""Document fingerprints from prefix polynomial hashes.

For a text c_0 c_1 ... the arrays H[i] = sum over j < i of (c_j + 1) * B^j mod p, for two primes, answer whether any two
spans are equal in constant time and give longest common extensions by binary search. The fingerprint string is the
length and both hashes of the whole text; likeness of two fingerprinted texts is the share of the longer one that their
longest common extensions, forward from the start and backward from the end, cover (1 for equal texts).

``edited_neighbours`` needs each document next to its successor in descending id order: documents are dealt into id ranges
of about ``ZONE_ROWS`` rows (``MOST_ZONES`` at most), and a task streams its sorted range, so the texts are read and
shuffled once and nothing is ordered in one task. The first and the last document of each range are written beside the
results, and a join of these few pairs every last one with the first of the next range.

Defined results: a null text is the empty text, which is fully like itself and not at all like others; null ids come
last in the order, equal ids are ordered by text hash; a single document is its own successor; an empty table gives no
rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import arrow_rows, batched, keyed
from reviewlab.session import durable

PRIMES = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
_POWERS: dict[int, np.ndarray] = {}


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """B^0 ... B^(n-1) mod p, grown by doubling and kept for the next text."""
    known = _POWERS.get(prime)
    if known is None:
        known = np.ones(1, np.uint64)
    while len(known) < n:
        step = np.uint64(pow(base, len(known), prime))
        known = np.concatenate([known, known * step % np.uint64(prime)])
    _POWERS[prime] = known
    return known[:n]


class PrefixHash:
    """Prefix arrays of one text; spans are [start, end) in code points."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix = []
        for prime, base in PRIMES:
            terms = points * powers(prime, base, self.n) % np.uint64(prime)
            sums = np.empty(self.n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(terms, out=sums[1:])
            sums %= np.uint64(prime)
            self.prefix.append(sums)

    def fingerprint(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(h[-1]):08x}" for h in self.prefix)

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        """Whether two spans are equal: each difference of prefixes is moved to the other's power."""
        for (prime, base), h, g in zip(PRIMES, self.prefix, other.prefix):
            mine, theirs = int(h[start + length]) - int(h[start]), int(g[other_start + length]) - int(g[other_start])
            shift = other_start - start
            if shift > 0:
                mine *= pow(base, shift, prime)
            elif shift < 0:
                theirs *= pow(base, -shift, prime)
            if (mine - theirs) % prime:
                return False
        return True

    def forward(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Longest common extension to the right of two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, other_start, mid) else (low, mid - 1)
        return low

    def backward(self, end: int, other: PrefixHash, other_end: int) -> int:
        """Longest common extension to the left of two positions."""
        low, high = 0, min(end, other_end)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(end - mid, other, other_end - mid, mid) else (low, mid - 1)
        return low

    def likeness(self, other: PrefixHash) -> float:
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        if not longer:
            return 1.0
        head = self.forward(0, other, 0)
        tail = self.backward(self.n, other, other.n) if head < shorter else 0
        return min(head + tail, shorter) / longer


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many of the first code points of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint. One pass, no shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [PrefixHash(t or "") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([h.n for h in hashed], pa.int64()), pa.array([h.fingerprint() for h in hashed])]
            yield pa.record_batch(columns, names=["doc_id", "n_chars", "fingerprint"])

    return keyed(docs).mapInArrow(compute, "doc_id bigint, n_chars bigint, fingerprint string")


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by binary search; 0 for null."""
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at),
    )


NEIGHBOURS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


RESULT, FIRST, LAST = 0, 1, 2
OUT = pa.schema([("kind", pa.int32()), ("zone", pa.int64()), *NEIGHBOURS, ("text", pa.string())])
ZONE_ROWS, MOST_ZONES, SUBZONES = 1_000, 10_000, 64
TEXTS_AT_ONCE = 256


def _pair(before: tuple, after: PrefixHash, text: str) -> tuple:
    """The ``NEIGHBOURS`` row of (id, text, hashes) beside the text that follows it."""
    doc_id, own, hashed = before
    changed = edited(own, text)
    other = PrefixHash(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return (doc_id, hashed.n, digest, hashed.fingerprint(), other.fingerprint(), hashed.likeness(other), hashed.likeness(after))


def _compare_stream(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (zone, doc_id, text) in order: every row but the last of a zone beside the row after it; and both ends."""
    nothing, zone, held = (None,) * (len(NEIGHBOURS) - 1), None, None
    for at, doc_id, text in rows:
        text = text or ""
        this = PrefixHash(text)
        if at != zone:
            if held is not None:
                yield (LAST, zone, held[0], *nothing, held[1])
            yield (FIRST, at, doc_id, *nothing, text)
        else:
            yield (RESULT, at, *_pair(held, this, text), None)
        zone, held = at, (doc_id, text, this)
    if held is not None:
        yield (LAST, zone, held[0], *nothing, held[1])


def zone_cuts(ids: DataFrame, zones: int) -> tuple[list[int], list[int]]:
    """Sorted bounds of about ``zones`` id ranges of as many rows, and the ids that fill more than a range of their own."""
    share = [k / zones for k in range(1, zones)] or [0.5]
    found = ids.agg(F.percentile_approx("doc_id", share, min(10_000, 10 * zones + 100)).alias("cuts")).first()["cuts"] or []
    hot = sorted({a for a, b in zip(found, found[1:]) if a == b})
    return sorted({*found, *(v + 1 for v in hot if v < (1 << 63) - 1)}), hot


def edited_neighbours(docs: DataFrame, zones: int | None = None) -> DataFrame:
    """Every document beside its edited text and its successor: the columns of ``NEIGHBOURS``."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    zones = zones or max(1, min(MOST_ZONES, -(-ids.count() // ZONE_ROWS)))
    cuts, hot = zone_cuts(ids, zones)
    # An id that fills a range, and rows without id, are dealt on by text hash, which is the order among equal ids.
    by_hash = F.col("doc_id").isNull() | F.col("doc_id").isin(hot) if hot else F.col("doc_id").isNull()
    within = F.when(by_hash, F.shiftright("text_hash", 58) + SUBZONES // 2).otherwise(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of(F.col("doc_id"), cuts))
    rows = keyed(docs, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")).withColumn("zone", at.cast("bigint") * SUBZONES + within)
    ordered = rows.repartition("zone").sortWithinPartitions(F.desc("zone"), F.desc_nulls_last("doc_id"), F.desc("text_hash"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("zone", "doc_id", "text"))))
        yield from batched(_compare_stream(stream), OUT, TEXTS_AT_ONCE)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, own, text in zip(*(c.to_pylist() for c in batch.columns)):
                found.append(_pair((doc_id, own, PrefixHash(own)), PrefixHash(text), text))
            yield from batched(found, NEIGHBOURS, TEXTS_AT_ONCE)

    with arrow_rows(spark, TEXTS_AT_ONCE):
        written = durable(ordered.select("zone", "doc_id", "text").mapInArrow(compute, f"kind int, zone bigint, {_ddl()}, text string"))
    ends = written.where(F.col("kind") != RESULT).select("kind", "zone", "doc_id", "text")
    used = sorted((r.zone for r in ends.where(F.col("kind") == FIRST).select("zone").collect()), reverse=True)
    follows = spark.createDataFrame(list(zip(used, [*used[1:], *used[:1]])), "zone bigint, next bigint")
    last = ends.where(F.col("kind") == LAST).select("zone", "doc_id", F.col("text").alias("own")).join(F.broadcast(follows), "zone")
    first = ends.where(F.col("kind") == FIRST).select(F.col("zone").alias("next"), "text")
    joined = last.join(first, "next").select("doc_id", "own", "text").mapInArrow(pairs, _ddl())
    return written.where(F.col("kind") == RESULT).select(NEIGHBOURS.names).unionByName(joined)


def _ddl() -> str:
    return (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
