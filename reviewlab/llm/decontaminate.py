"""Benchmark decontamination by spaced seeds.

Each mask selects some positions of a short window of words and ignores the others, so a seed survives substituted
words at the ignored positions. The seeds of the benchmark are hashed into a sorted table; documents stream past it,
their seed hashes are looked up, and every hit fixes an alignment of document and item. Along the alignment the longest
stretch with at least ``similarity`` equal words is found; it counts as a leak from ``min_words`` words on (the whole
item, judged from end to end, if that is not longer). The masks together catch every stretch of 13 words with two substitutions and of 15 with three.

The benchmark is taken in blocks of at most about ``BLOCK_WORDS`` words. One block's table is broadcast at a time, and
documents are compared with every block, so neither side's size is limited and documents are never shuffled.

Words are runs of letters and digits of blank-separated tokens, lower-cased. Defined results: null and empty texts
match nothing; items of under five words match where all their words do; rows that repeat an id are each compared; an empty
benchmark or table gives no matches; a null item id is kept as null; columns besides those named are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 5, 6))
BLOCK_WORDS = 2_000_000
CACHED_TOKENS = 200_000
NOT_WORD = re.compile(r"[\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


class _WordHashes(dict):
    """Token -> 64-bit hash of its word, 0 if it has no letter or digit."""

    def __missing__(self, token: str) -> int:
        word = token.lower()
        if not word.isalnum():
            word = NOT_WORD.sub("", word)
        found = self[token] = xxhash.xxh64_intdigest(word) | 1 if word else 0
        return found


class WordHasher:
    """64-bit hashes of a text's words; tokens are hashed once per task."""

    def __init__(self) -> None:
        self.known = _WordHashes()

    def words(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self.known) > CACHED_TOKENS:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        return hashes[hashes != 0]


def seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the selected words at every place of the mask."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for offset, factor in zip(mask, _MIX):
        out ^= words[offset : offset + n] * factor
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """(start, end) of the longest stretch of which at least the share ``similarity`` is true.

    Prefix sums of (true - similarity) from the left's least and the right's greatest values: for each end the first
    start that is not above it. The stretch begins and ends with a true value.
    """
    scale = 1000
    sums = np.concatenate([[0], np.cumsum(np.where(equal, scale, 0) - round(similarity * scale))])
    least = np.minimum.accumulate(sums)
    greatest = np.maximum.accumulate(sums[::-1])[::-1]
    first = np.searchsorted(-least, -greatest, "left")
    end = int(np.argmax(np.arange(len(sums)) - first))
    at = int(first[end]), end
    hits = np.flatnonzero(equal[at[0] : at[1]])
    return (at[0] + int(hits[0]), at[0] + int(hits[-1]) + 1) if len(hits) else (0, 0)


@dataclass
class SeedTable:
    """Seeds of one block of items, sorted, with a bitmap over their leading bits that answers most lookups."""

    items: list
    words: list[np.ndarray]
    hashes: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]
    bitmap: np.ndarray
    blocks: dict | None = None

    @classmethod
    def build(cls, items: list[tuple]) -> SeedTable:
        hasher = WordHasher()
        words = [hasher.words(text) for _, text in items]
        hashes, item, place, bitmap = [], [], [], np.zeros(1 << 22, bool)
        for number, mask in enumerate(MASKS):
            found = [seeds(w, mask, number) for w in words]
            all_hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
            order = np.argsort(all_hashes, kind="stable")
            counts = np.array([len(f) for f in found], np.int64)
            hashes.append(all_hashes[order])
            item.append(np.repeat(np.arange(len(found)), counts)[order])
            place.append(np.concatenate([*(np.arange(n) for n in counts), np.zeros(0, int)]).astype(np.int64)[order])
            bitmap[all_hashes >> np.uint64(42)] = True
        return cls([i for i, _ in items], words, hashes, item, place, bitmap)

    def short_alignments(self, words: np.ndarray, min_words: int, similarity: float) -> set[tuple[int, int]]:
        """(item, shift) where an item of at most ``min_words`` words may lie.

        Such an item is cut into one block more than it may have unequal words, so that one block is whole; blocks are
        found by their first words, five at most.
        """
        if self.blocks is None:
            self.blocks = {}
            for item, own in enumerate(self.words):
                if not 0 < len(own) <= min_words:
                    continue
                parts = 1 + int((1 - similarity) * len(own) + 1e-9)
                cuts = [len(own) * k // parts for k in range(parts + 1)]
                for low, high in zip(cuts, cuts[1:]):
                    size = min(high - low, len(_MIX))
                    seed = int(seeds(own[low : low + size], tuple(range(size)), 0)[0])
                    self.blocks.setdefault(size, {}).setdefault(seed, []).append((item, low))
        found = set()
        for size, known in self.blocks.items():
            for at, seed in enumerate(seeds(words, tuple(range(size)), 0).tolist()):
                found.update((item, at - low) for item, low in known.get(seed, ()))
        return found

    def matches(self, words: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
        """(item, document start, item start, words, equal words): the best stretch of each alignment that is a leak."""
        alignments = self.short_alignments(words, min_words, similarity)
        for number, mask in enumerate(MASKS):
            own = seeds(words, mask, number)
            at = np.flatnonzero(self.bitmap[own >> np.uint64(42)])
            if not len(at):
                continue
            low = np.searchsorted(self.hashes[number], own[at], "left")
            high = np.searchsorted(self.hashes[number], own[at], "right")
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                for k in range(a, b):
                    alignments.add((int(self.item[number][k]), p - int(self.place[number][k])))
        out = []
        for item, shift in sorted(alignments):
            theirs = self.words[item]
            first, last = max(0, -shift), min(len(theirs), len(words) - shift)
            equal = theirs[first:last] == words[first + shift : last + shift]
            if len(theirs) <= min_words:
                # A short item is judged as a whole, also where its ends differ or lie outside of the document.
                start, end = 0, len(equal) if equal.sum() >= similarity * len(theirs) - 1e-9 else 0
            else:
                start, end = longest_stretch(equal, similarity)
                end = end if end - start >= min_words else start
            if end > start:
                out.append((item, first + start + shift, first + start, end - start, int(equal[start:end].sum())))
        return out


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[SeedTable]:
    """Seed tables of the items (item_id, text), one bounded block at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = items.where(block == b).toArrow()
        yield SeedTable.build(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())))


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_equal: the longest leak of each document and item."""
    spark, out = docs.sparkSession, None
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    ddl = f"doc_id bigint, item_id {item_type}, doc_start int, item_start int, n_words int, n_equal int"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, table = WordHasher(), shared.value
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    best: dict[int, tuple] = {}
                    for item, *span in table.matches(hasher.words(text.as_py()), min_words, similarity):
                        best[item] = max(best.get(item, ()), (span[2], span[3], -span[0], -span[1]))
                    found += [(doc_id, table.items[i], -p, -q, n, m) for i, (n, m, p, q) in best.items()]
                if found:
                    types = (pa.int64(), None, *[pa.int32()] * 4)
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    yield pa.record_batch(columns, names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

        return find

    for table in benchmark_blocks(benchmark, block_words):
        part = rows.mapInArrow(finder(spark.sparkContext.broadcast(table)), ddl)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no leak. One pass per block of the benchmark, no shuffle."""
    spark, out = docs.sparkSession, docs

    def cleaner(shared):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, table = WordHasher(), shared.value
            for batch in batches:
                keep = [not table.matches(hasher.words(t.as_py()), min_words, similarity) for t in batch.column(0)]
                yield batch.filter(pa.array(keep, pa.bool_())).select([1])

        return clean

    for table in benchmark_blocks(benchmark, block_words):
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = out.select(F.col("text").cast("string").alias("whole"), row)
        kept = rows.mapInArrow(cleaner(spark.sparkContext.broadcast(table)), f"row {rows.schema['row'].dataType.simpleString()}")
        out = kept.select("row.*")
    return out
