"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact join of the possible hits.

A list entry is a canonical host and a path prefix, written as one string such as ``example.net/en/``, with a verdict. It
fits its host and all subdomains where the path of the URL starts with its path. So a URL is looked up under the
expressions (last labels of its host, first code points of its path), but only in the shapes (number of labels, length of
path) that occur in the list; their number follows from the lengths of URLs, not from the length of the list.

Expressions are hashed by the JVM and tested in Arrow batches against a filter of 256-bit blocks, one block read a key. The
filter has at most ``max_filter_bytes``: a longer list makes it denser and lets more false hits pass, never fewer true ones.
Rows without a possible hit are done and are never shuffled. The others are written with a row number, their expressions
are joined with the list by text, and the longest listed expression of a row decides (its host part, if two are as long).
A list of up to ``CONTROL_ROWS`` entries is broadcast in that join, a longer one is shuffled, where a hot entry's pages are
split by adaptive execution.

Defined results: a null URL or one without ``://`` has an empty host and path; a path is not completed, so ``http://a.net``
(empty path) does not fit ``a.net/``; entries are lower-cased in A-Z up to their first ``/``; null entries and entries
without a host fit nothing; an entry listed twice blocks if one of the two says block, and so does any verdict but
``allow``; an empty list gives every row the other verdict; repeated and null ids are rows like any other; an empty table
gives no rows; columns besides ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.session import control_rows, durable

MAX_FILTER_BYTES = 32 << 20
BITS_PER_KEY = 16
BLOCK_WORDS = 4
WORDS = [f"word_{i}" for i in range(BLOCK_WORDS)]


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def url_list(entries: DataFrame) -> DataFrame:
    """rule, verdict, labels, chars: the canonical entries of (rule, verdict), one row each, with their shape."""
    host = _lower(F.substring_index("rule", "/", 1))
    path = F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))
    split = entries.select(host.alias("host"), path.alias("path"), (F.col("verdict") == "allow").alias("allowed"))
    listed = split.where(F.length("host") > 0).groupBy("host", "path").agg(F.bool_and(F.coalesce("allowed", F.lit(False))).alias("allowed"))
    return listed.select(
        F.concat("host", "path").alias("rule"),
        F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("chars"),
    )


def _bits(hashed: Column) -> list[tuple[int, Column]]:
    """The word of the block and the bit in it, eight times: two bits a word from the upper 48 bits of a second hash."""
    second = F.xxhash64(hashed)
    return [(i % BLOCK_WORDS, F.shiftrightunsigned(second, 16 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(2 * BLOCK_WORDS)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> np.ndarray:
    """The filter as ``n_blocks`` rows of four 64-bit words, built by the executors; only its blocks reach the driver."""
    hashed = listed.select(F.xxhash64("rule").alias("h"))
    one = F.lit(1).cast("bigint")
    masks = [
        reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, bit) for word, bit in _bits(F.col("h")) if word == at]).alias(name)
        for at, name in enumerate(WORDS)
    ]
    blocks = hashed.select(F.pmod("h", F.lit(n_blocks)).cast("int").alias("block"), *masks)
    filled = blocks.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS]).toArrow()
    words = np.zeros((n_blocks, BLOCK_WORDS), np.uint64)
    at = filled.column("block").to_numpy()
    for i, w in enumerate(WORDS):
        words[at, i] = filled.column(w).to_numpy().view(np.uint64)
    return words


def may_contain(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether all eight bits of each key are set in its block."""
    block = words[np.mod(first, len(words))]
    found = np.ones(len(first), bool)
    for i in range(2 * BLOCK_WORDS):
        bit = second.view(np.uint64) >> np.uint64(16 + 6 * i) & np.uint64(63)
        found &= (block[:, i % BLOCK_WORDS] >> bit & np.uint64(1)).astype(bool)
    return found


def possible_hits(pages: DataFrame, listed: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, hits: the expressions of each page that the filter lets pass."""
    spark = pages.sparkSession
    shapes = [(r.labels, r.chars) for r in listed.select("labels", "chars").distinct().orderBy("labels", "chars").collect()]
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return rows.withColumn("hits", F.array().cast("array<string>"))
    n_blocks = min(max(1, max_filter_bytes // (8 * BLOCK_WORDS)), 1 + listed.count() * BITS_PER_KEY // (64 * BLOCK_WORDS))
    shared = spark.sparkContext.broadcast(bloom_blocks(listed, n_blocks))

    labels, chars = F.size(F.split("host", r"\.")), F.length("path")
    known = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
    fitting = F.filter(known, lambda s: (F.length("host") > 0) & (s["labels"] <= labels) & (s["chars"] <= chars))
    looked_up = F.transform(
        fitting,
        lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["chars"])),
    )
    rows = rows.withColumn("tried", looked_up).withColumn("first", F.transform("tried", lambda e: F.xxhash64(e)))
    rows = rows.withColumn("second", F.transform("first", lambda h: F.xxhash64(h)))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            tried, first, second = (batch.column(c) for c in ("tried", "first", "second"))
            found = may_contain(words, first.flatten().to_numpy(), second.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(found)])[tried.offsets.to_numpy() - tried.offsets[0].as_py()]
            hits = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tried.flatten().filter(pa.array(found)))
            yield pa.record_batch([batch.column(c) for c in ("page_id", "host", "path")] + [hits], ["page_id", "host", "path", "hits"])

    return rows.mapInArrow(test, "page_id bigint, host string, path string, hits array<string>")


def judge_urls(
    pages: DataFrame, entries: DataFrame, unlisted: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict, for every row of ``pages``; ``unlisted`` is the other verdict."""
    listed, _ = control_rows(url_list(entries))
    tested = durable(possible_hits(pages, listed, max_filter_bytes).withColumn("row", F.monotonically_increasing_id()))
    none = F.lit(None).cast("string").alias("rule")
    misses = tested.where(F.size("hits") == 0).select("page_id", "host", "path", none, F.lit(unlisted).alias("verdict"))
    asked = tested.where(F.size("hits") > 0).select("row", "page_id", "host", "path", F.explode("hits").alias("rule"))
    answer = asked.join(listed, "rule", "left").select(
        "row",
        "page_id",
        "host",
        "path",
        F.when(
            F.col("verdict").isNotNull(),
            F.struct(F.length("rule").alias("length"), F.length(F.substring_index("rule", "/", 1)).alias("host_length"), "rule", "verdict"),
        ).alias("fit"),
    )
    best = answer.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max("fit").alias("fit"))
    hits = best.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", F.lit(unlisted)).alias("verdict"))
    return misses.unionByName(hits)


def rule_table(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rules.items()), "rule string, verdict string")
