"""Line dedup: lines that many documents share stay in one document only. Column expressions only.

Lines are reduced to 128-bit hashes of their keys. A pre-aggregated count finds the keys of enough documents and the
document that keeps each; the lines of those keys are range-partitioned by (hash, document, position), which deals a very
common line over many tasks. The order decides nothing: occurrences outside the keeper leave, row by row, as the aggregate
already knows it. What comes out per
document is not text but a sparse keep bitmap: 64 lines to a word, words without dropped lines left out.

Defined results: a null or empty text is one empty line; rows that repeat an id count as one document, each row with
a bitmap of its own text; a null id is one document that is never the one that keeps; lines under ``min_chars`` always
stay; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are passed through untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import keyed
from reviewlab.session import durable

BLANKS = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased. ``lower`` equals that on pure ASCII and is much faster."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row_key, pos: the lines that go."""
    at = keyed(docs).select("doc_id", _row_key(F.col("text")).alias("row_key"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    key = line_key(F.col("line"))
    long_lines = at.where(F.char_length("line") >= min_chars).select("doc_id", "row_key", "pos", key.alias("key"))
    lines = durable(
        long_lines.where(F.char_length("key") >= min_chars).select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "row_key", "pos"
        )
    )
    # Written out, so that the join below sees its size: broadcast if small, else a shuffle whose hot keys can be split.
    common = durable(
        lines.groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("one").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    shared = lines.join(common, ["h1", "h2"]).select("h1", "h2", "doc_id", "row_key", "pos", "keeper")
    streamed = shared.repartitionByRange("h1", "h2", F.desc("doc_id"), "pos").sortWithinPartitions(
        "h1", "h2", F.desc("doc_id"), "pos"
    )
    return streamed.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper"))).select("doc_id", "row_key", "pos")


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, row_key, gone: map from line number div 64 to the bits of the dropped lines among those 64."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("pos", F.lit(64)).cast("int"))
    words = dropped.groupBy("doc_id", "row_key", (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def with_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` as the struct ``row``, with ``gone``: its drop bitmap as one word per 64 lines, null if all lines stay."""
    maps = drop_bitmaps(dropped_lines(docs, min_chars, min_docs))
    maps = maps.select(F.col("doc_id").alias("map_id"), F.col("row_key").alias("map_key"), "gone")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("join_id"),
        _row_key(F.col("text")).alias("join_key"),
    )
    joined = rows.join(maps, rows.join_id.eqNullSafe(maps.map_id) & (rows.join_key == maps.map_key), "left")
    last = (F.size(text_lines(F.col("row.text"))) / 64).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at("gone", w), F.lit(0).cast("bigint")))
    return joined.select("row", F.when(F.col("gone").isNotNull(), dense).alias("gone"))


def kept_lines(lines: Column, gone: Column) -> Column:
    def stays(_, i):
        return F.getbit(F.get(gone, (i / 64).cast("int")), F.pmod(i, F.lit(64)).cast("int")) == 0

    return F.when(gone.isNull(), lines).otherwise(F.filter(lines, stays))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The columns of ``docs`` with the shared lines taken out of ``text``; null texts stay null."""
    marked = with_bitmaps(docs, min_chars, min_docs)
    kept = F.array_join(kept_lines(text_lines(F.col("row.text")), F.col("gone")), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return marked.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the drop bitmap ``gone_words`` (null: none)."""
    marked = with_bitmaps(keyed(docs), min_chars, min_docs)
    lines = text_lines(F.col("row.text"))
    cut = marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.array_join(kept_lines(lines, F.col("gone")), "\n").alias("kept"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda n, w: n + F.bit_count(w)), F.lit(0)).cast("bigint").alias("n_dropped"),
        "gone",
    )
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_lines", "n_dropped", digest, F.col("gone").alias("gone_words"))
