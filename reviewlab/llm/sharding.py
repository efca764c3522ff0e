"""Sharding by rendezvous hashing: every (record key, shard) pair draws a number and the highest draw wins.

A shard's draw does not depend on the other shards, so a further shard takes records only into itself, and a removed
one gives its records to the others in proportion to their weights. Column expressions only.

Defined results: a null id is one key like any other; rows that repeat an id share its shard and take slots of their
own; a null text has no bytes and the checksum of the empty text; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import keyed
from reviewlab.session import durable

ROW_OVERHEAD = 16
BLOCK_ROWS = 250_000
"""Rows of one shard that are numbered in one group; a shard of any size is dealt over as many groups as it takes."""


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """-weight / ln(u) with u uniform in (0, 1) from the hash of key and shard: the weighted rendezvous score."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(float(2**53)))


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Struct (draw, neg) of the winning shard; ``neg`` is minus the shard, so equal draws go to the lower number."""
    draws = [
        F.struct(draw(key, first + i, w).alias("draw"), F.lit(-(first + i)).alias("neg")) for i, w in enumerate(weights)
    ]
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def number_in_shard(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``slot``: 0, 1, ... without gaps in every shard.

    Each shard is cut into blocks by the key's hash; rows are numbered inside their block and a prefix sum over the
    block sizes (one row per block) lifts the numbers, so no task holds a whole shard. ``rows`` must be a stored table,
    as it is read twice.
    """
    shards = F.greatest(F.approx_count_distinct("shard"), F.lit(1))
    blocks = int(rows.select(F.ceil(F.count(F.lit(1)) / (shards * block_rows)).alias("n")).first()["n"] or 1)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "block"]).withColumn("slot", F.col("start") + F.col("at"))


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``grown_shard`` is the shard once one more, of the mean weight, has joined.
    """
    key, count = F.col("doc_id"), len(weights)
    text = F.coalesce(F.col("text"), F.lit(""))
    best = keyed(docs).select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("best"),
        draw(key, count, sum(weights) / count).alias("newcomer"),
    )
    rows = best.select(
        "doc_id",
        "size",
        "text_crc32",
        (-F.col("best.neg")).cast("int").alias("shard"),
        F.when(F.col("newcomer") > F.col("best.draw"), F.lit(count)).otherwise(-F.col("best.neg")).cast("int").alias("grown_shard"),
    )
    return number_in_shard(durable(rows)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint"), "grown_shard"
    )
