"""What the corpus operators share: their input columns, word splitting and batched output."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id`` (bigint), ``text`` and the named columns, so that other columns cannot clash with an operator's."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fold(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; an absent id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs run inside, which bounds what a task holds of long texts; restored after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text; null and empty texts share theirs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("second"), whole).alias("b"))


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def release_memory() -> None:
    """Give freed Arrow memory back at the end of a task: Python workers live on and other stages follow in them."""
    pa.default_memory_pool().release_unused()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
