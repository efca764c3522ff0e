"""Text to vector: a frozen user model in Arrow batches, a built-in hashed embedder, and a store of known vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from reviewlab.functions.text import cap_tokens, split_tokens
from reviewlab.operators.joins import lookup_join
from reviewlab.operators.sampling import in_run


def pool(states: np.ndarray, how: str = "first") -> np.ndarray:
    """Reduce (rows, positions, width) token states to one vector per row: the first position or the mean."""
    if how == "first":
        return states[:, 0, :]
    if how == "mean":
        return states.mean(axis=1)
    raise ValueError(f"pool must be 'first' or 'mean', not {how!r}")


@dataclass(frozen=True)
class ModelEmbedder:
    """A frozen model that the user supplies.

    ``load`` runs once per Python worker and returns a function from an array of texts to a float array, either
    (rows, width) or (rows, positions, width); the latter is pooled. Whole texts are passed unless ``max_tokens`` words
    are asked for. A null text has a null vector.
    """

    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    batch_size: int = 64
    max_tokens: int | None = None
    pool: str = "first"

    def transform(self, df: DataFrame, col: str = "review", into: str = "embedding") -> DataFrame:
        load, how = self.load, self.pool

        def make() -> Callable[[np.ndarray], np.ndarray]:
            model = load()

            def predict(texts: np.ndarray) -> np.ndarray:
                states = np.asarray(model(texts), dtype="float32")
                return pool(states, how) if states.ndim == 3 else states

            return predict

        encode = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=self.batch_size)
        text = F.col(col)
        if self.max_tokens is not None:
            text = F.array_join(cap_tokens(text, self.max_tokens), " ")
        vector = encode(F.coalesce(text, F.lit("")))
        return df.withColumn(into, F.when(F.col(col).isNotNull(), vector))


@dataclass(frozen=True)
class HashedTfEmbedder:
    """Hashed term frequencies of all words of a text, optionally idf-weighted and scaled to length 1.

    Needs no model file. A word's bucket comes from its md5, which other engines have too. Without ``idf`` the embedder
    is as stateless as a frozen encoder; ``fit`` returns a copy with idf weights, ln((n + 1) / (df + 1)), learned from
    the given (training) rows only. A null text has a null vector. ``max_tokens`` keeps the first words only.
    """

    width: int = 256
    max_tokens: int | None = None
    normalise: bool = True
    idf: tuple[float, ...] | None = None
    precision: str = "float"

    def _buckets(self, col: str) -> Column:
        words = cap_tokens(F.col(col), self.max_tokens) if self.max_tokens else split_tokens(F.col(col))
        number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int")
        return F.transform(words, lambda w: F.pmod(number(w), F.lit(self.width)))

    def fit(self, df: DataFrame, col: str = "review") -> HashedTfEmbedder:
        """Document counts per bucket: at most ``width`` rows reach the driver."""
        return self.fit_runs(df.withColumn("_all", F.lit(1).cast("bigint")), "_all", 1, col)[0]

    def fit_runs(self, df: DataFrame, mask: str, runs: int, col: str = "review") -> list[HashedTfEmbedder]:
        """One embedder per run, from the rows whose ``mask`` has the run's bit: the texts are read and hashed once.

        Document counts of all buckets and runs come from one aggregate; the last row, of bucket -1, has the numbers of rows.
        """
        known = df.where(F.col(col).isNotNull()).select(F.array_append(F.array_distinct(self._buckets(col)), F.lit(-1)).alias("b"), mask)
        per_run = [F.count_if(in_run(mask, run)).alias(f"run_{run}") for run in range(runs)]
        counts = {r["bucket"]: r for r in known.select(F.explode("b").alias("bucket"), mask).groupBy("bucket").agg(*per_run).collect()}

        def idf(run: int) -> tuple[float, ...]:
            n = counts[-1][f"run_{run}"] if -1 in counts else 0
            seen = [counts[b][f"run_{run}"] if b in counts else 0 for b in range(self.width)]
            return tuple(math.log((n + 1) / (df + 1)) for df in seen)

        return [replace(self, idf=idf(run)) for run in range(runs)]

    def _scaled(self, counts: np.ndarray) -> np.ndarray:
        """Vectors [row, bucket] of word counts."""
        vectors = counts * np.array(self.idf or [1.0] * self.width)
        if self.normalise:
            lengths = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
            vectors = np.divide(vectors, lengths, out=vectors, where=lengths > 0)
        return vectors.astype({"float": "float32", "double": "float64"}[self.precision])

    def transform(self, df: DataFrame, col: str = "review", into: str = "embedding") -> DataFrame:
        embedder = self

        @F.arrow_udf(f"array<{self.precision}>")
        def vector(buckets: pa.Array) -> pa.Array:
            return _lists(embedder._scaled(_counts(buckets, embedder.width)), buckets)

        return df.withColumn(into, vector(self._buckets(col)))


def transform_runs(df: DataFrame, embedders: Sequence[HashedTfEmbedder], col: str = "review", into: str = "embeddings") -> DataFrame:
    """Add the vectors of ``col`` under each of several embedders of one kind, as an array: the texts are hashed once."""
    first = embedders[0]

    @F.arrow_udf(f"array<array<{first.precision}>>")
    def vectors(buckets: pa.Array) -> pa.Array:
        counts = _counts(buckets, first.width)
        found = np.empty((len(buckets), len(embedders), first.width), {"float": "float32", "double": "float64"}[first.precision])
        for place, embedder in enumerate(embedders):
            found[:, place] = embedder._scaled(counts)
        return _lists(found, buckets)

    return df.withColumn(into, vectors(first._buckets(col)))


def _counts(buckets: pa.Array, width: int) -> np.ndarray:
    """[row, bucket]: how often each bucket occurs, for all rows of a batch at once; a null row has none."""
    lengths = pc.list_value_length(buckets).fill_null(0).to_numpy(zero_copy_only=False)
    row, flat = np.repeat(np.arange(len(buckets)), lengths), buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.bincount(row * width + flat, minlength=len(buckets) * width).reshape(len(buckets), width).astype(np.float64)


def _lists(found: np.ndarray, like: pa.Array) -> pa.Array:
    """An array of any number of axes as nested lists over its own numbers, null where ``like`` is."""
    lists = pa.array(found.ravel())
    for axis in range(found.ndim - 1, 0, -1):
        n, size = int(np.prod(found.shape[:axis])), found.shape[axis]
        mask = like.is_null() if axis == 1 and like.null_count else None
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), lists, mask=mask)
    return lists


def embed(df: DataFrame, embedder, col: str = "review", into: str = "embedding") -> DataFrame:
    """Add the vector of ``col`` to every row."""
    return embedder.transform(df, col, into)


def content_key(col: str = "review"):
    return F.sha2(F.col(col), 256)


def distinct_texts(df: DataFrame, col: str = "review", id_col: str = "row_id") -> DataFrame:
    """Each text that is not null once, under its content key: the copy of the least id.

    Keys and ids are aggregated by hash; texts are not aggregated but fetched for the ids that were found.
    """
    keyed = df.where(F.col(col).isNotNull()).select(content_key(col).alias("content_key"), F.col(id_col).alias("_id"), col)
    first = keyed.groupBy("content_key").agg(F.min("_id").alias("_id"))
    return keyed.join(first, ["content_key", "_id"], "left_semi").select("content_key", col)


def missing_texts(df: DataFrame, store: DataFrame | None, col: str = "review", id_col: str = "row_id") -> DataFrame:
    """Distinct texts whose vector the store does not have."""
    texts = distinct_texts(df, col, id_col)
    return texts if store is None else texts.join(store.select("content_key"), "content_key", "left_anti")


def embed_cached(
    df: DataFrame, embedder, path: str, name: str, col: str = "review", into: str = "embedding", id_col: str = "row_id"
) -> DataFrame:
    """Add vectors through a Parquet store of (content_key, embedding): new texts are embedded once and appended.

    ``name`` identifies the embedder and its settings; every name has a store of its own under ``path``. All runs,
    protocols and model kinds read the same vectors instead of encoding a text again for each.
    """
    spark, place = df.sparkSession, f"{path}/{name}"
    new = embed(missing_texts(df, read_store(df, place), col, id_col), embedder, col, into)
    new.select("content_key", into).write.mode("append").parquet(place)
    return lookup_embeddings(df, read_store(df, place), col)


def read_store(df: DataFrame, path: str) -> DataFrame | None:
    """The vectors at ``path``, one per key however often a retried or parallel run appended it; None if there are none."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path).dropDuplicates(["content_key"]) if system.exists(folder) else None


def lookup_embeddings(df: DataFrame, store: DataFrame, col: str = "review") -> DataFrame:
    """Attach stored vectors by content; a row whose text is null or not stored keeps a null vector."""
    return lookup_join(df.withColumn("content_key", content_key(col)), store, "content_key")
