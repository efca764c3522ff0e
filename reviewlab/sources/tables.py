"""Review tables: delimited files, registries of several files, and the adapters of the shared test tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REVIEW_SCHEMA = StructType([StructField("sentiment", StringType()), StructField("review", StringType())])

# The class names of the experiments.
NEGATIVE, NEUTRAL, POSITIVE = "Negatief", "Neutraal", "Positief"


class Source(NamedTuple):
    name: str
    path: str
    sep: str = ","


def read_reviews(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Read a two-column file; the header is skipped and the columns are named by position.

    Quotes are doubled inside quoted fields, which may span lines.
    """
    columns = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"').columns
    if len(columns) != 2:
        raise ValueError(f"{path}: expected two columns, found {len(columns)}")
    return spark.read.schema(REVIEW_SCHEMA).csv(
        path, sep=sep, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True
    )


def read_registry(spark: SparkSession, sources: Sequence[Source | tuple]) -> DataFrame:
    """All sources as one table with their name in ``dataset``."""
    frames = [read_reviews(spark, s.path, s.sep).withColumn("dataset", F.lit(s.name)) for s in map(lambda s: Source(*s), sources)]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def content_row_ids(rows: DataFrame) -> DataFrame:
    """Adds ``row_id`` from dataset, label and text, so that the same files give the same ids on any cluster.

    Exact copies of a row are counted before the shuffle and told apart by an ordinal that enters the hash.
    """
    columns = ["dataset", "sentiment", "review"]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return numbered.withColumn("row_id", F.xxhash64(*parts, "_copy")).select(*rows.columns, "row_id")


def ingest_registry(spark: SparkSession, sources: Sequence[Source | tuple], path: str, mode: str = "overwrite") -> DataFrame:
    """Write the registry as Parquet, partitioned by dataset, and read it back with a fixed ``row_id`` per row.

    The later passes then read just the columns they need. Dataset names come back as they were given.
    """
    numbered = content_row_ids(read_registry(spark, sources))
    numbered.write.mode(mode).partitionBy("dataset").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def reviews_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as reviews: one dataset per language, sentiment from the two label flags."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sentiment = (
        F.when(F.col("quality") == 0, NEGATIVE).when(F.col("toxic") == 1, NEUTRAL).otherwise(POSITIVE)
    )
    return documents.join(labels, "doc_id").select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").alias("row_id"),
        sentiment.alias("sentiment"),
        F.col("text").alias("review"),
    )


# Names for the four parts of the stored vectors, the first being the base.
VECTOR_SETS = ("base", "ext1", "ext2", "ext3")


def points_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors as labelled points: four datasets, two classes, and a third class in ``ext2`` only."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = F.array(*[F.lit(name) for name in VECTOR_SETS])
    dataset = F.get(names, (F.col("vec_id") % 4).cast("int"))
    third = (dataset == "ext2") & (F.col("label") >= 7)
    label = F.when(third, NEUTRAL).when(F.col("label") % 2 == 0, NEGATIVE).otherwise(POSITIVE)
    return vectors.select(
        dataset.alias("dataset"), F.col("vec_id").alias("row_id"), label.alias("label"), "embedding"
    )
