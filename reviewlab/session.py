"""Session set-up and the two ways a plan may be cut: small control tables and durable written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL_ROWS = 100_000
"""Most rows a control table (class counts, cut points, class lists) may have to be held by the driver."""


LOCAL_FOLDER = "reviewlab.local.folder"


def get_session(app: str = "reviewlab", master: str | None = None, **conf: object) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where cut plans are written: the folder that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder, removed at exit, stands in only when that is unset and the session runs in local mode.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get(LOCAL_FOLDER, None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="reviewlab-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(LOCAL_FOLDER, folder)
    return folder


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as each ends, not when the driver's collector finds them; restored after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def durable(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    Unlike a checkpointed RDD the table keeps column pruning, filter pushdown and, with ``partition_by``, partition
    pruning for everything that reads it. What was shuffled for the written table is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/reviewlab-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def remove(table: DataFrame) -> None:
    """Delete a table of ``durable`` (without ``partition_by``) that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def control_rows(df: DataFrame, max_rows: int = CONTROL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """Evaluate a small result once; return it as a frame that is safe to broadcast, and its rows.

    At most ``max_rows + 1`` rows reach the driver. Within the bound the rows become a local relation with a
    broadcast hint; beyond it the result is written out instead (rows: None) and later joins on it shuffle as
    usual, so no row is lost either way.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return durable(df), None
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema)), head


def control_table(df: DataFrame, max_rows: int = CONTROL_ROWS) -> DataFrame:
    """The frame of ``control_rows``."""
    return control_rows(df, max_rows)[0]
