"""Exact k-means with ns-bounds: bounds are loosened by the norm of a centroid's total displacement.

Vectors become integers floor(scale * x); centroids are integers too, so distances, sums and ties are exact. A row carries
its cluster, an upper bound for the distance to it and a lower bound for every other centroid, each with the round in which
it was last evaluated. The history of all centroids is kept (rounds x k vectors). A bound of round s is loosened in round t
by |c(t) - c(s)|, the norm of the whole displacement since then, which is at most the sum of the moves of each round that is
used otherwise. Only where a loosened lower bound does not exceed the upper one the distances are evaluated anew, in
integers; bounds are rounded away from the truth, so a skipped centroid is certain to be farther away.

A round is one pass without a shuffle: it reads the rows of the last round and writes them with new bounds, and beside them,
in a folder of their own, what each task adds to the sums of each centroid: the vectors that came less those that left.
These few rows are summed by Spark; k sums reach the driver. The rows of the round before are then deleted, so that two
copies exist at most. Every round starts from a written table.

Defined results: vectors that are null, have another length, or a null, NaN or infinite component are left out; components
beyond +-2^27 after scaling count as that, so that a squared distance fits a long; sums beyond a long are returned as the
greatest long; rows that repeat an id are vectors of their own; vectors without an id become a first centroid only after
those with one, and equal hashes are ordered by their components; with fewer than k vectors there are as many centroids as
vectors; an empty table gives no rows; columns besides ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import arrow_rows
from reviewlab.session import durable

LARGEST = 1 << 27
LONGEST = (1 << 63) - 1
BATCH_ROWS = 4096
SLACK = 1e-9
"""Relative and absolute margin of bounds against rounding; the values are square roots of integers below 2^62."""

ROWS = (
    "kind int, vec_id bigint, embedding array<{x}>, cluster int, upper double, upper_round int, lower array<float>, "
    "lower_round array<int>, distance bigint, evaluated bigint, n bigint, sums array<bigint>"
)
"""A vector with its bounds, or what a task adds to a centroid: each kind uses some of the columns."""
VECTOR, SUM = 0, 1


def kept_vectors(table: DataFrame, components: int) -> DataFrame:
    """vec_id, embedding: the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = (F.size("embedding") == components) & F.coalesce(finite, F.lit(False))
    exact = "array<float>" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "array<double>"
    return table.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(exact).alias("embedding"))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def first_centroids(kept: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    head = kept.orderBy(F.asc_nulls_last(digest), "embedding").limit(k).select("embedding").collect()
    return quantised(np.array([r.embedding for r in head], np.float64), scale)


@dataclass(frozen=True)
class History:
    """The centroids of every round so far; the last are those to assign to."""

    rounds: list[np.ndarray]

    def displacement(self) -> np.ndarray:
        """[round, centroid]: upper estimate of the distance of today's centroid to its place in that round."""
        now = self.rounds[-1].astype(np.float64)
        moved = np.stack([np.sqrt(((now - c.astype(np.float64)) ** 2).sum(axis=1)) for c in self.rounds])
        return np.where(moved > 0, moved * (1 + SLACK) + SLACK, 0)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the one centroid, or to its own of as many centroids."""
    gap = points - centroids
    return np.einsum("ij,ij->i", gap, gap)


def reassign(points: np.ndarray, state: tuple, history: History) -> int:
    """Bring cluster, upper, upper_round, lower, lower_round (changed in place) up to date; how many distances it took."""
    cluster, upper, upper_round, lower, lower_round = state
    today, centroids, moved = len(history.rounds) - 1, history.rounds[-1], history.displacement()
    k, every = len(centroids), np.arange(len(points))
    bound = lower - moved[lower_round, np.arange(k)]
    bound[every, cluster] = np.inf
    loose = upper + moved[upper_round, cluster]
    failed = np.flatnonzero(bound.min(axis=1, initial=np.inf) <= loose * (1 + SLACK) + SLACK)
    # The own distance is made exact; what still fails is evaluated centroid by centroid.
    own = squared(points[failed], centroids[cluster[failed]])
    tight = np.sqrt(own.astype(np.float64))
    upper[failed], upper_round[failed] = tight * (1 + SLACK), today
    need = bound[failed] <= (tight * (1 + SLACK) + SLACK)[:, None]
    best, best_at, count = own.copy(), cluster[failed].copy(), len(failed)
    before, before_own = cluster[failed].copy(), own
    for j in range(k):
        rows = np.flatnonzero(need[:, j])
        count += len(rows)
        found = squared(points[failed[rows]], centroids[j])
        lower[failed[rows], j] = np.sqrt(found.astype(np.float64)) * (1 - SLACK)
        lower_round[failed[rows], j] = today
        nearer = (found < best[rows]) | ((found == best[rows]) & (j < best_at[rows]))
        best[rows[nearer]], best_at[rows[nearer]] = found[nearer], j
    # The centroid that was left gets its exact distance as a lower bound.
    lower[failed, before], lower_round[failed, before] = np.sqrt(before_own.astype(np.float64)) * (1 - SLACK), today
    cluster[failed], upper[failed] = best_at, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return count


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), kind))


def _schema(x: pa.DataType) -> pa.Schema:
    longs, floats, ints = pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int32())
    return pa.schema(
        [
            ("kind", pa.int32()), ("vec_id", pa.int64()), ("embedding", pa.list_(x)), ("cluster", pa.int32()),
            ("upper", pa.float64()), ("upper_round", pa.int32()), ("lower", floats), ("lower_round", ints),
            ("distance", pa.int64()), ("evaluated", pa.int64()), ("n", pa.int64()), ("sums", longs),
        ]
    )


def _batch(columns: dict, size: int, kind: int, schema: pa.Schema) -> pa.RecordBatch:
    columns["kind"] = pa.array([kind] * size, pa.int32())
    return pa.record_batch(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
    )


def _state(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, tuple]:
    """The clusters so far (-1: none) and what ``reassign`` brings up to date. Without bounds every test fails."""
    size = batch.num_rows
    if "cluster" not in batch.schema.names:
        unknown = (np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size, np.int64), np.zeros((size, k)), np.zeros((size, k), np.int64))
        return np.full(size, -1), unknown
    was, upper, upper_round = (batch.column(c).to_numpy() for c in ("cluster", "upper", "upper_round"))
    lower, lower_round = _matrix(batch.column("lower"), k), _matrix(batch.column("lower_round"), k)
    was = was.astype(np.int64)
    return was, (was.copy(), upper.copy(), upper_round.astype(np.int64), lower.astype(np.float64), lower_round.astype(np.int64))


def one_round(rows: DataFrame, history: History, scale: int, last: bool) -> DataFrame:
    """A written table of the rows with their new clusters and, as the other kind, of what each task adds to the sums.

    ``last`` also gives every row its exact distance; the sums then carry the distances of each cluster.
    """
    k, width = history.rounds[-1].shape
    x = rows.schema["embedding"].dataType.elementType.simpleString()
    schema = _schema(pa.float32() if x == "float" else pa.float64())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, evaluated, inertia = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0, [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            points = quantised(_matrix(batch.column("embedding"), width), scale)
            was, state = _state(batch, k)
            evaluated += reassign(points, state, history)
            cluster, upper, upper_round, lower, lower_round = state
            moved = np.flatnonzero(was != cluster)
            left = moved[was[moved] >= 0]
            for sign, at, of in ((1, moved, cluster), (-1, left, was)):
                np.add.at(n, of[at], sign)
                np.add.at(sums, of[at], sign * points[at])
            columns = {
                "vec_id": batch.column("vec_id"),
                "embedding": batch.column("embedding"),
                "cluster": pa.array(cluster),
                "upper": pa.array(upper),
                "upper_round": pa.array(upper_round),
                "lower": _lists(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), pa.float32()),
                "lower_round": _lists(lower_round.astype(np.int32), pa.int32()),
            }
            if last:
                distance = squared(points, history.rounds[-1][cluster])
                columns["distance"] = pa.array(distance)
                for j in range(k):
                    inertia[j] += sum(distance[cluster == j].tolist())
            yield _batch(columns, batch.num_rows, VECTOR, schema)
        added = {
            "cluster": pa.array(range(k)),
            "n": pa.array(n),
            "sums": _lists(sums, pa.int64()),
            "distance": pa.array([min(LONGEST, v) for v in inertia]),
            "evaluated": pa.array([evaluated] + [0] * (k - 1)),
        }
        yield _batch(added, k, SUM, schema)

    with arrow_rows(rows.sparkSession, BATCH_ROWS):
        return durable(rows.mapInArrow(assign, ROWS.format(x=x)), ["kind"])


def _remove(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent().getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Clustering:
    """``rows``: vec_id, cluster, distance. Centroids, inertia of each cluster, and the distances that each pass evaluated."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    evaluated: list[int]


def cluster_vectors(table: DataFrame, k: int, rounds: int, components: int, scale: int = 1024, seed: int = 0) -> Clustering:
    """``rounds`` rounds of assignment and update, then a last assignment. Rounds after a fixed point change nothing and are left out."""
    kept = kept_vectors(table, components)
    start = first_centroids(kept, k, scale, seed)
    if not len(start):
        return Clustering(kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), [], [], [])
    k, history = len(start), History([start])
    n, sums = [0] * k, [[0] * components for _ in range(k)]
    evaluated, rows, at = [], kept, 0
    while True:
        last = at == rounds
        written = one_round(rows, history, scale, last)
        if at:
            _remove(rows)
        rows, added = written.where(F.col("kind") == VECTOR), written.where(F.col("kind") == SUM)
        listed = F.concat(F.array("n", "evaluated", "distance"), F.col("sums"))
        spread = added.select("cluster", F.posexplode(listed).alias("place", "value"))
        totals = spread.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        total = {(r.cluster, r.place): int(r.value) for r in totals}
        evaluated.append(sum(total[j, 1] for j in range(k)))
        if last:
            inertia = [min(LONGEST, total[j, 2]) for j in range(k)]
            break
        for j in range(k):
            n[j] += total[j, 0]
            sums[j] = [v + total[j, i + 3] for i, v in enumerate(sums[j])]
        moved = [[v // n[j] for v in sums[j]] if n[j] else history.rounds[-1][j].tolist() for j in range(k)]
        history.rounds.append(np.array(moved, np.int64))
        at = at + 1 if (history.rounds[-1] != history.rounds[-2]).any() else rounds
    final = history.rounds[-1].tolist()
    return Clustering(rows.select("vec_id", "cluster", "distance"), final, inertia, evaluated)


def clustered(table: DataFrame, k: int, rounds: int, components: int, scale: int = 1024, seed: int = 0) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found = cluster_vectors(table, k, rounds, components, scale, seed)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    per_cluster = F.array(*[F.struct(F.lit(i).cast("bigint").alias("inertia"), F.lit(d).alias("sha")) for i, d in zip(found.inertia, digests)])
    if not digests:
        per_cluster = F.lit(None).cast("array<struct<inertia:bigint,sha:string>>")
    own = F.get(per_cluster, F.col("cluster"))
    return found.rows.select(
        "vec_id",
        "cluster",
        "distance",
        own["inertia"].alias("cluster_inertia"),
        F.lit(min(LONGEST, sum(found.inertia))).cast("bigint").alias("inertia"),
        own["sha"].alias("centroid_sha256"),
    )
