"""Exact k-nearest-neighbour join for many runs at once.

Distances do not depend on the run, so each pair of blocks is multiplied once and every run only masks it: rows
carry ``train_mask`` / ``test_mask`` bits instead of being repeated per run. Rows are hashed into blocks of bounded
size; a block of test rows meets every block of training rows of its set in a task of its own and only the k best
candidates per test row leave that task. No pair of rows is ever a row of a DataFrame.

Exact copies do not make a hot block: of identical training vectors only the k smallest ids per run can be
neighbours (ties go to the smaller id), and identical test vectors share one answer. When copies are common both
sides are collapsed before the block join and the answers are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from reviewlab.functions.scores import argmax_label
from reviewlab.operators.joins import lookup_join
from reviewlab.operators.sampling import in_run
from reviewlab.session import control_rows

BLOCK_BYTES = 32 << 20
"""Size of the vectors of one block. Large blocks mean few copies: a row travels once per block of the other side."""
TEST_ROWS = 32_768
"""Most test rows of a block: a task holds the answers of all of them, for every run."""
SMALL_BLOCK_ROWS = 2048
"""Test blocks may be as small as this to keep all cores busy."""
TILE_CELLS = 4_000_000
"""Most distances held at once; a task works through its test rows in tiles."""
STRIDE = 32
"""Distances of which the least stands for all where the place of a limit is looked for."""
SHARED_LIST = 6
"""Length of the candidate list that all runs share, in multiples of k."""
MAX_TASKS = 16_384

NEIGHBOR_SCHEMA = StructType(
    [
        StructField("model_set", StringType()),
        StructField("eval_set", StringType()),
        StructField("run", IntegerType()),
        StructField("row_id", LongType()),
        StructField("y", StringType()),
        StructField("neighbor_id", LongType()),
        StructField("label", StringType()),
        StructField("distance", DoubleType()),
        StructField("place", IntegerType()),
    ]
)
_NEIGHBOR_ARROW = pa.schema(
    [
        ("model_set", pa.string()),
        ("eval_set", pa.string()),
        ("run", pa.int32()),
        ("row_id", pa.int64()),
        ("y", pa.string()),
        ("neighbor_id", pa.int64()),
        ("label", pa.string()),
        ("distance", pa.float64()),
        ("place", pa.int32()),
    ]
)


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([chunk.flatten() for chunk in vectors.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype("float64").reshape(rows, -1)


def _limit(rough: np.ndarray, m: int) -> np.ndarray:
    """Per row a number that at least m values do not exceed, or infinity if there are no m; close to the m-th smallest.

    The m-th smallest among the least of every ``STRIDE`` values is one; only where that is not finite all are looked at.
    """
    rows, columns = rough.shape
    if m >= columns:
        return np.full(rows, np.inf)
    groups = columns // STRIDE
    if groups <= 2 * m:
        return np.partition(rough, m - 1, axis=1)[:, m - 1]
    least = rough[:, : groups * STRIDE].reshape(rows, STRIDE, groups).min(axis=1)
    limit = np.partition(least, m - 1, axis=1)[:, m - 1]
    for row in np.flatnonzero(~np.isfinite(limit)):
        limit[row] = np.partition(rough[row], m - 1)[m - 1]
    return limit


def _measure(
    test: np.ndarray, train: np.ndarray, ids: np.ndarray, rough: np.ndarray, margin: np.ndarray, m: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The m nearest (or more) training rows of each test row, and how far out that list is complete.

    ``rough`` holds squared distances up to ``margin``, infinite where a training row does not count; it picks the
    candidates and only those are measured exactly. Returns (test position, train position, squared distance) in
    order of distance and id, and per test row the squared distance up to which no training row is missing.
    """
    limit = _limit(rough, m)
    near = rough <= np.minimum(limit + 2 * margin, np.finfo("float64").max)[:, None]
    measured: list[tuple[np.ndarray, ...]] = []
    chunk = np.cumsum(near.sum(1) * test.shape[1]) // TILE_CELLS
    for part in np.unique(chunk):
        first, last = np.searchsorted(chunk, [part, part + 1])
        i, j = np.nonzero(near[first:last])
        i = i + first
        exact = ((test[i] - train[j]) ** 2).sum(1)
        order = np.lexsort((ids[j], exact, i))
        measured.append((i[order], j[order], exact[order]))
    i, j, exact = (np.concatenate(column) for column in zip(*measured))
    return i, j, exact, limit + margin


def _first(i: np.ndarray, j: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each test row of an ordered list, with their places."""
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], j[keep], exact[keep], place[keep] + 1


def _tile_neighbors(
    test: np.ndarray, test_mask: np.ndarray, train: np.ndarray, train_sq: np.ndarray, ids: np.ndarray, training: list, k: int
) -> list[tuple[np.ndarray, ...]]:
    """Neighbours of a tile of test rows in every run: (run, test position, train position, squared distance, place).

    One list of the nearest rows of any run serves all runs. Where it does not reach the k-th neighbour of a run for
    certain, that test row is searched again among the rows of that run alone.
    """
    test_sq = (test**2).sum(1)
    rough = test @ train.T
    rough *= -2
    rough += train_sq
    rough += test_sq[:, None]
    margin = 8 * (train.shape[1] + 8) * np.finfo("float64").eps * (test_sq + train_sq.max() + 1e-300)
    i, j, exact, reach = _measure(test, train, ids, rough, margin, min(len(train), SHARED_LIST * k))
    found = []
    for run, members in enumerate(training):
        wanted = ((test_mask >> run) & 1).astype(bool)
        enough = min(k, int(members.sum()))
        if not enough or not wanted.any():
            continue
        mine = wanted[i] & members[j]
        near = _first(i[mine], j[mine], exact[mine], enough)
        last = np.full(len(test), np.inf)
        ends = near[3] == enough
        last[near[0][ends]] = near[2][ends]
        sure = last <= reach if len(train) > SHARED_LIST * k else np.isfinite(last)
        keep = sure[near[0]]
        found.append((np.full(int(keep.sum()), run, "int32"), *[column[keep] for column in near]))
        again = np.flatnonzero(wanted & ~sure)
        if len(again):
            alone = np.where(members, rough[again], np.inf)
            rest = _first(*_measure(test[again], train, ids, alone, margin[again], enough)[:3], enough)
            found.append((np.full(len(rest[0]), run, "int32"), again[rest[0]], *rest[1:]))
    return found


def _block_join(k: int, runs: int):
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _NEIGHBOR_ARROW.empty_table()
        train, test = _matrix(left["embedding"], left.num_rows), _matrix(right["embedding"], right.num_rows)
        ids, train_mask = left["row_id"].to_numpy(), left["train_mask"].to_numpy()
        test_mask = right["test_mask"].to_numpy()
        train_sq = (train**2).sum(1)
        training = [((train_mask >> run) & 1).astype(bool) for run in range(runs)]
        found = []
        height = max(1, TILE_CELLS // len(train))
        for top in range(0, len(test), height):
            tile = slice(top, top + height)
            for run, i, *rest in _tile_neighbors(test[tile], test_mask[tile], train, train_sq, ids, training, k):
                found.append((run, i + top, *rest))
        if not found:
            return _NEIGHBOR_ARROW.empty_table()
        run, i, j, squared, place = (np.concatenate(column) for column in zip(*found))
        asked = right.select(["model_set", "eval_set", "row_id", "label"]).take(pa.array(i))
        given = left.select(["row_id", "label"]).take(pa.array(j))
        columns = {name: asked[name] for name in ("model_set", "eval_set", "row_id")}
        columns |= {"y": asked["label"], "run": run, "distance": np.sqrt(squared), "place": place.astype("int32")}
        columns |= {"neighbor_id": given["row_id"], "label": given["label"]}
        return pa.table({name: columns[name] for name in _NEIGHBOR_ARROW.names}, schema=_NEIGHBOR_ARROW)

    return join


def _largest(frame: DataFrame, rows: pa.Table | None, column: str) -> float:
    """The largest value of a control table's column, without a job when its rows are at hand."""
    if rows is None:
        return frame.agg(F.max(column)).first()[0] or 0
    return max(rows[column].to_pylist(), default=0)


def _blocks(df: DataFrame, mask: str, own: str, other: str, columns: Sequence[str]) -> DataFrame:
    """Hash rows into their own side's blocks and send each to every block of the other side.

    The aliases give both sides columns of their own, which a co-group of one source with itself needs.
    """
    own_count, other_count = F.col(f"{own}_count"), F.col(f"{other}_count")
    return (
        df.where(F.col(mask) != 0)
        .withColumn(own, F.pmod(F.xxhash64("row_id"), own_count).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), (other_count - 1).cast("int"))))
        .select(*[F.col(name).alias(name) for name in ("model_set", "train_block", "test_block", *columns)])
    )


def _first_of_copies(points: DataFrame, k: int, runs: int) -> DataFrame:
    """Clear every mask bit that an equal vector with a smaller id makes redundant.

    Window group limits prune to k rows per copy group on the map side, so a huge group stays small.
    """
    spread = points.select("model_set", "vector_key", "row_id", "train_mask", "test_mask").withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    )

    def kept(mask: str, top: int) -> DataFrame:
        order = Window.partitionBy("model_set", "vector_key", "run").orderBy("row_id")
        return (
            spread.where(in_run(mask, F.col("run")))
            .withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= top)
            .groupBy("model_set", "row_id")
            .agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias(mask))
        )

    kept_rows = kept("train_mask", k).join(kept("test_mask", 1), ["model_set", "row_id"], "full")
    return points.drop("train_mask", "test_mask").join(kept_rows, ["model_set", "row_id"]).fillna(
        0, ["train_mask", "test_mask"]
    )


def nearest_neighbors(
    points: DataFrame,
    k: int = 5,
    runs: int = 10,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest training rows of every test row, per model set and run, with ``place`` 1..k.

    ``block_rows`` overrides the block size that follows from ``BLOCK_BYTES``.

    ``points`` has model_set, eval_set, row_id (unique within a set), label, embedding, train_mask and test_mask.
    """
    points = points.select("model_set", "eval_set", "row_id", "label", "embedding", "train_mask", "test_mask")
    parts = [
        F.count_if(F.col("train_mask") != 0).alias("n_train"),
        F.count_if(F.col("test_mask") != 0).alias("n_test"),
        F.max(F.size("embedding")).alias("width"),
    ]
    key = F.concat_ws("-", F.xxhash64("embedding"), F.xxhash64(F.lit("second"), "embedding"))
    points = points.withColumn("vector_key", key)
    source = _first_of_copies(points, k, runs)
    sizes, known = control_rows(source.groupBy("model_set").agg(*parts))
    full = block_rows or max(SMALL_BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, int(_largest(sizes, known, "width")))))
    cores = points.sparkSession.sparkContext.defaultParallelism
    n_train, n_test, train_blocks = F.col("n_train"), F.col("n_test"), F.ceil(F.col("n_train") / full)
    busy = F.least(F.ceil(n_test / min(full, SMALL_BLOCK_ROWS)), F.ceil(2 * cores / train_blocks))
    test_blocks = F.greatest(F.ceil(n_test / min(full, TEST_ROWS)), busy)
    blocks, shape = control_rows(
        sizes.where((n_train > 0) & (n_test > 0)).select(
            "model_set", train_blocks.alias("train_block_count"), test_blocks.alias("test_block_count")
        )
    )
    cells = [t["train_block_count"] * t["test_block_count"] for t in shape.to_pylist()] if shape else [MAX_TASKS]
    tasks = max(1, min(sum(cells), MAX_TASKS))
    placed = source.join(blocks, "model_set")
    cell = ["model_set", "train_block", "test_block"]
    left = _blocks(placed, "train_mask", "train_block", "test_block", ["row_id", "label", "embedding", "train_mask"])
    right = _blocks(
        placed, "test_mask", "test_block", "train_block", ["eval_set", "row_id", "label", "embedding", "test_mask"]
    )
    found = (
        left.repartition(tasks, *cell)
        .groupBy(*cell)
        .cogroup(right.repartition(tasks, *cell).groupBy(*cell))
        .applyInArrow(_block_join(k, runs), NEIGHBOR_SCHEMA)
    )
    best = found
    if _largest(blocks, shape, "train_block_count") > 1:
        order = Window.partitionBy("model_set", "run", "row_id").orderBy("distance", "neighbor_id")
        best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    # Each answer belongs to the first of a group of equal test vectors; hand it to all of them.
    group = F.concat_ws(":", "vector_key", "model_set").alias("group")
    keyed = points.select("model_set", "row_id", group)
    near = ["run", "neighbor_id", "label", "distance", "place"]
    answers = (
        best.join(keyed, ["model_set", "row_id"]).groupBy("group").agg(F.collect_list(F.struct(*near)).alias("answers"))
    )
    asked = points.where(F.col("test_mask") != 0).select(
        "model_set", "eval_set", "row_id", F.col("label").alias("y"), "test_mask", group
    )
    return (
        lookup_join(asked, answers, "group")
        .withColumn("answer", F.explode("answers"))
        .where(in_run("test_mask", F.col("answer.run")))
        .select("model_set", "eval_set", "row_id", "y", *[F.col(f"answer.{name}").alias(name) for name in near])
        .select(*NEIGHBOR_SCHEMA.fieldNames())
    )


def class_shares(neighbors: DataFrame, classes: DataFrame, weights: str = "uniform") -> DataFrame:
    """Vote shares per class and the winner, for every test row of every run.

    ``weights='distance'`` votes by inverse distance; if any neighbour is at distance 0, only such neighbours vote.
    ``classes`` lists the sorted training labels per (model_set, run).
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"weights must be 'uniform' or 'distance', not {weights!r}")
    ballots = neighbors.groupBy("model_set", "eval_set", "run", "row_id", "y").agg(
        F.sort_array(F.collect_list(F.struct("place", "label", "distance"))).alias("ballots")
    )
    exact = F.exists("ballots", lambda b: b["distance"] == 0)

    def vote(ballot: Column) -> Column:
        if weights == "uniform":
            return F.lit(1.0)
        return F.when(exact, (ballot["distance"] == 0).cast("double")).otherwise(1 / ballot["distance"])

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda acc, b: acc + vote(b))

    shares = F.transform(
        "classes",
        lambda c: F.round(total(F.filter("ballots", lambda b: b["label"] == c)) / total(F.col("ballots")), 12),
    )
    return (
        ballots.join(classes, ["model_set", "run"])
        .withColumn("shares", shares)
        .withColumn("yhat", argmax_label(F.col("shares"), F.col("classes")))
        .drop("ballots")
    )
