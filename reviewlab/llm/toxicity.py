"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and their first letters. One pass hashes the terms of every text; training and scoring read
these term lists, never the texts again. Class counts of all hashed terms over all training rows, summed in
Spark, pick the terms that tell the classes apart. On these the machine learns a weight and a factor vector per term,
so that pairs (an insult with a mention of a group) count beyond the sum of their weights. The fit takes a sample of at
most about ``max_fit_rows`` training rows, chosen by the hash of the id, which bounds the one task that fits; all rows
are scored.

Defined results: null and empty texts have no terms and get the model's bias; without training rows of both classes
every score is the share of class 1 (0 without any); rows that repeat an id are scored each; an empty table gives no
rows; columns besides ``doc_id`` and ``text`` (and ``label`` in training) are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import keyed

DRAW_BITS = 60
BUCKETS = 1 << 18
STEM = 5
CACHED_TOKENS = 500_000
NOT_LETTERS = re.compile(r"[\W\d_]+")


class TermHasher:
    """Buckets of a text's terms; tokens are hashed once per task."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHED_TOKENS:
            self.known.clear()
        known, out = self.known, set()
        for token in set((text or "").split()):
            found = known.get(token)
            if found is None:
                word = NOT_LETTERS.sub("", token.lower())
                terms = [word] * bool(word) + [f"{word[:STEM]}*"] * (len(word) > STEM)
                found = known[token] = tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)
            out.update(found)
        return np.array(sorted(out), np.int64)


@dataclass
class FactorizationMachine:
    """``index``: position of each bucket's term, -1 for those not chosen."""

    index: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of rows whose term positions are terms[ends[i-1]:ends[i]]."""
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        n, k = len(ends), self.factors.shape[1]
        linear = np.bincount(row, self.weights[terms], n)
        v = self.factors[terms]
        sums = np.stack([np.bincount(row, v[:, f], n) for f in range(k)], axis=1)
        squares = np.bincount(row, (v * v).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_machine(
    index: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 12, batch: int = 64,
    rate: float = 0.05, decay: float = 1e-4, seed: int = 7,
) -> FactorizationMachine:
    """Logistic loss by AdaGrad over mini-batches; ``rows`` hold term positions."""
    rng = np.random.default_rng(seed)
    size = int(index.max()) + 1
    share = min(max(float(labels.mean()), 1e-4), 1 - 1e-4)
    machine = FactorizationMachine(index, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = [rows[i] for i in order[at : at + batch]]
            counts = np.array([len(x) for x in chosen])
            terms = np.concatenate(chosen)
            row = np.repeat(np.arange(len(chosen)), counts)
            error = sigmoid(machine.raw(terms, np.cumsum(counts))) - labels[order[at : at + batch]]
            v = machine.factors[terms]
            sums = np.stack([np.bincount(row, v[:, f], len(chosen)) for f in range(rank)], axis=1)
            by_term = error[row] / len(chosen)
            used = np.unique(terms)
            grad_w = np.bincount(terms, by_term, size)[used] + decay * machine.weights[used]
            pair = by_term[:, None] * (sums[row] - v)
            grad_v = np.stack([np.bincount(terms, pair[:, f], size) for f in range(rank)], axis=1)[used]
            grad_v += decay * machine.factors[used]
            grad_b = float(error.mean())
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += grad_b**2
            machine.weights[used] -= 4 * rate * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            machine.bias -= rate * grad_b / np.sqrt(seen_b)
    return machine


def choose_terms(counts: np.ndarray, rows: np.ndarray, most: int, least_z: float = 3.0) -> np.ndarray:
    """Position per bucket of the ``most`` terms with the largest standardised log odds; -1 for the rest."""
    a, b = counts[1] + 0.5, counts[0] + 0.5
    z = np.abs(np.log(a / (rows[1] + 1)) - np.log(b / (rows[0] + 1))) / np.sqrt(1 / a + 1 / b)
    z[counts.sum(axis=0) < 3] = 0
    top = np.argsort(-z, kind="stable")[:most]
    top = np.sort(top[z[top] >= least_z])
    index = np.full(len(z), -1, np.int64)
    index[top] = np.arange(len(top))
    return index


def with_terms(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the carried columns and ``terms``, the sorted buckets of every row's text. No shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                terms = pa.array([hasher.buckets(t.as_py()) for t in part.column(0)], pa.list_(pa.int32()))
                yield pa.record_batch([*part.columns[1:], terms], names=[*part.schema.names[1:], "terms"])

    rows = keyed(docs, *carry).select("text", "doc_id", *carry)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(compute, f"{fields}terms array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column end to end, and the number of each row."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def train(labelled: DataFrame, max_fit_rows: int = 16_000, max_terms: int = 2_048, rank: int = 4) -> FactorizationMachine:
    """Fits on ``labelled`` (doc_id, terms, label 0/1; other labels are left out)."""
    rows = labelled.select("doc_id", "terms", F.col("label").cast("int")).where("label IN (0, 1)")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            values, row = _lists(batch.column(1))
            for label in (0, 1):
                table[label, :BUCKETS] += np.bincount(values[labels[row] == label], minlength=BUCKETS)
                table[label, BUCKETS] += (labels == label).sum()
        for label in (0, 1):
            at = np.flatnonzero(table[label])
            columns = [pa.array(np.full(len(at), label), pa.int32()), pa.array(at, pa.int32()), pa.array(table[label][at])]
            yield pa.record_batch(columns, names=["label", "bucket", "n"])

    counted = rows.mapInArrow(count, "label int, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, BUCKETS + 1), np.int64)
    table[counted["label"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    totals, index = table[:, BUCKETS], choose_terms(table[:, :BUCKETS], table[:, BUCKETS], max_terms)
    if not totals.all() or index.max() < 0:
        share = float(totals[1] / totals.sum()) if totals.any() else 0.0
        bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return FactorizationMachine(np.full(BUCKETS, -1), bias, np.zeros(1), np.zeros((1, rank)))

    shared = labelled.sparkSession.sparkContext.broadcast(index)
    share = min(1.0, max_fit_rows / int(totals.sum()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << DRAW_BITS)) < int(share * (1 << DRAW_BITS)))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, row = _lists(batch.column(1))
            places = shared.value[values]
            ends = np.r_[0, np.cumsum(np.bincount(row[places >= 0], minlength=batch.num_rows))]
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places[places >= 0], pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(2), terms], names=["doc_id", "label", "terms"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        terms = [np.array(x, np.int64) for x in table["terms"].to_pylist()]
        if len(set(table["label"].to_pylist())) < 2:
            return pa.table({"bias": [0.0], "weights": [[0.0]], "factors": [[0.0]], "both": [False]})
        machine = fit_machine(shared.value, terms, table["label"].to_numpy().astype(float), rank)
        return pa.table({"bias": [machine.bias], "weights": [machine.weights.tolist()], "factors": [machine.factors.ravel().tolist()], "both": [True]})

    features = sample.mapInArrow(positions, "doc_id bigint, label int, terms array<bigint>")
    fitted = features.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "bias double, weights array<double>, factors array<double>, both boolean").first()
    if fitted is None or not fitted["both"]:
        raise ValueError(f"a draw of about {max_fit_rows} of {int(totals.sum())} labelled rows has only one class: raise max_fit_rows")
    return FactorizationMachine(index, fitted["bias"], np.array(fitted["weights"]), np.array(fitted["factors"]).reshape(-1, rank))


def score_toxicity(hashed: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score of rows with ``terms``."""
    shared = hashed.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            values, row = _lists(batch.column(1))
            places = machine.index[values]
            ends = np.cumsum(np.bincount(row[places >= 0], minlength=batch.num_rows))
            scores = pa.array(sigmoid(machine.raw(places[places >= 0], ends)))
            yield pa.record_batch([batch.column(0), scores], names=["doc_id", "score"])

    return hashed.select("doc_id", "terms").mapInArrow(compute, "doc_id bigint, score double")
