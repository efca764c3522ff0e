"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text gives, in one pass, a vector of shares and counts on logit and log scales; training and scoring read these
vectors, never the texts again. Class moments over all labelled rows are summed
in Spark (one cell per row, so the driver sees a few hundred numbers whatever the input), shrunk towards the pooled
diagonal, and factorised once; a score is the logistic of the difference of the two Gaussian log densities, computed
from Mahalanobis distances with the cached Cholesky factors.

Defined results: null and empty texts have the statistics of an empty text and are scored by them; without training
rows of both classes every score is the share of class 1 (0.5 without any); rows that repeat an id are scored each; an
empty table gives no rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import keyed

STATISTICS = (
    "lower", "upper", "digit", "plain_marks", "odd_marks", "beyond_ascii", "blank", "words", "word_length",
    "repeated_words", "adjacent_repeats", "odd_ends", "lines", "repeated_lines", "line_length", "compression",
)
_CLASS_OF_BYTE = np.full(256, 5)
for _bytes, _class in (
    (b"abcdefghijklmnopqrstuvwxyz", 0),
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1),
    (b"0123456789", 2),
    (b".,;:'\"-()?", 3),
    (b"!#$%&*+/<=>@[\\]^_`{|}~", 4),
    (b" \t\n\x0b\x0c\r", 6),
):
    _CLASS_OF_BYTE[list(_bytes)] = _class
_ODD_ENDS = tuple("!#$%&*+/<=>@[\\]^_`{|}~")


def _logit(share: float) -> float:
    return float(np.log((share + 0.002) / (1.002 - share)))


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    text = text or ""
    data = text.encode()
    n = max(1, len(data))
    kinds = np.bincount(_CLASS_OF_BYTE, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=7) / n
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    values = [_logit(x) for x in kinds.tolist()]
    values += [
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / w),
        _logit(1 - len(set(words)) / w if words else 0.0),
        _logit(sum(map(eq, words, words[1:])) / w),
        _logit(sum(x.endswith(_ODD_ENDS) for x in words) / w),
        np.log1p(len(lines)),
        _logit(1 - len(set(lines)) / len(lines)),
        np.log1p(len(data) / len(lines)),
        np.log((len(zlib.compress(data, 1)) + 20) / (len(data) + 20)),
    ]
    return np.array(values)


@dataclass
class QuadraticDiscriminant:
    """Means, Cholesky factors and log priors of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    log_priors: np.ndarray
    share: float = 0.5

    @classmethod
    def from_moments(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float, ridge: float):
        total = counts.sum()
        if (counts < 2).any():
            return cls(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), float(counts[1] / total) if total else 0.5)
        means = sums / counts[:, None]
        covariances = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.diag(np.einsum("c,cii->i", counts / total, covariances))
        eye = np.eye(means.shape[1])
        shrunk = [(1 - shrinkage) * c + shrinkage * pooled + ridge * eye for c in covariances]
        return cls(means, np.array([np.linalg.cholesky(c) for c in shrunk]), np.log(counts / total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not len(self.means):
            return np.full(len(x), self.share)
        densities = []
        for mean, factor, prior in zip(self.means, self.factors, self.log_priors):
            z = np.linalg.solve(factor, (x - mean).T)
            densities.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(densities[0] - densities[1], -500, 500)))


def with_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the carried columns and ``statistics`` of every row. One pass over the texts, no shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[1:], found], names=[*batch.schema.names[1:], "statistics"])

    rows = keyed(docs, *carry).select("text", "doc_id", *carry)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(compute, f"{fields}statistics array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def train(labelled: DataFrame, shrinkage: float = 0.1, ridge: float = 1e-3) -> QuadraticDiscriminant:
    """Fits on every row of ``labelled`` (statistics, label 0/1; other labels are left out)."""
    d = len(STATISTICS)
    width = 1 + d + d * d

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width))
        for batch in batches:
            labels, x = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(0))
            for c in (0, 1):
                own = x[labels == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.record_batch([pa.array(np.arange(2 * width), pa.int32()), pa.array(sums.ravel())], names=["cell", "value"])

    rows = labelled.select("statistics", F.col("label").cast("int")).where("label IN (0, 1)")
    cells = np.zeros(2 * width)
    for row in rows.mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect():
        cells[row["cell"]] = row["v"]
    cells = cells.reshape(2, width)
    products = cells[:, 1 + d :].reshape(2, d, d)
    return QuadraticDiscriminant.from_moments(cells[:, 0], cells[:, 1 : 1 + d], products, shrinkage, ridge)


def score_quality(measured: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """doc_id, score of rows with ``statistics``."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(shared.value.scores(_matrix(batch.column(1))))
                yield pa.record_batch([batch.column(0), scores], names=["doc_id", "score"])

    return measured.select("doc_id", "statistics").mapInArrow(compute, "doc_id bigint, score double")
