"""Linear models of all model sets and runs: logistic regression and the linear support vector machine.

Both are convex, so a fit is right or wrong whatever solved it: ``certificates`` derives from a table of fitted models and
the training rows how far each is from its optimum, and a fit that does not get there raises.

* Logistic regression: L-BFGS, preconditioned by the second moments of each class, which bound the Hessian of every run. A
  step needs losses and gradients summed over the rows. Where a set has at most ``LOCAL_ROWS`` training rows the rows of a
  run meet in one task and the whole loop runs there. Beyond that the loop runs on the driver and each step is one Spark
  job for *all* open models at once: rows carry their runs as a mask, a batch gives the margins of all models by one
  product, and a few numbers per model come back. Models are taken in waves of bounded bytes. Both ways are one code.
* Support vector machine: a primal-dual interior point method per pair of classes, in one task per (set, run), on at most
  ``max_fit_rows`` training rows: of more, those with the lowest hashes of row, set and run. Probabilities come from a
  logistic curve over margins of machines that have not seen the row.

Fitted models are a table (``fit``), to be kept with ``write.parquet`` and applied to any rows (``transform``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.operators.folds import Folds
from reviewlab.operators.passes import WAVE_BYTES, fit_tasks, summed, waves
from reviewlab.operators.sampling import in_run
from reviewlab.session import durable

GRADIENT = 1e-10
"""Largest gradient norm of a finished logistic model, per training row; times C it bounds the distance to the optimum."""
GAP = 1e-4
"""Duality gap that a support vector machine aims at, as a share of its objective."""
PASSES = 200
MEMORY = 12
LOCAL_ROWS = 20_000
"""Most training rows of a model that are taken to one task."""

# The inverse regularisation strength and the folds of the calibration in the experiments.
REGULARISATION_C = 1.0
CALIBRATION_FOLDS = 5

MODEL_SCHEMA = "model_set string, run int, kind string, classes array<string>, rows array<array<double>>, slope double, offset double"


@dataclass(frozen=True)
class Model:
    """One fit to make: its classes with their balanced weights and, for a machine, the fold that is left out (-1: none)."""

    model_set: str
    run: int
    classes: tuple[str, ...]
    weights: tuple[float, ...]
    counts: tuple[int, ...]
    left_out: int = -1

    @property
    def key(self) -> str:
        return "\x1f".join((self.model_set, str(self.run), *self.classes, str(self.left_out)))


def models_of(folds: Folds) -> list[Model]:
    """One per (model set, run), from the counts of the split."""
    found: dict[tuple[str, int], list] = {}
    for r in folds.weights.select("model_set", "run", "label", "n", "weight").toArrow().to_pylist():
        found.setdefault((r["model_set"], r["run"]), []).append((r["label"], r["weight"], r["n"]))
    return [Model(name, run, *map(tuple, zip(*sorted(rows)))) for (name, run), rows in sorted(found.items())]


def training_rows(folds: Folds, parts: int, most: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """model_set, row_id, label, part (of the calibration), train_mask, embedding: the rows that train in any run, written by set.

    ``most`` has the share of its training rows that a (model set, run) takes, where that is not all of them: those whose
    hash of row, set and run is lowest. The others lose the run in their mask.
    """
    part = F.pmod(F.xxhash64("row_id", F.lit(folds.base_seed)), F.lit(parts)).cast("int").alias("part")
    rows = folds.rows.where(F.col("train_mask") != 0)
    for (name, run), share in sorted((most or {}).items()):
        draw = F.pmod(F.xxhash64("row_id", "model_set", F.lit(run), F.lit(folds.base_seed)), F.lit(1 << 30))
        left = (F.col("model_set") == name) & (draw >= F.lit(share * (1 << 30)))
        rows = rows.withColumn("train_mask", F.when(left, F.col("train_mask").bitwiseAND(F.lit(~(1 << run)))).otherwise(F.col("train_mask")))
    return durable(rows.select("model_set", "row_id", "label", part, "train_mask", "embedding"), ["model_set"])


# -- passes ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rows:
    """The rows of one model set in a batch: vectors with a constant 1 at the end, labels, parts, masks."""

    x: np.ndarray
    label: np.ndarray
    part: np.ndarray
    mask: np.ndarray

    def weights(self, models: list[Model]) -> np.ndarray:
        """[row, model]: the row's weight in the model, 0 where it does not train."""
        trains = (self.mask[:, None] >> np.array([m.run for m in models])[None, :] & 1).astype(bool)
        trains &= self.part[:, None] != np.array([m.left_out for m in models])[None, :]
        known = np.zeros((len(self.x), len(models)))
        for place, m in enumerate(models):
            for c, w in zip(m.classes, m.weights):
                known[self.label == c, place] = w
        return known * trains


def _batch_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, Rows]]:
    if not batch.num_rows:
        return
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    names, label = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("model_set", "label"))
    part, mask = batch.column("part").to_numpy(), batch.column("train_mask").to_numpy()
    for name in np.unique(names):
        mine = names == name
        yield name, Rows(x[mine], label[mine], part[mine], mask[mine])


Adds = Callable[[str, Rows], Iterable[tuple[str, np.ndarray]]]


Passes = Callable[[Adds, "Callable[[str, np.ndarray], np.ndarray] | None"], dict[str, np.ndarray]]
"""Adds up what each key gets from all training rows; a second function works on a key's sum where it ends up."""


def over(rows: DataFrame) -> Passes:
    """Passes as Spark jobs over a table."""
    return lambda adds, then: summed(rows, lambda batch: (pair for name, found in _batch_rows(batch) for pair in adds(name, found)), then)


def within(name: str, rows: Rows) -> Passes:
    """The same over rows that one task holds."""
    return lambda adds, then: {key: value if then is None else then(key, value) for key, value in adds(name, rows)}


def _by_set(models: Iterable[Model]) -> dict[str, list[Model]]:
    found: dict[str, list[Model]] = {}
    for m in models:
        found.setdefault(m.model_set, []).append(m)
    return found


# -- logistic regression --------------------------------------------------------------------------


@dataclass(frozen=True)
class LogisticLoss:
    """Weighted log loss plus half the squared weights over C.

    ``one_vs_rest``: each class against the others, the constant penalised too. Else one softmax over three or more
    classes, or one logit for the second of two, with a free constant.
    """

    c: float = REGULARISATION_C
    one_vs_rest: bool = False

    def outputs(self, m: Model) -> list[int]:
        """The classes that have weights of their own."""
        return [1] if len(m.classes) == 2 else list(range(len(m.classes)))

    def penalty(self, width: int) -> np.ndarray:
        per_weight = np.full(width, 1.0 / self.c)
        if not self.one_vs_rest:
            per_weight[-1] = 0.0
        return per_weight

    def adds(self, models: list[Model], at: dict[str, np.ndarray]) -> Adds:
        """Loss and gradient of each model without the penalty, at weights [output, component]."""
        groups: dict[str, list[list[Model]]] = {}
        for name, mine in _by_set(models).items():
            alike: dict[int, list[Model]] = {}
            for m in mine:
                alike.setdefault(len(m.classes), []).append(m)
            groups[name] = list(alike.values())
        loss = self

        def add(name: str, rows: Rows) -> Iterator[tuple[str, np.ndarray]]:
            for group in groups.get(name, ()):
                outputs = loss.outputs(group[0])
                weights = np.stack([at[m.key] for m in group])
                logits = np.einsum("nd,mkd->nmk", rows.x, weights, optimize=True)
                hit = np.stack([[rows.label == m.classes[k] for k in outputs] for m in group]).transpose(2, 0, 1)
                s = rows.weights(group)
                if loss.one_vs_rest or len(outputs) == 1:
                    side = np.where(hit, 1.0, -1.0)
                    value = np.logaddexp(0, -side * logits)
                    slope = -side / (1 + np.exp(np.clip(side * logits, -700, 700)))
                else:
                    top = logits.max(axis=2, keepdims=True)
                    total = np.log(np.exp(logits - top).sum(axis=2, keepdims=True)) + top
                    value = np.where(hit, total - logits, 0.0)
                    slope = np.exp(logits - total) - hit
                gradient = np.einsum("nmk,nd->mkd", slope * s[:, :, None], rows.x, optimize=True)
                losses = (value * s[:, :, None]).sum(axis=(0, 2))
                for place, m in enumerate(group):
                    yield m.key, np.concatenate([[losses[place]], gradient[place].ravel()])

        return add

    def at(self, sums: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Objective and gradient from the sums of a pass."""
        per_weight = self.penalty(weights.shape[1])
        return sums[0] + 0.5 * float((per_weight * weights**2).sum()), sums[1:].reshape(weights.shape) + per_weight * weights


def _preconditioners(passes: Passes, models: list[Model], loss: LogisticLoss) -> dict[str, np.ndarray]:
    """Per model the inverse of a bound of its Hessian at any weights, from the second moments of each class.

    The moments are summed over all training rows of a set and stand for those of each run. Inverted in the tasks.
    """
    by_set = _by_set(models)
    labels = {name: sorted({c for m in mine for c in m.classes}) for name, mine in by_set.items()}

    def adds(name: str, found: Rows) -> Iterator[tuple[str, np.ndarray]]:
        if name in labels:
            parts = [found.x[found.label == label] for label in labels[name]]
            yield name, np.concatenate([np.concatenate([[len(x)], (x.T @ x).ravel()]) for x in parts])

    def inverted(name: str, flat: np.ndarray) -> np.ndarray:
        size = math.isqrt(len(flat) // len(labels[name]) - 1)
        moments = {c: (v[0], v[1:].reshape(size, size)) for c, v in zip(labels[name], flat.reshape(len(labels[name]), -1))}
        found = []
        for m in by_set[name]:
            total = sum(w * n / moments[c][0] * moments[c][1] for c, w, n in zip(m.classes, m.weights, m.counts))
            share = 0.25 if loss.one_vs_rest or len(m.classes) == 2 else 0.5
            found.append(np.linalg.inv(share * total + np.diag(loss.penalty(size) + 1e-9)))
        return np.stack(found).ravel()

    inverses = {}
    for name, flat in passes(adds, inverted).items():
        size = math.isqrt(len(flat) // len(by_set[name]))
        inverses |= {m.key: one for m, one in zip(by_set[name], flat.reshape(-1, size, size))}
    return inverses


class Lbfgs:
    """Steps of one model: bounded memory of past steps over a fixed preconditioner."""

    def __init__(self, start: np.ndarray, solve: Callable[[np.ndarray], np.ndarray]) -> None:
        self.weights, self.solve = start, solve
        self.value, self.gradient = np.inf, np.zeros_like(start)
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.step = np.zeros_like(start), 0.0

    def trial(self) -> np.ndarray:
        return self.weights + self.step * self.direction

    def told(self, value: float, gradient: np.ndarray) -> None:
        """Take the trial if it is good enough, else halve the step."""
        slope = float((self.gradient * self.direction).sum())
        # Near the optimum the values agree to rounding and only the gradient still tells.
        flat = (gradient**2).sum() < (self.gradient**2).sum() and abs(value - self.value) <= 1e-12 * abs(value)
        if not (value <= self.value + 1e-4 * self.step * slope or flat):
            self.step /= 2
            return
        moved, bent = self.step * self.direction, gradient - self.gradient
        if self.step and float((moved * bent).sum()) > 0:
            self.past = [*self.past, (moved, bent)][-MEMORY:]
        self.weights, self.value, self.gradient = self.trial(), value, gradient
        q, factors = gradient.copy(), []
        for s, y in reversed(self.past):
            a = float((s * q).sum() / (s * y).sum())
            q -= a * y
            factors.append(a)
        r = self.solve(q)
        if self.past:
            s, y = self.past[-1]
            r *= float((s * y).sum() / (y * self.solve(y)).sum())
        for (s, y), a in zip(self.past, reversed(factors)):
            r += s * (a - float((y * r).sum() / (s * y).sum()))
        self.direction, self.step = -r, 1.0


def _solver(inverse: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Products by plain sums: on the driver, beside the JVM, threads of a BLAS can hang."""
    return lambda gradient: np.einsum("kd,de->ke", gradient, inverse)


def fit_logistic(passes: Passes, models: list[Model], loss: LogisticLoss, components: int) -> dict[str, np.ndarray]:
    """Weights [output, component] of every model, the constant last."""
    size = components + 1
    done: dict[str, np.ndarray] = {}
    for wave in waves(models, lambda m: 8 * size * size):
        inverses = _preconditioners(passes, wave, loss)
        open_models = {m.key: Lbfgs(np.zeros((len(loss.outputs(m)), size)), _solver(inverses[m.key])) for m in wave}
        by_key = {m.key: m for m in wave}
        for _ in range(PASSES):
            trials = {k: o.trial() for k, o in open_models.items()}
            for key, sums in passes(loss.adds([by_key[k] for k in trials], trials), None).items():
                open_models[key].told(*loss.at(sums, trials[key]))
            ready = [k for k, o in open_models.items() if np.isfinite(o.value) and (o.gradient**2).sum() ** 0.5 <= GRADIENT * sum(by_key[k].counts)]
            done |= {k: open_models.pop(k).weights for k in ready}
            if not open_models:
                break
        else:
            raise ArithmeticError(f"{len(open_models)} logistic models have not converged in {PASSES} passes")
    return done


# -- support vector machine -----------------------------------------------------------------------


SOFTNESS = tuple(4.0**-i for i in range(24))
"""Products of dual weight and slack at which a machine may be left, from coarse to exact."""


def _side(m: Model, label: np.ndarray) -> np.ndarray:
    return np.where(label == m.classes[1], 1.0, -1.0)


def fit_machine(x: np.ndarray, side: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, the constant last, that minimise half their squares (without the constant) plus the weighted hinge loss.

    Newton steps on the optimality conditions, whose products of dual weights and slacks are driven down to a softness at
    which the duality gap is at most ``GAP`` of the objective, and to that softness exactly: then the dual weight of a row
    follows from its margin.
    """
    n, d = x.shape[0], x.shape[1] - 1
    w, dual = np.zeros(d + 1), weight * 0.5
    over_, under = np.ones(n), np.ones(n)  # slack above the margin, shortfall below it: over - under = margin - 1
    place = 0
    for _ in range(PASSES):
        free = weight - dual
        mean = float(dual @ over_ + free @ under) / (2 * n)
        objective = 0.5 * float(w[:-1] @ w[:-1]) + float(weight @ np.maximum(1 - side * (x @ w), 0))
        while place + 1 < len(SOFTNESS) and 2 * n * SOFTNESS[place] > GAP * objective:
            place += 1
        target = max(SOFTNESS[place], 0.2 * mean)
        missing = 1 - side * (x @ w) - under + over_
        unfit = x.T @ (side * dual) - np.append(w[:-1], 0.0)
        gaps = np.abs(dual * over_ - SOFTNESS[place]).max(), np.abs(free * under - SOFTNESS[place]).max()
        if max(gaps) <= 1e-3 * SOFTNESS[place] and np.abs(missing).max() <= 1e-9 and np.abs(unfit).max() <= 1e-7 * max(1.0, np.abs(w).max()):
            return w
        spread = under / free + over_ / dual
        pull = missing - (target - free * under) / free + (target - dual * over_) / dual
        curve = (x.T / spread) @ x + np.diag(np.append(np.ones(d), 0.0))
        move = np.linalg.solve(curve, unfit + x.T @ (side * pull / spread))
        step_dual = (pull - side * (x @ move)) / spread
        step_over = (target - dual * over_ - over_ * step_dual) / dual
        step_under = (target - free * under + under * step_dual) / free
        length = 1.0
        for value, step in ((dual, step_dual), (free, -step_dual), (over_, step_over), (under, step_under)):
            down = step < 0
            if down.any():
                length = min(length, 0.995 * float((-value[down] / step[down]).min()))
        w, dual = w + length * move, dual + length * step_dual
        over_, under = over_ + length * step_over, under + length * step_under
    raise ArithmeticError(f"a support vector machine of {n} rows has not converged in {PASSES} steps")


def dual_weights(margin: np.ndarray, weight: np.ndarray, softness: float) -> np.ndarray:
    """The dual weight of a row with that side * margin, where dual * slack and (weight - dual) * shortfall are ``softness``."""
    far = np.abs(margin - 1) * weight
    less = 2 * softness * weight / (far + 2 * softness + np.sqrt(far**2 + 4 * softness**2))
    return np.where(margin >= 1, less, weight - less)


def _dual_adds(models: list[Model], at: dict[str, np.ndarray], c: float) -> Adds:
    """Per machine the hinge and, per softness and side, the sum of dual weights and of the vectors they weigh."""
    groups = _by_set(models)

    def add(name: str, rows: Rows) -> Iterator[tuple[str, np.ndarray]]:
        mine = groups.get(name, [])
        s = rows.weights(mine) if mine else None
        for place, m in enumerate(mine):
            used = np.flatnonzero(s[:, place])
            x, weight, side = rows.x[used], c * s[used, place], _side(m, rows.label[used])
            margin = side * (x @ at[m.key])
            sums = [[(weight * np.maximum(1 - margin, 0)).sum()]]
            for softness in SOFTNESS:
                dual = dual_weights(margin, weight, softness)
                sums += [(dual * (side == of)) @ x for of in (1, -1)]
            yield m.key, np.concatenate(sums)

    return add


def duality_gap(sums: np.ndarray, weights: np.ndarray) -> float:
    """The least gap over the softnesses, as a share of the objective, from the sums of ``_dual_adds``.

    Dual weights are made feasible: the heavier side is scaled down to the lighter one, then both to the best common factor.
    """
    size = len(weights)
    objective = 0.5 * float((weights[:-1] ** 2).sum()) + sums[0]
    best = objective
    for plus, minus in sums[1:].reshape(-1, 2, size):
        light = min(plus[-1], minus[-1])
        if light > 0:
            joined = plus[:-1] * (light / plus[-1]) - minus[:-1] * (light / minus[-1])
            square = float((joined**2).sum())
            factor = min(1.0, 2 * light / square) if square else 1.0
            best = min(best, objective - factor * 2 * light + 0.5 * factor**2 * square)
    return float(best / objective) if objective else 0.0


def fit_calibration(
    passes: Passes, models: list[Model], weights: dict[str, np.ndarray], unseen: dict[str, dict[int, np.ndarray]]
) -> dict[str, tuple[float, float]]:
    """(slope, offset) of the probability of the second class, per model, by Newton steps over margins of rows that the
    machine behind them has not seen (``unseen``: machines by the fold they left out; the whole machine where a fold has
    none). Targets are drawn in a little from 0 and 1, so that the fit is finite."""
    sets = _by_set(models)
    targets = {m.key: (1 / (m.counts[0] + 2), (m.counts[1] + 1) / (m.counts[1] + 2)) for m in models}

    def adds(curves: dict[str, np.ndarray]) -> Adds:
        def add(name: str, found: Rows) -> Iterator[tuple[str, np.ndarray]]:
            mine = [m for m in sets.get(name, ()) if m.key in curves]
            trains = found.weights(mine) > 0 if mine else None
            for place, m in enumerate(mine):
                used = np.flatnonzero(trains[:, place])
                x, part = found.x[used], found.part[used]
                target = np.where(_side(m, found.label[used]) > 0, targets[m.key][1], targets[m.key][0])
                margin = np.empty(len(x))
                for fold in np.unique(part):
                    margin[part == fold] = x[part == fold] @ unseen[m.key].get(fold, weights[m.key])
                z = curves[m.key][0] * margin + curves[m.key][1]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                bend, off = p * (1 - p), p - target
                value = (np.logaddexp(0, z) - target * z).sum()
                yield m.key, np.array([value, off @ margin, off.sum(), bend @ margin**2, bend @ margin, bend.sum()])

        return add

    done, held = {}, {m.key: (np.inf, np.zeros(2), np.array([1.0, 0.0])) for m in models}
    for _ in range(PASSES):
        trials = {k: at + move for k, (_, at, move) in held.items()}
        for key, (value, g1, g2, h11, h12, h22) in (passes(adds(trials), None) if held else {}).items():
            best, at, move = held[key]
            if value > best + 1e-12 * abs(best):
                held[key] = (best, at, move / 2)
                continue
            h11, h22 = h11 + 1e-9, h22 + 1e-9
            step = np.array([h12 * g2 - h22 * g1, h12 * g1 - h11 * g2]) / (h11 * h22 - h12 * h12)
            held[key] = (value, trials[key], step)
            if np.abs(step).max() <= 1e-9 * (1 + np.abs(trials[key]).max()):
                done[key] = tuple(map(float, held.pop(key)[1]))
        for key in [k for k, (_, at, move) in held.items() if np.abs(move).max() <= 1e-12 * (1 + np.abs(at).max())]:
            done[key] = tuple(map(float, held.pop(key)[1]))
        if not held:
            return done
    raise ArithmeticError(f"{len(held)} calibrations have not converged in {PASSES} passes")


# -- models ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Linear:
    """A protocol model. ``kind``: ``softmax`` (logistic, free constant), ``sigmoid`` (logistic, one against the rest,
    constant penalised) or ``pairs`` (support vector machine, one a pair of classes, by votes)."""

    kind: str
    name: str
    c: float = REGULARISATION_C
    folds: int = CALIBRATION_FOLDS
    local_rows: int = LOCAL_ROWS
    max_fit_rows: int = LOCAL_ROWS

    def rows(self, folds: Folds) -> DataFrame:
        """The training rows of all models."""
        shares = {(m.model_set, m.run): self.max_fit_rows / sum(m.counts) for m in models_of(folds)}
        return training_rows(folds, self.folds, {k: s for k, s in shares.items() if s < 1} if self.kind == "pairs" else None)

    def fit(self, folds: Folds) -> DataFrame:
        """One row per model in ``MODEL_SCHEMA``: its weights per class or pair, the constant last."""
        spark, every = folds.rows.sparkSession, models_of(folds)
        plain = [(m.model_set, m.run, self.kind, list(m.classes), [], None, None) for m in every if len(m.classes) == 1]
        several = [m for m in every if len(m.classes) > 1]
        large = [m for m in several if sum(m.counts) > self.local_rows and self.kind != "pairs"]
        fitted = spark.createDataFrame([], MODEL_SCHEMA)
        if several:
            rows = self.rows(folds)
            fitted = self._in_tasks(rows, {(m.model_set, m.run): m for m in several if m not in large}, folds.runs)
            if large:
                components = len(rows.select("embedding").first()[0])
                plain += self._found(over(rows), large, components)
        return durable(fitted.unionByName(spark.createDataFrame(plain, MODEL_SCHEMA)))

    def _in_tasks(self, rows: DataFrame, models: dict[tuple[str, int], Model], runs: int) -> DataFrame:
        """The models whose rows fit a task: one task each."""

        def one(key: tuple, table: pa.Table) -> pa.Table:
            name, run = (k.as_py() for k in key)
            found = []
            if (name, run) in models:
                # In a fixed order, so that sums round alike however the rows came.
                batch = table.sort_by("row_id").combine_chunks().to_batches()[0]
                ((_, mine),) = _batch_rows(batch)
                found = self._found(within(name, mine), [models[name, run]], mine.x.shape[1] - 1, mine)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.float64())), pa.float64(), pa.float64()]
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            names = ["model_set", "run", "kind", "classes", "rows", "slope", "offset"]
            return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        wanted = rows.sparkSession.createDataFrame(list(models), "model_set string, run int") if models else None
        if wanted is None:
            return rows.sparkSession.createDataFrame([], MODEL_SCHEMA)
        spread = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).where(in_run("train_mask", F.col("run")))
        mine = spread.join(F.broadcast(wanted), ["model_set", "run"], "left_semi")
        return mine.repartition(fit_tasks(len(models)), "model_set", "run").groupBy("model_set", "run").applyInArrow(one, MODEL_SCHEMA)

    def _found(self, passes: Passes, models: list[Model], components: int, rows: Rows | None = None) -> list[tuple]:
        if self.kind == "pairs":
            return [self._machines(passes, m, rows) for m in models]
        fitted = fit_logistic(passes, models, LogisticLoss(self.c, self.kind == "sigmoid"), components)
        return [(m.model_set, m.run, self.kind, list(m.classes), fitted[m.key].tolist(), None, None) for m in models]

    def _machines(self, passes: Passes, m: Model, rows: Rows) -> tuple:
        """The machines of one model over its rows and, for two classes, the curve of its probability."""

        def machine(pair: Model) -> np.ndarray | None:
            weight = rows.weights([pair])[:, 0]
            used = np.flatnonzero(weight)
            side = _side(pair, rows.label[used])
            return fit_machine(rows.x[used], side, self.c * weight[used]) if len(set(side)) == 2 else None

        weights = [machine(pair) for pair in pair_models(m)]
        curve = (None, None)
        if len(m.classes) == 2:
            unseen = {f: w for f in range(self.folds) if (w := machine(replace(m, left_out=f))) is not None}
            curve = fit_calibration(passes, [m], {m.key: weights[0]}, {m.key: unseen})[m.key]
        return (m.model_set, m.run, self.kind, list(m.classes), [w.tolist() for w in weights], *curve)

    def score(self, folds: Folds) -> DataFrame:
        """Fit, then score every test row of every run."""
        columns = ["model_set", "eval_set", "row_id", "label", "embedding", "test_mask"]
        return transform(self.fit(folds), folds.rows.where(F.col("test_mask") != 0).select(*columns))

    def certificates(self, models: DataFrame, folds: Folds) -> DataFrame:
        """model_set, run, classes, measure: how far each stored model is from the optimum of its training rows.

        Logistic models: the norm of the gradient, per training row. Machines: the greatest duality gap of their pairs, as
        a share of the objective. Both come from the weights in the table and the rows, whatever fitted them; models of
        one class are at theirs. Weights of other rows, or that ignore the rows, do not get a small measure.
        """
        base = {(m.model_set, m.run): m for m in models_of(folds)}
        stored = models.toArrow().to_pylist()
        measure = {(r["model_set"], r["run"]): [] if len(r["classes"]) > 1 else [0.0] for r in stored}
        weights = {base[r["model_set"], r["run"]]: np.array(r["rows"]) for r in stored if len(r["classes"]) > 1}
        passes = over(self.rows(folds)) if weights else None
        if self.kind == "pairs":
            machines = [(m, pair, w) for m in weights for pair, w in zip(pair_models(m), weights[m])]
            for wave in waves(machines, lambda found: 16 * len(SOFTNESS) * found[2].size):
                at = {pair.key: (m, w) for m, pair, w in wave}
                sums = passes(_dual_adds([pair for _, pair, _ in wave], {k: w for k, (_, w) in at.items()}, self.c), None)
                for key, (m, w) in at.items():
                    measure[m.model_set, m.run].append(duality_gap(sums[key], w))
        else:
            loss = LogisticLoss(self.c, self.kind == "sigmoid")
            for wave in waves(list(weights), lambda m: 8 * weights[m].size):
                at = {m.key: weights[m] for m in wave}
                sums = passes(loss.adds(wave, at), None)
                for m in wave:
                    gradient = loss.at(sums[m.key], at[m.key])[1]
                    measure[m.model_set, m.run].append(float(np.sqrt((gradient**2).sum())) / sum(m.counts))
        found = [(r["model_set"], r["run"], r["classes"], max(measure[r["model_set"], r["run"]])) for r in stored]
        return models.sparkSession.createDataFrame(found, "model_set string, run int, classes array<string>, measure double")


def _pairs(classes: Iterable) -> list[tuple[int, int]]:
    return list(combinations(range(len(list(classes))), 2))


def pair_models(m: Model) -> list[Model]:
    """The machines of a model: one per pair of its classes, with the weights of the whole."""
    return [replace(m, **{f: (getattr(m, f)[a], getattr(m, f)[b]) for f in ("classes", "weights", "counts")}) for a, b in _pairs(m.classes)]


def _answers(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """Class index and, for two classes, probability of the second of each row of ``x`` (with its constant)."""
    k = len(m["classes"])
    if k == 1:
        return np.zeros(len(x), int), None
    margins = x @ np.array(m["rows"]).T
    if m["kind"] == "pairs":
        votes = np.zeros((len(x), k))
        for place, (a, b) in enumerate(_pairs(m["classes"])):
            votes[np.arange(len(x)), np.where(margins[:, place] > 0, b, a)] += 1
        score = 1 / (1 + np.exp(-np.clip(m["slope"] * margins[:, 0] + m["offset"], -700, 700))) if k == 2 else None
        return votes.argmax(axis=1), score
    if k == 2:
        return (margins[:, 0] > 0).astype(int), 1 / (1 + np.exp(-np.clip(margins[:, 0], -700, 700)))
    return margins.argmax(axis=1), None


SCORES = "model_set string, eval_set string, run int, row_id bigint, y string, yhat string, score double"


def transform(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Score rows (model_set, eval_set, row_id, label, embedding, test_mask) with fitted or reloaded ``models``.

    Models are broadcast in waves of at most about ``WAVE_BYTES``, each wave in a scan of its own. Ties of votes and of
    scores go to the first class.
    """
    context = rows.sparkSession.sparkContext
    size = F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r))
    total = models.agg(F.sum(8 * size).alias("bytes")).first()["bytes"] or 0
    parts_of = max(1, -(-total // WAVE_BYTES))
    wave = F.pmod(F.xxhash64("model_set", "run"), F.lit(parts_of))

    def scorer(shared):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                sets, mask = np.asarray(batch.column("model_set").to_numpy(zero_copy_only=False)), batch.column("test_mask").to_numpy()
                for m in shared.value:
                    mine = np.flatnonzero((sets == m["model_set"]) & (mask >> m["run"] & 1).astype(bool))
                    if not len(mine):
                        continue
                    chosen, score = _answers(x[mine], m)
                    taken = batch.take(pa.array(mine))
                    yield pa.record_batch(
                        [
                            taken.column("model_set"),
                            taken.column("eval_set"),
                            pa.array([m["run"]] * len(mine), pa.int32()),
                            taken.column("row_id"),
                            taken.column("label"),
                            pa.array(np.array(m["classes"], object)[chosen], pa.string()),
                            pa.nulls(len(mine), pa.float64()) if score is None else pa.array(score, pa.float64()),
                        ],
                        ["model_set", "eval_set", "run", "row_id", "y", "yhat", "score"],
                    )

        return apply

    parts = []
    for number in range(parts_of):
        found = models.where(wave == number).toArrow().to_pylist()
        parts.append(rows.mapInArrow(scorer(context.broadcast(found)), SCORES))
    return reduce(DataFrame.unionByName, parts)


def softmax_logistic() -> Linear:
    """Logistic regression with a free constant, multinomial beyond two classes."""
    return Linear("softmax", "REGRESSION")


def one_vs_rest_logistic() -> Linear:
    """Logistic regression with a penalised constant, one class against the others."""
    return Linear("sigmoid", "REGRESSION_OVR")


def linear_svm() -> Linear:
    """Linear support vector machine with calibrated probabilities for two classes."""
    return Linear("pairs", "SVM")
