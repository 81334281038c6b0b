"""Logistic regression on truth values under an L1 penalty, in one task: the driver holds neither the rows nor a job per step."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def truth_values(values: dict[str, np.ndarray], rules: Sequence) -> np.ndarray:
    """Row by rule; a rule is a conjunction of (statistic, at most or above, threshold), NaN above all."""
    n = len(next(iter(values.values())))
    out = np.ones((n, len(rules)), bool)
    for k, rule in enumerate(rules):
        for name, low, threshold in rule:
            most = values[name] <= threshold
            out[:, k] &= most if low else ~most
    return out


def lasso(truths: np.ndarray, ones: np.ndarray, penalty: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept with the least mean log loss plus ``penalty`` times the weights' sizes, each times its column's standard deviation.

    Newton steps, whose quadratic problems are solved by coordinate descent. Equal rows count as one with their number.
    """
    rows, columns = truths.shape
    packed, of = np.unique(np.packbits(truths, axis=1), axis=0, return_inverse=True)
    number = np.bincount(of.ravel(), minlength=len(packed))
    share, y = number / rows, np.bincount(of.ravel(), ones, len(packed)) / number
    x = np.unpackbits(packed, axis=1, count=columns).astype(float)
    mean = share @ x
    deviation = np.sqrt(np.maximum(mean - mean * mean, 0) * rows / max(rows - 1, 1))
    used = (deviation > 1e-9).nonzero()[0]
    z = (x[:, used] - mean[used]) / deviation[used]
    beta, start = np.zeros(len(used)), share @ y
    level = np.log(start / (1 - start))

    def loss(beta, level):
        eta = level + z @ beta
        return share @ (np.logaddexp(0, eta) - y * eta) + penalty * np.abs(beta).sum()

    now = loss(beta, level)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(level + z @ beta, -500, 500)))
        off, curve = share * (p - y), share * np.maximum(p * (1 - p), 1e-9)
        gradient, along, total = z.T @ off, z.T @ curve, curve.sum()
        hessian = z.T @ (curve[:, None] * z) - np.outer(along, along) / total  # the intercept's best move is put in
        new = descend(hessian, gradient - off.sum() * along / total, beta, penalty)
        move = new - beta
        shift = -(off.sum() + along @ move) / total
        slope = gradient @ move + off.sum() * shift + penalty * (np.abs(new).sum() - np.abs(beta).sum())
        t = 1.0
        while (then := loss(beta + t * move, level + t * shift)) > now + 0.01 * t * slope and t > 1e-9:
            t /= 2
        if then >= now:
            break
        beta, level, gain, now = (new if t == 1 else beta + t * move), level + t * shift, now - then, then
        if gain < 1e-12:
            break
    weights = np.zeros(columns)
    weights[used] = beta / deviation[used]
    return weights, float(level - weights @ mean)


def descend(hessian: np.ndarray, gradient: np.ndarray, beta: np.ndarray, penalty: float, sweeps: int = 1000) -> np.ndarray:
    """The place of least value of gradient and curvature from ``beta`` on, plus the penalty."""
    new, slope, size = beta.copy(), gradient.copy(), hessian.diagonal()
    for _ in range(sweeps):
        most = 0.0
        for j in (((new != 0) | (np.abs(slope) > penalty)) & (size > 1e-12)).nonzero()[0]:
            at = size[j] * new[j] - slope[j]
            step = np.sign(at) * max(abs(at) - penalty, 0) / size[j] - new[j]
            if step:
                new[j] += step
                slope += hessian[j] * step
                most = max(most, step * step * size[j])
        if most < 1e-14:
            break
    return new


def fit_weights(sample: DataFrame, rules: Sequence, label_col: str, penalty: float) -> tuple[list[float], float]:
    """The rules' weights and the intercept for label 1, from one task; the sample is bounded by its caller."""
    names = sorted({name for rule in rules for name, _, _ in rule})

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        values = {n: rows.column(n).to_numpy() for n in names}
        weights, intercept = lasso(truth_values(values, rules), rows.column(label_col).to_numpy() == 1, penalty)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "intercept": pa.array([intercept], pa.float64())})

    row = sample.select(label_col, *names).coalesce(1).mapInArrow(task, "weights array<double>, intercept double").first()
    return row["weights"], row["intercept"]
