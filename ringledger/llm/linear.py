"""A linear classifier for a bounded sample in the driver, and where the sample comes from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by damped Newton steps; ``y`` may be probabilities. The last coefficient is the intercept."""
    rows = np.column_stack([x, np.ones(len(x))])
    found = np.zeros(rows.shape[1])
    ridge = np.full(rows.shape[1], penalty)
    ridge[-1] = 1e-3

    def loss(c: np.ndarray) -> float:
        z = rows @ c
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (c * c))

    now = loss(found)
    for _ in range(rounds):
        p = sigmoid(rows @ found)
        slope = rows.T @ (weight * (p - y)) + ridge * found
        curve = (rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(found - size * step) > now:
            size /= 2
        if size <= 1e-4:
            break
        found = found - size * step
        new = loss(found)
        if now - new < 1e-6 * max(1.0, abs(now)):
            break
        now = new
    return found


def decide(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Log-odds of each row."""
    return x @ found[:-1] + found[-1]


def sampled(rows: DataFrame, group: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each ``group``, never more, by a hash of ``doc_id``; and each group's rows in all.

    The hash picks the same rows in every run. Groups of up to ``most`` rows are kept whole. There are
    few groups: one row each goes to the driver.
    """
    counts = {x[0]: x[1] for x in rows.groupBy(group).agg(F.count("*")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(1.0 if n <= most else 0.97 * most / n)).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    return picked.limit(most * max(1, len(counts))), counts
