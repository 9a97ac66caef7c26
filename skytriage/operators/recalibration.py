"""Recalibration of class probabilities: a weighted multinomial regression on their logarithms, solved by Newton steps.

A step needs the loss, its gradient and its Gram matrix at one point. Each task adds these up over its rows (some 150
numbers for three classes), Spark adds the tasks' sums, and the driver solves a system of 12 unknowns. The rows are written
once, narrow, and scanned once a step; some ten steps reach rounding error whatever the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASS_IDS
from ..functions.scalars import clipped_log
from ..sources.shared import discard, shared_folder
from .validate import check_boundary

STEPS, ENOUGH = 100, 1e-12


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Gram matrix of the weighted multinomial loss at theta (classes x features), as one vector."""
    z = x @ theta.T
    z -= z.max(axis=1, keepdims=True)
    total = np.log(np.exp(z).sum(axis=1, keepdims=True))
    p, k = np.exp(z - total), len(theta)
    loss = -(w * (z - total)[np.arange(len(y)), y]).sum()
    gap = p.copy()
    gap[np.arange(len(y)), y] -= 1
    gram = np.array([[x.T @ (x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]) for b in range(k)] for a in range(k)])
    return np.concatenate([[loss], ((w[:, None] * gap).T @ x).ravel(), gram.transpose(0, 2, 1, 3).ravel()])


def newton(sums, classes: int, features: int, strength: float) -> np.ndarray:
    """Coefficients (classes x features, the last feature being constant and free of the penalty) of least
    strength * loss + |coefficients|^2 / 2; sums(theta) gives what _sums gives, over all rows. Steps are halved until the
    loss falls. Adding a number to all constants changes nothing; theirs have the sum 0."""
    size = classes * features
    held = np.tile(np.append(np.ones(features - 1), 0.0), classes)
    theta, step, best = np.zeros(size), np.zeros(size), np.inf
    for _ in range(STEPS):
        s = sums((theta + step).reshape(classes, features))
        value = strength * s[0] + (held * (theta + step) ** 2).sum() / 2
        if not value <= best + 1e-12 * abs(best):
            step = step / 2
            continue
        theta, best = theta + step, value
        gradient = strength * s[1 : 1 + size] + held * theta
        gram = strength * s[1 + size :].reshape(size, size) + np.diag(held)
        step = -np.linalg.lstsq(gram, gradient, rcond=1e-13)[0]
        if np.abs(step).max() < ENOUGH * (1 + np.abs(theta).max()):
            break
    return theta.reshape(classes, features)


class SelectionAwareRecalibrator:
    """Weighted multinomial regression on log probabilities of selected objects; beyond the cutoff raw probabilities stay.

    The class ids of the rows are those that get probability; a single one gets all. Rows without a label, weight or
    probability take no part in the fit and get null."""

    def __init__(self, strength: float = 1.0, cutoff: float = 1.5):
        self.strength, self.cutoff, self.theta, self.classes = strength, cutoff, None, ()

    def fit(self, df: DataFrame, label: str = "y", weight: str = "w") -> SelectionAwareRecalibrator:
        """Jobs run while this is called: one to write the narrow rows, one for their classes and one for each step."""
        check_boundary(df)
        spark, folder = df.sparkSession, shared_folder(df.sparkSession, "recalibration")
        logs = [clipped_log(F.col(f"p_{c}")).alias(f"x{i}") for i, c in enumerate(CLASS_IDS)]
        df.dropna(subset=[f"p_{c}" for c in CLASS_IDS]).select(*logs, F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w")).dropna().write.parquet(folder)
        rows = spark.read.parquet(folder)
        classes = sorted(r[0] for r in rows.select("y").distinct().limit(100).collect())
        if not classes:
            raise ValueError("no rows to recalibrate to")

        def at(theta: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(1 + theta.size + theta.size**2)
                for b in batches:
                    x = np.stack([*(b.column(f"x{i}").to_numpy() for i in range(len(CLASS_IDS))), np.ones(b.num_rows)], 1)
                    total += _sums(x, np.searchsorted(classes, b.column("y").to_numpy()), b.column("w").to_numpy(), theta)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

            found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row for each number
            return np.array([v for _, v in sorted(map(tuple, found))])

        self.classes, self.theta = classes, newton(at, len(classes), 1 + len(CLASS_IDS), self.strength) if len(classes) > 1 else np.zeros((1, 1 + len(CLASS_IDS)))
        discard(folder)
        return self

    def probabilities(self) -> dict[int, Column]:
        """class -> column of the recalibrated probability, of p_<class>; plain expressions."""
        if self.theta is None:
            raise RuntimeError("probabilities are recalibrated before the fit")
        logs = [clipped_log(F.col(f"p_{c}")) for c in CLASS_IDS]
        z = [sum((F.lit(float(t)) * x for t, x in zip(own, logs, strict=False)), F.lit(float(own[-1]))) for own in self.theta]
        top = F.greatest(*z) if len(z) > 1 else z[0]
        parts = [F.exp(v - top) for v in z]
        total = sum(parts[1:], parts[0])
        share = dict(zip(self.classes, parts, strict=True))
        known = F.lit(True)
        for c in CLASS_IDS:
            known = known & F.col(f"p_{c}").isNotNull()
        return {c: F.when(known, share[c] / total if c in share else F.lit(0.0)) for c in CLASS_IDS}

    def predict(self, df: DataFrame) -> DataFrame:
        """df with q_<class>, the recalibrated probabilities."""
        new, z = self.probabilities(), F.col("hostgal_photoz")
        beyond = (z > self.cutoff) & ~F.isnan(z)  # a redshift that is missing is not beyond
        return df.withColumns({f"q_{c}": F.when(beyond, F.col(f"p_{c}")).otherwise(x) for c, x in new.items()})
