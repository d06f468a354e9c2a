"""One-dimensional Gaussian kernel density of training scores.

The sum over all training scores is kept as moments: scores fall into cells half a bandwidth wide, and a cell holds the sums of
the powers of their distances from its middle. A kernel of a score near the middle is a short Taylor series in that distance
(Hermite polynomials times the kernel at the middle), so the density at any place follows from the cells alone. With ``ORDER``
terms what is left out is below 1e-15 of the kernel's peak, which is rounding; the same rule holds for any number of scores. The
model is as large as the range of the scores in bandwidths, not as their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.thresholds import quantile

ORDER = 18  # terms of the series: (1/4)^18 / sqrt(18!) is under 1e-18
CELL = 0.5  # width of a cell in bandwidths
REACH = 39.0  # bandwidths from which the kernel is 0 in double precision
_BLOCK = 1 << 20  # numbers of an intermediate array


@dataclass(frozen=True)
class DensityModel:
    """Occupied cells in order, their moments (a row a cell: sums of ((x - middle) / bandwidth)^k / k!), number of scores, bandwidth."""

    cells: np.ndarray
    moments: np.ndarray
    n: int
    bandwidth: float
    epsilon: float

    def density(self, x: np.ndarray) -> np.ndarray:
        """Densities at the given places, a block of bounded size at a time; cells out of reach play no part. Equal places count once:
        short sessions have few different scores."""
        x, back = np.unique(x, return_inverse=True)
        out = np.zeros(len(x))
        at = x / self.bandwidth
        middles = (self.cells + 0.5) * CELL
        first, last = np.searchsorted(middles, at - REACH), np.searchsorted(middles, at + REACH)
        start = 0
        while start < len(at):
            end, low, high = start + 1, first[start], last[start]
            while end < len(at) and (end + 1 - start) * (max(high, last[end]) - low) <= _BLOCK:
                high = max(high, last[end])
                end += 1
            t = at[start:end, None] - middles[None, low:high]
            kernel = np.exp(-0.5 * t * t)
            before, now = np.zeros_like(t), np.ones_like(t)
            total = np.zeros_like(t)
            for k in range(ORDER):
                total += self.moments[None, low:high, k] * now
                before, now = now, t * now - k * before
            out[start:end] = (total * kernel).sum(axis=1)
            start = end
        return np.maximum(out, 0.0)[back] / (self.n * self.bandwidth * math.sqrt(2 * math.pi))


def bandwidth_factor(rule: str | float, n: int) -> float:
    """Scott n^(-1/5), Silverman (3n/4)^(-1/5), or a given positive number."""
    if rule == "scott":
        return n ** (-0.2)
    if rule == "silverman":
        return (n * 3.0 / 4.0) ** (-0.2)
    return float(rule)


def kde_fit(training: DataFrame, rule: str | float = "scott", epsilon: float = 1e-12, score_col: str = "information_score") -> DensityModel:
    """Bandwidth = factor x sample deviation; the moments are one aggregate with partial sums, a row an occupied cell."""
    scores = training.select(F.col(score_col).cast("double").alias("x")).where("x is not null")
    r = scores.agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if r["n"] < 2 or not r["lo"] < r["hi"] or not r["sd"] > 0:
        raise ValueError("a density needs at least two different training scores")
    h = bandwidth_factor(rule, r["n"]) * r["sd"]
    place = F.col("x") / F.lit(h)
    cell = F.floor(place / F.lit(CELL))
    off = scores.select(cell.alias("cell"), (place - (cell + 0.5) * F.lit(CELL)).alias("d"))
    sums = [F.sum(F.pow("d", F.lit(k)) / F.lit(float(math.factorial(k)))).alias(f"m{k}") for k in range(ORDER)]
    table = off.groupBy("cell").agg(*sums).orderBy("cell").toPandas()  # range over half a bandwidth, rows at most
    return DensityModel(table["cell"].to_numpy(np.int64), table[[f"m{k}" for k in range(ORDER)]].to_numpy(float), r["n"], h, epsilon)


def kde_score(scores: DataFrame, model: DensityModel, score_col: str = "information_score") -> DataFrame:
    """Add density and density_score = -ln(density + epsilon). The cells go to every task; rows stay where they are."""
    shared = scores.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def density(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for x in batches:
            yield pd.Series(m.density(x.to_numpy(float)))

    return scores.withColumn("density", density(F.col(score_col))).withColumn("density_score", -F.log(F.col("density") + F.lit(model.epsilon)))


def kde_threshold(validation: DataFrame, q: float) -> float:
    """Quantile of validation density scores; anomalous is strictly over it."""
    return quantile(validation, F.col("density_score"), q)
