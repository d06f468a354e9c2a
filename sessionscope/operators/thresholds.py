"""Deviation thresholds and the fusion of two detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.staging import stage


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, tuple[float, ...]]]) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of several values at once: name -> (value, quantiles) gives name -> results.

    Equal values are counted, the counts get prefix sums in value order without a single task, and only the rows that hold the
    wanted places come to the driver. An error when there are no values or one isn't finite.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, (v, _) in wanted.items()])).alias("x")).select("x.*")
    levels = stage(stacked.groupBy("name", "v").agg(F.count("*").alias("n")), "quantile-levels")
    bad = F.count_if(F.isnan("v") | (F.abs("v") == float("inf")) | F.col("v").isNull())
    totals = {r["name"]: r for r in levels.groupBy("name").agg(F.sum("n").alias("n"), bad.alias("bad")).collect()}  # a row a name
    if set(totals) != set(wanted) or any(r["bad"] for r in totals.values()):
        raise ValueError("a threshold needs at least one score, all of them finite")
    names, before, places = sorted(wanted), 0, {}
    for name in names:
        n = totals[name]["n"]
        for q in wanted[name][1]:
            at = q * (n - 1)
            low = int(at)
            places[name, q] = before + low, before + min(low + 1, n - 1), at - low
        before += n
    placed = with_global_index(levels, [F.col("name"), F.col("v")], "_idx", {"n": "_upto"})
    needed = sorted({p for low, high, _ in places.values() for p in (low, high)})
    holds = F.filter(F.array(*[F.lit(p).cast("long") for p in needed]), lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("n")))
    found = {p: r["v"] for r in placed.withColumn("_at", holds).where(F.size("_at") > 0).select("v", "_at").collect() for p in r["_at"]}
    out: dict[str, list[float]] = {}
    for name in wanted:
        out[name] = [found[low] + (found[high] - found[low]) * share for low, high, share in (places[name, q] for q in wanted[name][1])]
    return out


def quantile(df: DataFrame, value: Column, q: float) -> float:
    return quantiles(df, {"value": (value, (q,))})["value"][0]


def aep_threshold(validation: DataFrame, reference: float, q: float) -> float:
    """Quantile of |score - reference| over validation sessions."""
    return quantile(validation, F.abs(F.col("information_score") - reference), q)


def aep_decision(scores: DataFrame, reference: float, threshold: float) -> DataFrame:
    """Add aep_deviation and aep_anomalous (strictly over the threshold)."""
    deviation = F.abs(F.col("information_score") - F.lit(reference))
    return scores.withColumns({"aep_deviation": deviation, "aep_anomalous": deviation > F.lit(threshold)})


@dataclass(frozen=True)
class FusionCalibration:
    """Mean and population deviation of both component scores on training sessions, and the two cut-offs."""

    aep_mean: float
    aep_sd: float
    density_mean: float
    density_sd: float
    alpha: float
    warning: float = float("inf")
    critical: float = float("inf")


def component_stats(training: DataFrame, alpha: float) -> FusionCalibration:
    r = training.agg(F.avg("aep_deviation").alias("am"), F.stddev_pop("aep_deviation").alias("asd"), F.avg("density_score").alias("dm"), F.stddev_pop("density_score").alias("dsd")).first()
    if r["am"] is None:
        raise ValueError("fusion needs at least one training session")
    return FusionCalibration(r["am"], r["asd"], r["dm"], r["dsd"], alpha)


def fusion_score(scores: DataFrame, c: FusionCalibration) -> DataFrame:
    """Add aep_normalized, density_normalized (0 where the deviation is 0) and hybrid_score, their weighted sum."""
    z = lambda col, mean, sd: (F.col(col) - mean) / sd if sd > 0 else F.lit(0.0)
    a, d = z("aep_deviation", c.aep_mean, c.aep_sd), z("density_score", c.density_mean, c.density_sd)
    return scores.withColumns({"aep_normalized": a, "density_normalized": d, "hybrid_score": c.alpha * a + (1 - c.alpha) * d})


def fusion_thresholds(validation: DataFrame, c: FusionCalibration, warning_q: float, critical_q: float) -> FusionCalibration:
    """The calibration with both cut-offs: true interpolated quantiles of the fused validation scores."""
    return with_cuts(c, *quantiles(fusion_score(validation, c), {"hybrid": (F.col("hybrid_score"), (warning_q, critical_q))})["hybrid"])


def with_cuts(c: FusionCalibration, warning: float, critical: float) -> FusionCalibration:
    return FusionCalibration(c.aep_mean, c.aep_sd, c.density_mean, c.density_sd, c.alpha, warning, critical)


def severity(score: Column, c: FusionCalibration) -> Column:
    """Reaching a cut-off counts."""
    return F.when(score >= c.critical, "CRITICAL").when(score >= c.warning, "WARNING").otherwise("NORMAL")
