"""Saved detectors: small Parquet tables and one row of scalars, in versions that count once they are committed.

A version is a folder of its own, written first; a row in ``commits`` makes it the model. So a reader never sees a mixture, and a
model can be saved where it was loaded from.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.config import SessionConfig
from sessionscope.operators.categorical import CategoricalModel
from sessionscope.operators.density import ORDER, DensityModel
from sessionscope.operators.markov import MarkovModel
from sessionscope.operators.thresholds import FusionCalibration

SCHEMA_VERSION = 2
ENCODING_VERSION = 5


@dataclass
class Detector:
    """Everything that scoring a session needs."""

    config: SessionConfig
    model: CategoricalModel | MarkovModel
    reference: float
    aep_threshold: float
    density: DensityModel
    density_threshold: float
    fusion: FusionCalibration
    created_at: str = ""


def committed_version(spark: SparkSession, path: str) -> str | None:
    """The last committed version of the model under ``path``, if there is one."""
    try:
        return spark.read.schema("version string").parquet(f"{path}/commits").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_model(detector: Detector, path: str) -> str:
    """Write the model's count tables, ``density`` and ``meta`` as a new version under ``path`` and commit it; gives its name."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    spark = _write_version(detector, f"{path}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def _write_version(detector: Detector, path: str) -> SparkSession:
    m, d = detector.model, detector.density
    if isinstance(m, MarkovModel):
        tables = {"states": m.states, "steps": m.steps}
        scalars = {"smoothing": m.smoothing, "k": m.k, "n_sequences": m.n_sequences}
    else:
        tables = {"pairs": m.pairs}
        scalars = {"smoothing": m.smoothing, "n_events": m.n_events, "n_urls": m.n_urls, "n_statuses": m.n_statuses}
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    rows = list(zip(d.cells.tolist(), d.moments.tolist(), strict=True))  # occupied cells of the density
    spark.createDataFrame(rows, "cell bigint, moments array<double>").write.parquet(f"{path}/density")
    meta = {
        "schema_version": SCHEMA_VERSION,
        "encoding_version": ENCODING_VERSION,
        "created_at": detector.created_at,
        "config": asdict(detector.config),
        "model": scalars,
        "scalars": {"reference": detector.reference, "aep_threshold": detector.aep_threshold, "n_scores": d.n, "bandwidth": d.bandwidth, "epsilon": d.epsilon, "density_threshold": detector.density_threshold},
        "fusion": asdict(detector.fusion),
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")
    return spark


def load_model(spark: SparkSession, path: str, version: str | None = None) -> Detector:
    """Read a detector back, the last committed version or a given one; refuses other schemas, and tables whose probabilities aren't
    finite, positive and summing to one."""
    version = version or committed_version(spark, path)
    if version is None:
        raise ValueError(f"no model has been committed under {path}")
    path = f"{path}/versions/{version}"
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if (meta["schema_version"], meta["encoding_version"]) != (SCHEMA_VERSION, ENCODING_VERSION):
        raise ValueError("the model was saved with another schema or state encoding")
    config = SessionConfig(**meta["config"] | {"state_fields": tuple(meta["config"]["state_fields"])})
    s, m = meta["scalars"], meta["model"]
    model: CategoricalModel | MarkovModel
    if config.model == "markov":
        model = MarkovModel(spark.read.parquet(f"{path}/states"), spark.read.parquet(f"{path}/steps"), m["smoothing"], m["k"], m["n_sequences"])
        check_probabilities(model.initial(), "p_initial")
        check_rows(model)
    else:
        model = CategoricalModel(spark.read.parquet(f"{path}/pairs"), m["smoothing"], m["n_events"], m["n_urls"], m["n_statuses"])
        check_probabilities(model.marginal("url_group"), "p")
        check_probabilities(model.marginal("status_category"), "p")
        check_probabilities(model.cells(), "p_joint")
    table = spark.read.parquet(f"{path}/density").orderBy("cell").toPandas()
    density = DensityModel(table["cell"].to_numpy(np.int64), np.array(table["moments"].to_list(), float).reshape(len(table), -1), s["n_scores"], s["bandwidth"], s["epsilon"])
    if density.moments.shape[1:] != (ORDER,) or not (np.isfinite(density.moments).all() and density.bandwidth > 0):
        raise ValueError("the saved density is not valid")
    return Detector(config, model, s["reference"], s["aep_threshold"], density, s["density_threshold"], FusionCalibration(**meta["fusion"]), meta["created_at"])


def check_rows(model: MarkovModel) -> None:
    """Every counted row's probabilities, with those of its other cells, sum to one."""
    rows = model.transitions().groupBy("from_state").agg(F.sum("p").alias("s"), F.min("p").alias("lo"), F.first("p_default").alias("d"), F.count("*").alias("cells"))
    total = F.col("s") + (model.k - F.col("cells")) * F.col("d")
    if not rows.where((F.abs(total - 1) > 1e-6) | ~(F.col("lo") > 0) | total.isNull()).isEmpty():
        raise ValueError("saved probabilities must be finite, positive and sum to 1")


def check_probabilities(table: DataFrame, p: str) -> None:
    r = table.agg(F.sum(p).alias("s"), F.min(p).alias("lo"), F.count_if(F.isnan(p) | F.col(p).isNull()).alias("bad")).first()
    if r["bad"] or not r["lo"] > 0 or abs(r["s"] - 1) > 1e-6:
        raise ValueError("saved probabilities must be finite, positive and sum to 1")
