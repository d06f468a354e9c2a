"""Smoothed categorical model of requests: route group and status category, in bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.config import CATEGORICAL_MODES
from sessionscope.functions.routes import UNKNOWN, status_category
from sessionscope.operators.staging import stage

UNSEEN = "__UNK__"
SESSION_KEY = ("session_ip", "session_no")


def with_features(events: DataFrame) -> DataFrame:
    """url_group and status_category without blanks: 'unknown', and the category of the status."""
    group = F.coalesce(F.nullif(F.trim("url_group"), F.lit("")), F.lit(UNKNOWN))
    computed = status_category(F.coalesce(F.col("status").cast("string"), F.lit(""))) if "status" in events.columns else F.lit(UNKNOWN)
    category = F.coalesce(F.nullif(F.trim("status_category"), F.lit("")), computed)
    return events.withColumns({"url_group": group, "status_category": category})


@dataclass
class CategoricalModel:
    """Observed counts as tables (``pairs``: url_group, status_category, n), and the scalars they are smoothed with."""

    pairs: DataFrame
    smoothing: float
    n_events: int
    n_urls: int  # with the unseen one
    n_statuses: int  # with the unseen one

    def marginal(self, column: str) -> DataFrame:
        """(column, n, p) of all observed values and the unseen one."""
        size = self.n_urls if column == "url_group" else self.n_statuses
        seen = self.pairs.groupBy(column).agg(F.sum("n").alias("n"))
        unseen = self.pairs.sparkSession.sql(f"select '{UNSEEN}' as {column}, 0L as n")
        return seen.unionByName(unseen).withColumn("p", (F.col("n") + self.smoothing) / (self.n_events + self.smoothing * size))

    def statuses(self) -> list[str]:
        """Observed categories and the unseen one: ten at most, by the definition of a category."""
        return sorted(r[0] for r in self.pairs.select("status_category").distinct().collect()) + [UNSEEN]

    def cells(self) -> DataFrame:
        """All cells of groups x categories: (url_group, status_category, n, url_n, p_joint, p_cond)."""
        a = self.smoothing
        urls = self.marginal("url_group").select("url_group", F.col("n").alias("url_n"))
        grid = urls.withColumn("status_category", F.explode(F.array(*[F.lit(s) for s in self.statuses()])))
        cells = grid.join(self.pairs, ["url_group", "status_category"], "left").na.fill(0, ["n"])
        joint = (F.col("n") + a) / (self.n_events + a * self.n_urls * self.n_statuses)
        return cells.withColumns({"p_joint": joint, "p_cond": (F.col("n") + a) / (F.col("url_n") + a * self.n_statuses)})

    def entropies(self) -> dict[str, float]:
        """H(url), H(status), H(pair), and the expected bits a request of each mode. Given the url, observed groups count with their raw share."""
        bits = lambda p: F.sum(-F.col(p) * F.log2(p))
        h_url = self.marginal("url_group").agg(bits("p")).first()[0]
        h_status = self.marginal("status_category").agg(bits("p")).first()[0]
        cells = self.cells()
        h_pair = cells.agg(bits("p_joint")).first()[0]
        given = cells.where("url_n > 0").agg(F.sum(F.col("url_n") / self.n_events * -F.col("p_cond") * F.log2("p_cond"))).first()[0]
        return {"url": h_url, "status": h_status, "independent": h_url + h_status, "joint": h_pair, "status_given_url": h_url + given}


def fit_categorical(events: DataFrame, smoothing: float) -> CategoricalModel:
    """Count groups and categories of training requests; the counts are a small aggregate with partial sums, written once, for
    the model reads them again and again and the requests are read but once."""
    pairs = stage(with_features(events).groupBy("url_group", "status_category").agg(F.count("*").alias("n")), "model-pairs")
    r = pairs.agg(F.sum("n").alias("n"), F.countDistinct("url_group").alias("u"), F.countDistinct("status_category").alias("s")).first()
    if not r["n"]:
        raise ValueError("at least one training request is required")
    return CategoricalModel(pairs, smoothing, r["n"], r["u"] + 1, r["s"] + 1)


def _bits(p: Column) -> Column:
    return -F.log2(p)


def score_requests(events: DataFrame, model: CategoricalModel, mode: str) -> DataFrame:
    """Add url_bits, status_bits and the flags unknown_url, unknown_status. Unseen values count as the reserved one.

    Joins the observed pairs and the group totals only; cells that were never seen follow from the smoothing formula.
    """
    if mode not in CATEGORICAL_MODES:
        raise ValueError(f"mode must be one of {CATEGORICAL_MODES}")
    a, n, u, s = model.smoothing, model.n_events, model.n_urls, model.n_statuses
    urls = model.pairs.groupBy(F.col("url_group").alias("_u")).agg(F.sum("n").alias("_un")).where(F.col("_u") != UNSEEN)
    kinds = model.pairs.groupBy(F.col("status_category").alias("_s")).agg(F.sum("n").alias("_sn")).where(F.col("_s") != UNSEEN)
    cells = model.pairs.select(F.col("url_group").alias("_cu"), F.col("status_category").alias("_cs"), F.col("n").alias("_cn"))
    rows = with_features(events).join(urls, F.col("url_group") == F.col("_u"), "left").join(kinds, F.col("status_category") == F.col("_s"), "left")
    rows = rows.join(cells, (F.col("url_group") == F.col("_cu")) & (F.col("status_category") == F.col("_cs")), "left")
    url_n, status_n, pair_n = (F.coalesce(c, F.lit(0)) for c in ("_un", "_sn", "_cn"))
    p_url = (url_n + a) / (n + a * u)
    p_status = (status_n + a) / (n + a * s)
    p_cond = (pair_n + a) / (url_n + a * s)
    if mode == "joint":
        url_bits, status_bits = _bits((pair_n + a) / (n + a * u * s)), F.lit(0.0)
    else:
        url_bits, status_bits = _bits(p_url), _bits(p_cond if mode == "status_given_url" else p_status)
    flags = {"unknown_url": F.col("_u").isNull(), "unknown_status": F.col("_s").isNull()}
    return rows.withColumns({"url_bits": url_bits, "status_bits": status_bits, **flags}).drop("_u", "_un", "_s", "_sn", "_cu", "_cs", "_cn")


def score_sessions(scored: DataFrame) -> DataFrame:
    """A row a session: events, log_probability, information_score (mean bits), first_bits, and how many values were unseen."""
    bits = F.col("url_bits") + F.col("status_bits")
    return scored.groupBy(*SESSION_KEY).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").cast("int").alias("n_events"),
        (-F.sum(bits)).alias("log_probability"),
        F.avg(bits).alias("information_score"),
        F.min_by(bits, F.struct("ts", "event_seq")).alias("first_bits"),
        F.count_if("unknown_url").cast("int").alias("n_unknown_urls"),
        F.count_if("unknown_status").cast("int").alias("n_unknown_statuses"),
    )


def first_probability(first_bits: Column) -> Column:
    return F.pow(F.lit(2.0), -first_bits)


