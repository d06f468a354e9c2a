"""Labels, confusion and ranking metrics of scored sessions or requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.categorical import SESSION_KEY
from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.staging import stage

# Fixed value: texts of a label that mean an anomaly.
TRUE_WORDS = ("1", "true", "yes", "anomaly", "abnormal")
# Fixed value: columns in which a log says what is an anomaly.
LABELS = ("is_anomaly", "label", "ground_truth")


def allowlist_labels(flagged: DataFrame) -> DataFrame:
    """Session label: any request outside the inventory (neither by_path nor by_name), and how many."""
    outside = ~(F.col("by_path") | F.col("by_name"))
    return flagged.groupBy(*SESSION_KEY).agg(F.bool_or(outside).alias("label"), F.count_if(outside).alias("n_outside"))


def request_label(df: DataFrame) -> Column:
    """From the first non-empty of is_anomaly, label, ground_truth; null if all are empty."""
    names = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in LABELS if n in df.columns]
    raw = F.coalesce(*names, F.lit(None).cast("string"))
    return F.when(raw.isNotNull(), F.lower(F.trim(raw)).isin(*TRUE_WORDS))


def given_labels(events: DataFrame, keys: tuple[str, ...] = SESSION_KEY) -> DataFrame:
    """Session label: any request's, null unless all have one."""
    rows = events.select(*keys, request_label(events).alias("_y"))
    return rows.groupBy(*keys).agg(F.when(F.count("_y") == F.count("*"), F.bool_or("_y")).alias("label"))


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    """TP, TN, FP, FN of boolean columns label and decision and the ratios built on them; empty denominators as defined per ratio."""
    y, p = F.col("label"), F.col("decision")
    counts = scored.groupBy(*by).agg(
        F.count("*").alias("units"), F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    or_zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns(
        {
            "precision": or_zero(tp, tp + fp),
            "recall": or_zero(tp, tp + fn),
            "f1": or_zero(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": F.try_divide(fp, fp + tn),
            "false_negative_rate": F.try_divide(fn, tp + fn),
            "final_score": or_zero(tp, tp + fn + fp),
        }
    )


def roc_auc(scored: DataFrame, score_col: str = "score") -> float | None:
    """P(positive above negative) plus half the ties, over all pairs, from counts per distinct score. Null without both classes."""
    levels = scored.groupBy(F.col(score_col).alias("s")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    placed = with_global_index(levels, [F.col("s")], "_idx", {"neg": "_below"})
    pairs = F.col("pos") * (F.col("_below") - F.col("neg") + F.col("neg") / 2)
    r = placed.agg(F.sum(pairs).alias("pairs"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return r["pairs"] / (r["p"] * r["n"]) if r["p"] and r["n"] else None


def pr_auc(scored: DataFrame, tie_order: list[Column], score_col: str = "score") -> float | None:
    """Average precision by descending score; ties in the given session order. Null without positives."""
    rows = scored.withColumn("_hit", F.col("label").cast("long"))
    placed = with_global_index(rows, [F.col(score_col).desc(), *tie_order], "_idx", {"_hit": "_hits"})
    r = placed.agg(F.sum(F.when(F.col("label"), F.col("_hits") / (F.col("_idx") + 1))).alias("s"), F.sum("_hit").alias("p")).first()
    return r["s"] / r["p"] if r["p"] else None


def rank_areas(scored: DataFrame, by: str, tie_order: list[Column], score_col: str = "score") -> DataFrame:
    """(by, roc_auc, pr_auc) of every value of ``by``, as ``roc_auc`` and ``pr_auc`` give them one by one; one global order for all."""
    rows = scored.withColumns({"_hit": F.col("label").cast("long"), "_miss": (~F.col("label")).cast("long")})
    rows = stage(rows.select(F.col(by).alias("_by"), F.col(score_col).alias("_score"), "label", "_hit", "_miss", *[c.alias(f"_tie{i}") for i, c in enumerate(tie_order)]), "ranked")
    sums = [F.sum("_hit").alias("hits"), F.sum("_miss").alias("misses"), F.count("*").alias("n")]
    totals = rows.groupBy("_by").agg(*sums)
    ahead = Window.orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)  # a row a value of ``by``
    totals = stage(totals.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("hits", "misses", "n")]), "ranked-totals")

    levels = rows.groupBy("_by", "_score").agg(F.sum("_hit").alias("pos"), F.sum("_miss").alias("neg"))
    placed = with_global_index(levels, [F.col("_by"), F.col("_score")], "_idx", {"neg": "_below"}).join(totals, "_by")
    below = F.col("_below") - F.col("misses_ahead") - F.col("neg") + F.col("neg") / 2
    roc = placed.groupBy("_by").agg(F.try_divide(F.sum(F.col("pos") * below), F.first("hits") * F.first("misses")).alias("roc_auc"))

    order = [F.col("_by"), F.col("_score").desc(), *[F.col(f"_tie{i}") for i in range(len(tie_order))]]
    placed = with_global_index(rows, order, "_idx", {"_hit": "_hits"}).join(totals, "_by")
    precision = (F.col("_hits") - F.col("hits_ahead")) / (F.col("_idx") - F.col("n_ahead") + 1)
    pr = placed.groupBy("_by").agg(F.try_divide(F.sum(F.when(F.col("label"), precision)), F.first("hits")).alias("pr_auc"))
    return roc.join(pr, "_by").withColumnRenamed("_by", by)


def request_units(events: DataFrame, sessions: DataFrame, keys: tuple[str, ...] = SESSION_KEY) -> DataFrame:
    """A unit per request: its own label with its session's score and decision. ``events`` has a boolean label."""
    return events.select(*keys, "event_seq", "label").join(sessions.select(*keys, "score", "decision"), list(keys))


def mode_comparison(report: DataFrame) -> DataFrame:
    """Per mode: sessions, positives, alerts, their rate, positives found, and severities. ``report`` has label, anomalous, severity."""
    counts = report.groupBy("mode").agg(
        F.count("*").alias("sessions"),
        F.count_if("label").alias("positives"),
        F.count_if("anomalous").alias("alerts"),
        F.count_if(F.col("label") & F.col("anomalous")).alias("detected"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
    )
    return counts.withColumn("alert_rate", F.col("alerts") / F.col("sessions"))
