"""First-order Markov model of state sequences, smoothed, with a reserved state for what was never seen.

Counts stay sparse; every cell that was not counted is smoothing / (row total + smoothing x K), K states
with the reserved one among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.categorical import UNSEEN
from sessionscope.operators.staging import stage


@dataclass
class MarkovModel:
    """``states`` (state, n_first, n_from), ``steps`` (from_state, to_state, n), K, number of sequences."""

    states: DataFrame
    steps: DataFrame
    smoothing: float
    k: int
    n_sequences: int

    def initial(self) -> DataFrame:
        total = self.n_sequences + self.smoothing * self.k
        return self.states.select("state", ((F.col("n_first") + self.smoothing) / total).alias("p_initial"))

    def transitions(self) -> DataFrame:
        """Counted cells with their probabilities, and each row's probability of a cell that was not counted."""
        totals = self.states.select(F.col("state").alias("from_state"), "n_from")
        row = F.col("n_from") + self.smoothing * self.k
        return self.steps.join(totals, "from_state").select("from_state", "to_state", "n", ((F.col("n") + self.smoothing) / row).alias("p"), (F.lit(self.smoothing) / row).alias("p_default"))


def fit_markov(sequences: DataFrame, smoothing: float, keys: tuple[str, ...] = ("session_ip", "session_no"), pos_col: str = "pos", state_col: str = "state_id") -> MarkovModel:
    """Count first states and adjacent pairs inside each sequence. A state named like the reserved one is the reserved one."""
    rows = sequences.select(*keys, F.col(pos_col).alias("pos"), F.col(state_col).alias("state"))
    step = rows.withColumn("to_state", F.lead("state").over(Window.partitionBy(*keys).orderBy("pos")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) == 1
    step = step.withColumn("first", first)
    pairs = step.where("to_state is not null").groupBy(F.col("state").alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    seen = step.groupBy("state").agg(F.count_if("first").alias("n_first"), F.count("to_state").alias("n_from"))
    reserved = sequences.sparkSession.sql(f"select '{UNSEEN}' as state, 0L as n_first, 0L as n_from")
    states = seen.unionByName(reserved).groupBy("state").agg(F.sum("n_first").alias("n_first"), F.sum("n_from").alias("n_from"))
    states, pairs = stage(states, "markov-states"), stage(pairs, "markov-steps")
    r = states.agg(F.count("*").alias("k"), F.sum("n_first").alias("n")).first()
    if not r["n"]:
        raise ValueError("at least one non-empty training sequence is required")
    return MarkovModel(states, pairs, smoothing, r["k"], r["n"])


def stationary(model: MarkovModel, dense_limit: int = 500, tolerance: float = 1e-10, most_rounds: int = 600) -> DataFrame:
    """(state, pi) with pi P = pi. Up to ``dense_limit`` states solved on the driver, beyond on Spark by ``stationary_sparse``."""
    spark, a, k = model.states.sparkSession, model.smoothing, model.k
    if k <= dense_limit:
        rows = sorted((r["state"], r["n_from"]) for r in model.states.collect())
        at = {s: i for i, (s, _) in enumerate(rows)}
        p = np.array([[a / (n + a * k)] * k for _, n in rows])
        for r in model.steps.collect():
            i, j = at[r["from_state"]], at[r["to_state"]]
            p[i, j] = (r["n"] + a) / (rows[i][1] + a * k)
        pi = solve_stationary(p)
        return spark.createDataFrame([(s, float(x)) for (s, _), x in zip(rows, pi, strict=True)], "state string, pi double")
    return stationary_sparse(model, tolerance, most_rounds)


def _flow(model: MarkovModel, table: DataFrame, column: str) -> DataFrame:
    """(to_state, flow): what the counted cells carry of a column of ``table`` (state, row, ...)."""
    held = table.select("state", "row", F.col(column).alias("_x"))
    return model.steps.join(held, F.col("from_state") == F.col("state")).groupBy("to_state").agg(F.sum(F.col("_x") * F.col("n") / F.col("row")).alias("_flow"))


def stationary_sparse(model: MarkovModel, tolerance: float = 1e-10, most_rounds: int = 600, basis: int = 24) -> DataFrame:
    """(state, pi) of a chain of any size by GMRES over Spark tables; the driver sees a few numbers a round.

    Smoothing gives every state the same amount, so it stays out of the matrix: with Q the counted cells alone, pi is y (I - Q) = 1
    brought to the sum 1. A Krylov space takes in single slow directions, as of nearly periodic chains, one by one, where rounds
    of the chain itself would wait for them to fade. The space is thrown away after ``basis`` rounds and built again from the best y.
    """
    a, k, rounds = model.smoothing, model.k, 0
    table = stage(model.states.select("state", (F.col("n_from") + a * k).alias("row"), F.lit(1.0 / k).alias("y")), "markov-y")
    dot = lambda x, z: F.sum(x * z)
    while True:
        moved = table.join(_flow(model, table, "y"), F.col("state") == F.col("to_state"), "left")
        moved = stage(moved.select("state", "row", "y", F.coalesce("_flow", F.lit(0.0)).alias("flow")), "markov-moved")
        # pi P - pi, largest part, with what smoothing gives kept apart
        mass = moved.agg(F.sum("y").alias("y"), F.sum(F.col("y") * a / F.col("row")).alias("given")).first()
        left = moved.agg(F.max(F.abs((F.col("flow") + mass["given"] - F.col("y")) / mass["y"]))).first()[0]
        if left < tolerance:
            return moved.select("state", (F.col("y") / mass["y"]).alias("pi"))
        if rounds >= most_rounds or not np.isfinite(left):
            raise ArithmeticError("the stationary distribution did not settle")
        rest = F.lit(1.0 / k) - F.col("y") + F.col("flow")
        size = float(np.sqrt(moved.agg(dot(rest, rest)).first()[0]))
        if size == 0:
            raise ArithmeticError("the stationary distribution did not settle")
        table = stage(moved.select("state", "row", "y", (rest / size).alias("v0")), "markov-basis")
        h, names = np.zeros((basis + 1, basis)), ["v0"]
        for j in range(basis):
            rounds += 1
            v = [F.col(c) for c in names]
            joined = table.join(_flow(model, table, names[-1]), F.col("state") == F.col("to_state"), "left")
            grown = stage(joined.select("state", "row", "y", *names, (v[-1] - F.coalesce("_flow", F.lit(0.0))).alias("w")), "markov-basis")
            first = [x or 0.0 for x in grown.agg(*[dot(F.col("w"), c) for c in v]).first()]
            w = F.col("w") - sum((F.lit(x) * c for x, c in zip(first, v, strict=True)), F.lit(0.0))
            *second, square = grown.agg(*[dot(w, c) for c in v], dot(w, w)).first()  # once more, against rounding
            w = w - sum((F.lit(x) * c for x, c in zip(second, v, strict=True)), F.lit(0.0))
            length = float(np.sqrt(max(square - sum(x * x for x in second), 0.0)))
            h[: j + 1, j], h[j + 1, j] = np.add(first, second), length
            target = np.append(size, np.zeros(j + 1))
            weights, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], target, rcond=None)
            small = np.linalg.norm(h[: j + 2, : j + 1] @ weights - target) < 0.1 * tolerance
            if length < 1e-14 or small or rounds >= most_rounds or j == basis - 1:
                break
            names.append(f"v{j + 1}")
            table = grown.select("state", "row", "y", *names[:-1], (w / length).alias(names[-1]))
        best = F.col("y") + sum((F.lit(float(x)) * F.col(c) for x, c in zip(weights, names, strict=False)), F.lit(0.0))
        table = stage(grown.select("state", "row", best.alias("y")), "markov-y")


def solve_stationary(p: np.ndarray) -> np.ndarray:
    """The probability vector that P leaves as it is; an error when the solution isn't one."""
    k = len(p)
    system = np.vstack([p.T - np.eye(k), np.ones(k)])
    pi, *_ = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)
    pi = np.maximum(pi, 0.0)
    pi /= pi.sum()
    if not np.isfinite(pi).all() or np.abs(pi @ p - pi).max() > 1e-9:
        raise ArithmeticError("the stationary distribution has no valid solution")
    return pi


def entropy_rate(model: MarkovModel, pi: DataFrame) -> float:
    """Bits a step over all K x K cells: counted cells one by one, the others of a row by number."""
    cells = model.transitions().groupBy("from_state").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count("*").alias("cells"))
    rows = model.states.join(pi, "state").join(cells, F.col("state") == F.col("from_state"), "left")
    default = F.lit(model.smoothing) / (F.col("n_from") + model.smoothing * model.k)
    rest = (model.k - F.coalesce("cells", F.lit(0))) * (-default * F.log2(default))
    return rows.agg(F.sum(F.col("pi") * (F.coalesce("h", F.lit(0.0)) + rest))).first()[0]


def score_steps(sequences: DataFrame, model: MarkovModel, keys: tuple[str, ...] = ("session_ip", "session_no"), pos_col: str = "pos", state_col: str = "state_id") -> DataFrame:
    """Every event with the probability of its state given the one before (of the first: at the start), and whether it was never seen."""
    a, k = model.smoothing, model.k
    known = model.states.where(F.col("state") != UNSEEN).select(F.col("state").alias("_known"), F.col("n_first").alias("_nf"))
    rows = sequences.join(known, F.col(state_col) == F.col("_known"), "left").withColumns({"unknown_state": F.col("_known").isNull(), "scored_state": F.coalesce("_known", F.lit(UNSEEN))})
    rows = rows.withColumn("previous_state", F.lag("scored_state").over(Window.partitionBy(*keys).orderBy(pos_col)))
    totals = model.states.select(F.col("state").alias("_from"), F.col("n_from").alias("_total"))
    cells = model.steps.select(F.col("from_state").alias("_cf"), F.col("to_state").alias("_ct"), F.col("n").alias("_cn"))
    rows = rows.join(totals, F.col("previous_state") == F.col("_from"), "left")
    rows = rows.join(cells, (F.col("previous_state") == F.col("_cf")) & (F.col("scored_state") == F.col("_ct")), "left")
    start = (F.coalesce("_nf", F.lit(0)) + a) / (model.n_sequences + a * k)
    step = (F.coalesce("_cn", F.lit(0)) + a) / (F.col("_total") + a * k)
    return rows.withColumn("p", F.when(F.col("previous_state").isNull(), start).otherwise(step)).drop("_known", "_nf", "_from", "_total", "_cf", "_ct", "_cn")


def score_sequences(steps: DataFrame, keys: tuple[str, ...] = ("session_ip", "session_no"), pos_col: str = "pos") -> DataFrame:
    """A row a sequence: log_probability, information_score, p_initial, number of unseen states; first and last time where there is one."""
    times = [F.min("ts").alias("start_time"), F.max("ts").alias("end_time")] if "ts" in steps.columns else []
    return steps.groupBy(*keys).agg(
        *times,
        F.count("*").cast("int").alias("n_events"),
        F.sum(F.log2("p")).alias("log_probability"),
        (-F.avg(F.log2("p"))).alias("information_score"),
        F.min_by("p", pos_col).alias("p_initial"),
        F.count_if("unknown_state").cast("int").alias("n_unknown_states"),
    )


def least_probable_transitions(steps: DataFrame, n: int = 5, keys: tuple[str, ...] = ("session_ip", "session_no"), pos_col: str = "pos") -> DataFrame:
    """The n least probable steps of each sequence, ties by position."""
    order = Window.partitionBy(*keys).orderBy("p", pos_col)
    ranked = steps.where("previous_state is not null").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select(*keys, "rank", pos_col, F.col("previous_state").alias("from_state"), F.col("scored_state").alias("to_state"), "p")


