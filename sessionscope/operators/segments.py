"""A segmented scan: sessions and running sums of keyed rows in order, whatever share of the rows a client sends.

A client's rows are cut into segments that follow each other in order; a segment and client is what one task holds together. Inside
a segment, breaks between sessions are numbered as if the segment were all there is. A run is what one segment holds of a session.
Only of clients that are cut, runs are summed up to a row each, segments of a client to a row each; what lies before a segment (its client's
last time, the number of breaks, what of the session has gone before) is carried over the borders by windows over those rows alone.

Segments by time (``by_time``) follow from an expression, so nothing but the rows themselves is moved, once, and columns that nobody asks
for are never computed. Segments by range (``by_range``) serve any order, for a written copy of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.staging import stage

MOST_NAMED = 1000  # clients that are cut at most; a client beyond them has under a thousandth of all rows
WHOLE = 0  # the segment of clients that are not cut
FEW = 64  # bounds that are looked at together


def gap_over(before: Column, now: Column, timeout_seconds: float) -> Column:
    """Whether the time from one request to the next is strictly over the timeout."""
    return F.unix_micros(now) - F.unix_micros(before) > F.lit(int(timeout_seconds * 1_000_000))


def by_range(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (session_ip, the columns of ``order``) with _segment, dealt by range of (session_ip, order) and written once."""
    dealt = rows.repartitionByRange("session_ip", *order)
    return stage(dealt.withColumn("_segment", F.spark_partition_id() + 1), "segments")


def _place(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most the value; in two steps, so that few are looked at."""
    if not bounds:
        return F.lit(0)
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    parts = [bounds[i : i + FEW] for i in range(0, len(bounds), FEW)]
    coarse = F.greatest(upto(F.array(*[F.lit(p[0]) for p in parts])) - 1, F.lit(0))
    fine = F.element_at(F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts]), coarse + 1)
    return coarse * FEW + upto(fine)


def by_time(rows: DataFrame) -> DataFrame:
    """Rows (session_ip, ts) with _segment: clients with more rows than a task should have are cut where the times of all rows reach
    the next part of them, as many parts as there are shuffle partitions. Others stay whole. A pass over both columns, summed up to
    a few thousand numbers, tells the bounds and the clients; they decide about work, not about results."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return rows.withColumn("_segment", F.lit(WHOLE))
    second = F.unix_seconds("ts")
    cuts = [i / parts for i in range(1, parts)]
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx(second, cuts, 4 * parts).alias("at"), F.expr(f"approx_top_k(session_ip, {MOST_NAMED}, {10 * MOST_NAMED})").alias("top")).first()
    hot = [x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] > found["n"] / parts]
    if not hot:
        return rows.withColumn("_segment", F.lit(WHOLE))
    return rows.withColumn("_segment", F.when(F.col("session_ip").isin(hot), _place(sorted(set(found["at"])), second) + 1).otherwise(WHOLE))


def scan_sessions(placed: DataFrame, order: list[str], timeout_seconds: float, *, sums: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Rows (session_ip, ts, _segment, the columns of ``order``, sums and flags) with session_no from 1, pos from 0, n_events, session_start
    (the first one's ts), first_seq (the first one's last column of ``order``), upto_<c> for each sum (up to this row, in its
    session) and any_<f> for each flag (in its whole session); without _segment. A client in the segment ``WHOLE`` lies in no other.

    A session ends where the next row, in order, comes over the timeout after. ``order`` should be total.
    """
    place = ["session_ip", "_segment"]
    inside = Window.partitionBy(*place).orderBy(*order)
    breaks = F.coalesce(gap_over(F.lag("ts").over(inside), F.col("ts"), timeout_seconds), F.lit(False))
    marked = placed.withColumn("_new", breaks.cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*place, "_run").orderBy(*order)
    upto, whole = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = marked.withColumns(
        {
            "_place": F.row_number().over(run) - 1, "_run_n": F.count("*").over(whole), "_run_first": F.first("ts").over(whole), "_run_seq": F.first(order[-1]).over(whole),
            **{f"_s_{c}": F.sum(c).over(upto) for c in sums}, **{f"_any_{f}": F.bool_or(f).over(whole) for f in flags},
        }
    )
    # the runs at a segment's ends may go on in another; the rows have their places already, so that nothing moves for this join
    joined = each.join(_borders(marked.where(F.col("_segment") != WHOLE), order, timeout_seconds, sums, flags), place, "left")
    end = F.when(F.col("_run") == 0, F.col("_head")).when(F.col("_run") == F.col("_breaks"), F.col("_tail"))
    joined = joined.withColumn("_end", end)
    over = lambda c, own: F.when(F.col("_end").isNull(), F.col(own)).otherwise(F.col("_end")[c])
    before = lambda c: F.coalesce(F.col("_end")[c], F.lit(0))
    kept = [c for c in placed.columns if c != "_segment"]
    return joined.select(
        *kept, (F.coalesce("_offset", F.lit(1)) + F.col("_run")).cast("int").alias("session_no"), (before("_earlier") + F.col("_place")).cast("int").alias("pos"),
        over("_all", "_run_n").cast("int").alias("n_events"), over("_first", "_run_first").alias("session_start"), over("_seq", "_run_seq").alias("first_seq"),
        *[(before(f"_e_{c}") + F.col(f"_s_{c}")).alias(f"upto_{c}") for c in sums], *[over(f"_any_{f}", f"_any_{f}").alias(f"any_{f}") for f in flags],
    )


def _borders(marked: DataFrame, order: list[str], timeout_seconds: float, sums: tuple[str, ...], flags: tuple[str, ...]) -> DataFrame:
    """A row a client's segment: _offset (the number of its first run's session), _breaks (its last run), and of its first (_head) and
    last run (_tail) what the whole session holds and what of it has gone before."""
    at = F.struct(*order)
    runs = marked.groupBy("session_ip", "_segment", "_run").agg(
        F.count("*").alias("_n"), F.min_by("ts", at).alias("_first"), F.max_by("ts", at).alias("_last"), F.min(at).alias("_at"),
        *[F.sum(c).alias(f"_t_{c}") for c in sums], *[F.bool_or(c).alias(f"_any_{c}") for c in flags],
    )
    segments = runs.groupBy("session_ip", "_segment").agg(F.min_by("_first", "_run").alias("_from"), F.max_by("_last", "_run").alias("_to"), F.max("_run").alias("_breaks"))
    own = Window.partitionBy("session_ip").orderBy("_segment")  # a row a segment that the client lies in
    carried = F.coalesce(gap_over(F.lag("_to").over(own), F.col("_from"), timeout_seconds), F.lit(False)) | F.lag("_segment").over(own).isNull()
    segments = segments.withColumn("_opens", carried.cast("int"))
    upto = F.sum(F.col("_opens") + F.col("_breaks")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_breaks")
    runs = runs.join(segments.select("session_ip", "_segment", "_breaks", upto.alias("_offset")), ["session_ip", "_segment"]).where("_run = 0 or _run = _breaks")
    runs = runs.withColumn("_no", F.col("_offset") + F.col("_run"))
    session = Window.partitionBy("session_ip", "_no")  # a row a segment that the session lies in
    earlier = session.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    begin = session.orderBy("_segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.struct(
        F.sum("_n").over(session).alias("_all"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"),
        F.first("_first").over(begin).alias("_first"), F.first("_at").over(begin)[order[-1]].alias("_seq"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_e_{c}") for c in sums], *[F.bool_or(f"_any_{c}").over(session).alias(f"_any_{c}") for c in flags],
    )
    ends = runs.withColumn("_told", told)
    return ends.groupBy("session_ip", "_segment").agg(F.max("_offset").alias("_offset"), F.max("_breaks").alias("_breaks"), F.min_by("_told", "_run").alias("_head"), F.max_by("_told", "_run").alias("_tail"))
