"""Mixing sources to target weights by hash thresholds.

Every document gets a fixed hash. A source whose target is ``e`` times its size plus a remainder takes
all its documents ``e`` times and, once more, those whose hash lies below a threshold. Thresholds come
from histograms: words are summed by source and hash bucket, the bucket in which the budget runs out is
found, and only that bucket is summed again, 4,096 times finer, until it holds one hash. Nothing is sorted,
a larger budget always contains what a smaller one took, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
STEP_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5, so that SQL elsewhere can repeat it."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets of all sources from (source, source_size): weights repeat along the sources by code point,
    null last; nobody gets over ``cap`` times its size; what that leaves is shared again by weight.

    Each round fixes the sources that would exceed their cap and shares the rest among the others. It ends
    when a round caps nobody, and works on a row a source.
    """
    n = len(weights)
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("idx"), F.lit(n)) + 1).cast("int"))
    state = stage(with_global_index(sizes, order, "idx").select("source", "source_size", weight.alias("w")), "mix-sources")
    most = F.lit(cap) * F.col("source_size")
    level = None  # words a unit of weight
    while True:
        capped = F.lit(False) if level is None else F.col("w") * F.lit(level) > most
        r = state.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, most).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("open"),
        ).first()
        new = (r["all"] - r["fixed"]) / r["open"] if r["open"] else level
        if new is None or new == level:
            break
        level = new
    share = F.least(F.col("w") * F.lit(level or 0.0), most.cast("double"))
    return state.select("source", "source_size", share.alias("target"))


def hash_threshold_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns id, ``size`` (words; null text 0), ``source``, ``source_size``, ``target`` of the source, ``copies``
    (0 to ``cap``) and ``taken`` = size x copies. A null source is a source of its own, the last. Documents
    with one hash (repeated ids) are taken or left together; the one group of equal hashes in which a budget
    ends is taken when that brings the source nearer to its target. Empty tables give empty results.
    """
    meta = stage(
        docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), document_hash(F.col(id_col)).alias("hash")),
        "mix-meta",
    )
    sizes = meta.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    whole = F.least(whole, F.lit(cap))
    goal = F.col("target") - whole * F.col("source_size")
    plan = targets.select("source", "source_size", "target", whole.alias("whole"), F.when(whole >= cap, 0.0).otherwise(goal).alias("goal"))
    # lo..hi: the hashes in which the budget of the source runs out; below: words of the hashes under lo
    state = stage(plan.select("*", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside")), "mix-plan")
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        span = 1 << (bits + STEP_BITS)
        rows = meta.join(state.select(F.col("source").alias("s"), "lo"), F.col("source").eqNullSafe(F.col("s")))
        sums = (
            rows.where((F.col("hash") >= F.col("lo")) & (F.col("hash") < F.col("lo") + F.lit(span)))
            .groupBy("s", F.shiftright(F.col("hash") - F.col("lo"), bits).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        sums = sums.join(state.select(F.col("source").alias("t"), "lo", "below", "goal"), F.col("s").eqNullSafe(F.col("t")))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket")) + F.col("below")
        end = (
            sums.withColumn("upto", upto)
            .where("upto > goal")
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "words", "upto", "lo")).alias("b"))
            .select("s", (F.col("b.lo") + F.shiftleft(F.col("b.bucket"), bits)).alias("lo2"), (F.col("b.upto") - F.col("b.words")).alias("below2"), F.col("b.words").alias("inside2"))
        )
        joined = state.join(end, F.col("source").eqNullSafe(F.col("s")), "left")
        state = stage(
            joined.select("source", "source_size", "target", "whole", "goal", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("below2", "below").alias("below"), F.coalesce("inside2", "inside").alias("inside")),
            "mix-plan",
        )
    # now lo is a single hash: take it too where that is nearer
    nearer = (F.col("below") + F.col("inside") - F.col("goal")) < (F.col("goal") - F.col("below"))
    limit = F.when(F.col("goal") <= 0, 0).when(nearer, F.col("lo") + 1).otherwise(F.col("lo"))
    cuts = state.select(F.col("source").alias("s"), "source_size", "target", "whole", limit.cast("long").alias("limit"))
    copies = (F.col("whole") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)).cast("int")
    return (
        meta.join(cuts, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", copies)
        .select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    )
