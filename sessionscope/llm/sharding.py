"""K-d tree sharding by bytes.

The tree splits the metadata space of a table: at every node the widest dimension is cut at a weighted
quantile of the rows' bytes (the median, or the fraction its number of leaves asks for when that is odd)
until every leaf holds about the target bytes. Only a narrow metadata table is moved; texts are read once
to take their size and are never shuffled.

A cut is found without sorting: bytes are summed into ``bins`` equal ranges of the composite key
(coordinate, hash of the row), and only the range that holds the quantile is summed again, finer. The
hash part splits rows that share a coordinate, so a value that holds a third of all rows is cut like
any other. Equal texts have one place: the least metadata of their group and a hash of the text, and cuts fall on borders
between texts. Only a group that holds more than ``slack`` of a shard may be cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.staging import literal_rows, stage

AXIS = 1 << 30  # positions along a dimension
FINE = 1 << 32  # positions of the hash below a coordinate
ROWS = 1 << 10  # so many of them, the last bits, tell rows of one text apart


@dataclass(frozen=True)
class Dimension:
    """A metadata column. ``number`` columns keep their order; ``category`` values lie at their hash."""

    column: str
    kind: str = "category"


DOCUMENT_DIMENSIONS = (Dimension("source"), Dimension("lang"), Dimension("n_chars", "number"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 8; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _coordinate(i: int, d: Dimension, low: float | None, high: float | None) -> Column:
    if d.kind == "category":
        return F.pmod(F.xxhash64(F.col(f"d{i}")), F.lit(AXIS)).cast("long")
    if low is None or high is None or high <= low:
        return F.lit(0).cast("long")
    at = (F.col(f"d{i}") - F.lit(low)) / F.lit(high - low) * F.lit(AXIS - 1)
    return F.coalesce(F.floor(at), F.lit(0)).cast("long")


def _key(dim: Column) -> Column:
    return F.element_at("coords", dim + 1) * F.lit(FINE) + F.col("fine")


def _at_nodes(rows: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """Follow the cuts found so far. Each level's table has at most as many rows as there are shards."""
    for cuts in levels:
        table = literal_rows(rows.sparkSession, cuts, "node int, dim int, cut bigint, low_node int, high_node int")
        to = F.when(_key(F.col("dim")) < F.col("cut"), F.col("low_node")).otherwise(F.col("high_node"))
        rows = (
            rows.join(F.broadcast(table), "node", "left")
            .withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(to))
            .drop("dim", "cut", "low_node", "high_node")
        )
    return rows


def _weighted_cuts(rows: DataFrame, jobs: list[dict], bins: int, enough: float, slack: float) -> None:
    """Give each job (a node with dim, lo, hi, goal) its ``cut``: keys below it hold about ``goal`` bytes. A cut lies between texts
    unless those at the goal hold more than ``slack`` bytes."""
    todo = jobs
    while todo:
        for j in todo:
            j["width"] = -(-(j["hi"] - j["lo"] + 1) // bins)
            if j["hi"] - j["lo"] + 1 > ROWS:
                j["width"] = -(-j["width"] // ROWS) * ROWS
        table = literal_rows(
            rows.sparkSession,
            [(j["node"], j["dim"], j["lo"], j["hi"], j["width"], float(j["goal"]), j["below"]) for j in todo],
            "node int, dim int, lo bigint, hi bigint, width bigint, goal double, below bigint",
        )
        inside = rows.join(F.broadcast(table), "node").withColumn("key", _key(F.col("dim")))
        sums = (
            inside.where("key between lo and hi")
            .groupBy("node", "goal", "below", F.expr("(key - lo) div width").alias("bin"))
            .agg(F.sum("size").alias("bytes"))
        )
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")) + F.col("below")
        first = (
            sums.withColumn("upto", upto)
            .where("upto >= goal")
            .groupBy("node")
            .agg(F.min(F.struct("bin", "bytes", "upto")).alias("b"))
            .select("node", "b.*")
        )
        found = {r["node"]: r for r in first.collect()}  # a row a node, at most as many as shards
        left = []
        for j in todo:
            r = found[j["node"]]
            j["lo"], j["below"] = j["lo"] + r["bin"] * j["width"], r["upto"] - r["bytes"]
            j["hi"] = min(j["hi"], j["lo"] + j["width"] - 1)
            if j["width"] > ROWS and r["bytes"] > enough or 1 < j["width"] <= ROWS and r["bytes"] > (slack if j["width"] == ROWS else enough):
                left.append(j)
            else:
                nearer_below = j["goal"] - j["below"] < r["upto"] - j["goal"]
                j["cut"] = j["lo"] if nearer_below else j["hi"] + 1
        todo = left


def kd_tree_shards(
    docs: DataFrame,
    *,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[Dimension, ...] = DOCUMENT_DIMENSIONS,
    bins: int = 4096,
    tolerance: float = 1e-3,
    slack: float = 0.02,
    slot_parts: int = 64,
) -> DataFrame:
    """Put every row into a shard of about ``target_bytes`` (or into ``shards`` of them).

    Returns id, ``size`` (UTF-8 bytes + 8), ``text_crc32`` (of the UTF-8 text, unsigned; null text as
    empty), ``shard`` from 0, and ``slot``, gapless from 0 within a shard. Each cut misses its share by at
    most ``tolerance`` of a shard, half its ``slack`` or one row. A null in a dimension lies at its own place (numbers: at 0).
    Copies (rows of equal length, CRC and 64-bit hash of the text) lie at the least of each of their dimensions and share a
    shard; only a group of more bytes than ``slack`` of a shard may be cut, by ids. An empty table gives an empty result. Other columns of ``docs`` play no part.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    spark = docs.sparkSession
    dims = [F.col(d.column).cast("double" if d.kind == "number" else "string").alias(f"d{i}") for i, d in enumerate(dimensions)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    meta = stage(docs.select(F.col(id_col).alias("id"), text_size(F.col(text_col)).alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("x"), *dims), "kd-meta")
    numbers = [i for i, d in enumerate(dimensions) if d.kind == "number"]
    finite = lambda i: F.when(~F.isnan(f"d{i}") & (F.abs(F.col(f"d{i}")) < 1e300), F.col(f"d{i}"))
    meta = meta.withColumns({f"d{i}": finite(i) for i in numbers}) if numbers else meta
    root = meta.agg(F.sum("size").alias("bytes"), *[F.min(f"d{i}").alias(f"lo{i}") for i in numbers], *[F.max(f"d{i}").alias(f"hi{i}") for i in numbers]).first()
    total = root["bytes"] or 0
    shards = shards or max(1, round(total / target_bytes))
    coords = F.array(*[_coordinate(i, d, root[f"lo{i}"] if i in numbers else None, root[f"hi{i}"] if i in numbers else None) for i, d in enumerate(dimensions)])
    at_all = [f"d{i}" for i in range(len(dims))]
    of_row = F.pmod(F.xxhash64("id", *at_all), F.lit(ROWS))
    fine = (F.pmod(F.xxhash64("x", "crc", "size"), F.lit(FINE // ROWS)) * ROWS + of_row).cast("long")
    # copies take the least of each dimension; counted before they move, and looked up only where they differ
    known = [x for d in at_all for x in (F.min(d).alias(f"least_{d}"), F.max(d).alias(f"most_{d}"), F.count(d).alias(f"n_{d}"))]
    groups = meta.groupBy("crc", "size", "x").agg(F.count("*").alias("copies"), *known)
    unlike = [(F.col(f"least_{d}") != F.col(f"most_{d}")) | (F.col(f"n_{d}") > 0) & (F.col(f"n_{d}") < F.col("copies")) for d in at_all]
    groups = groups.where(reduce(lambda a, b: a | b, [F.coalesce(u, F.lit(False)) for u in unlike]))
    groups = groups.select(F.col("crc").alias("_c"), F.col("size").alias("_s"), F.col("x").alias("_x"), *[f"least_{d}" for d in at_all], F.lit(True).alias("_unlike"))
    met = meta.withColumn("fine", fine).join(groups, (F.col("crc") == F.col("_c")) & (F.col("size") == F.col("_s")) & (F.col("x") == F.col("_x")), "left")
    met = met.withColumns({d: F.when(F.col("_unlike"), F.col(f"least_{d}")).otherwise(F.col(d)) for d in at_all})
    rows = stage(met.select("id", "size", "crc", coords.alias("coords"), "fine"), "kd-rows").withColumn("node", F.lit(0))

    nodes = {0: (0, shards)}  # node: first shard, number of shards
    levels: list[list[tuple]] = []
    extent: list[int] | None = None
    open_nodes = [0] if shards > 1 and total else []
    while open_nodes:
        here = _at_nodes(rows, levels)
        at = range(len(dimensions))
        spread = here.groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[F.min(F.element_at("coords", i + 1)).alias(f"lo{i}") for i in at],
            *[F.max(F.element_at("coords", i + 1)).alias(f"hi{i}") for i in at],
        )
        stats = {r["node"]: r for r in spread.collect()}  # a row a node
        if extent is None:
            extent = [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in at]
        jobs = []
        for n in open_nodes:
            if n in stats:
                r, (_, k) = stats[n], nodes[n]
                dim = max(at, key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / extent[i], -i))
                jobs.append({"node": n, "dim": dim, "lo": r[f"lo{dim}"] * FINE, "hi": r[f"hi{dim}"] * FINE + FINE - 1, "goal": r["bytes"] * (k // 2) / k, "below": 0})
        _weighted_cuts(here, jobs, bins, tolerance * total / shards, slack * total / shards)
        cuts, next_open = [], []
        for j in jobs:
            first, k = nodes[j["node"]]
            low, high = len(nodes), len(nodes) + 1
            nodes[low], nodes[high] = (first, k // 2), (first + k // 2, k - k // 2)
            cuts.append((j["node"], j["dim"], j["cut"], low, high))
            next_open += [n for n in (low, high) if nodes[n][1] > 1]
        levels.append(cuts)
        open_nodes = next_open

    leaves = literal_rows(spark, [(n, first) for n, (first, _) in nodes.items()], "node int, shard int")
    placed = _at_nodes(rows, levels).join(F.broadcast(leaves), "node").withColumn("part", F.pmod(F.col("fine"), F.lit(slot_parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards x slot_parts rows at most
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("fine", "id", "crc"))
    return (
        placed.join(F.broadcast(offsets), ["shard", "part"])
        .withColumn("slot", (F.col("offset") + rank - 1).cast("long"))
        .select(F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.col("shard").cast("int"), "slot")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the texts themselves, one folder a shard, in slot order within a file."""
    placed = docs.join(shards.select(id_col, "shard", "slot"), id_col)
    placed.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
