"""The trie of conversation prefixes: how many conversations share which beginnings, and what sharing them saves.

A node of depth d is a distinct sequence of d turns, named by its depth and the least id of the conversations that begin with it.
It is made level by level: the conversations of a node that more than one conversation shares are live, and are grouped by
(node, next turn); a group is a node of the next level. A conversation that is alone in its node has only nodes of its own from there
on; these follow from its turns in one pass, so the number of levels is that of the longest shared beginning and not of the longest
conversation. Then level by level, from the deepest on, what lies below each node is added up.

A turn is known by the SHA-256 of role and text. Turns are numbered by a global order, and groups are counted before they
move, so neither a conversation nor a beginning that holds a third of all rows lands in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.arrow import map_batches
from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.staging import shared_dir, stage

NO_ENDS = hashlib.sha256(b"").hexdigest()
HEADS = 9  # so many numbers of turns, from 0 on, that a rebuilt conversation may take from another one
FAMILY = 5


@dataclass
class Sequences:
    """convs: conv_id, n_turns. steps: conv_id, depth (from 1), turn (digest), bytes (of its text), sorted by depth."""

    convs: DataFrame
    steps: DataFrame


@dataclass
class Trie:
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. members: conv_id, end_depth, end_node, n_convs
    (of the node): the node in which each conversation ends."""

    nodes: DataFrame
    members: DataFrame


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, turn, bytes), (conv_id, n_own)): turns in order, null numbers first, equal numbers by their digest. Rows without
    conv_id take no part; a null role or text is empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_no"), turn.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    placed = stage(with_global_index(rows, [F.col("conv_id"), F.asc_nulls_first("_no"), F.col("turn")], "_at"), "turns")
    convs = stage(placed.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count("*").alias("n_own")), "conversations")
    turns = placed.join(convs, "conv_id").select("conv_id", (F.col("_at") - F.col("_first")).alias("pos"), F.unhex("turn").alias("turn"), "bytes")
    return turns, convs.select("conv_id", "n_own")


def _sequences(convs: DataFrame, steps: DataFrame) -> Sequences:
    return Sequences(convs, stage(steps.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "steps"))


def sequences(conversations: DataFrame) -> Sequences:
    """Conversations (conv_id, turn, role, text) as they are."""
    turns, convs = _turns(conversations)
    return _sequences(convs.withColumnRenamed("n_own", "n_turns"), turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "turn", "bytes"))


def rebuild(conversations: DataFrame) -> Sequences:
    """Every conversation c rebuilt: the first h turns of c - c % 5 (all, if fewer; none, if absent), then its own after its first h;
    h is crc32 of c's decimal digits modulo 9."""
    turns, own = _turns(conversations)
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = own.withColumns({"base": base, "h": h})
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stage(convs.withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "rebuilt")
    shared = turns.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "turn", "bytes")
    heads = convs.where("h > 0").join(shared, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn", "bytes")
    rest = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head") + 1).alias("depth"), "turn", "bytes")
    return _sequences(convs.select("conv_id", "n_turns"), heads.unionByName(rest))


LEVEL = "conv_id bigint, n_turns bigint, parent bigint, node bigint, n bigint, bytes bigint"
ROLLED = "conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def build_trie(found: Sequences) -> Trie:
    """The trie of sequences. An empty table has no nodes; conversations without turns belong to the root."""
    spark = found.convs.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"

    def level(d: int) -> DataFrame:
        return spark.read.schema(LEVEL).parquet(f"{folder}/levels/depth={d}")

    everyone = found.convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
    root = found.convs.crossJoin(F.broadcast(everyone))  # one row
    root.select("conv_id", "n_turns", F.lit(None).cast("long").alias("parent"), "node", "n", F.lit(0).cast("long").alias("bytes")).write.parquet(f"{folder}/levels/depth=0")
    d = 0
    while not (live := level(d).where("n > 1")).isEmpty():
        d += 1
        steps = found.steps.where(F.col("depth") == d).select("conv_id", "turn", "bytes")
        nexts = live.select("conv_id", "n_turns", "node").join(steps, "conv_id")
        groups = nexts.groupBy("node", "turn").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"))
        joined = nexts.join(groups, ["node", "turn"])
        joined.select("conv_id", "n_turns", F.col("node").alias("parent"), F.col("child").alias("node"), "n", "bytes").write.parquet(f"{folder}/levels/depth={d}")
    for at in range(d, -1, -1):
        nodes = level(at).where("conv_id = node")
        if at == d:
            below = spark.createDataFrame([], "parent bigint, children bigint, leaves bigint, saved bigint")
        else:
            deeper = spark.read.schema(ROLLED).parquet(f"{folder}/rolled/depth={at + 1}")
            below = deeper.groupBy(F.col("parent_conv_id").alias("parent")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        rolled = nodes.select("node", F.col("parent").alias("parent_conv_id"), "n", "bytes", "n_turns").join(below, F.col("node") == F.col("parent"), "left")
        alone = F.col("n") == 1  # what lies below it is its own last turns
        rolled.select(
            F.col("node").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"),
            F.when(alone, (F.col("n_turns") > at).cast("long")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        ).write.parquet(f"{folder}/rolled/depth={at}")
    levels = spark.read.schema(f"{LEVEL}, depth int").parquet(f"{folder}/levels").withColumn("depth", F.col("depth").cast("long"))
    alone = levels.where("n = 1 and n_turns > depth").select("conv_id", "n_turns", F.col("depth").alias("from"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = found.steps.join(alone, "conv_id").where("depth > from").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
    )
    shared = spark.read.schema(f"{ROLLED}, depth int").parquet(f"{folder}/rolled").withColumn("depth", F.col("depth").cast("long"))
    ends = levels.where("n_turns = depth").select("conv_id", F.col("depth").alias("end_depth"), F.col("node").alias("end_node"), F.col("n").alias("n_convs"))
    own_ends = alone.select("conv_id", F.col("n_turns").alias("end_depth"), F.col("conv_id").alias("end_node"), one.alias("n_convs"))
    return Trie(shared.select(tails.columns).unionByName(tails), ends.unionByName(own_ends))


def end_digests(trie: Trie) -> DataFrame:
    """(depth, conv_id, ends_sha256) of the nodes of several conversations in which some end: SHA-256 of their ids, ascending, comma-joined.

    A digest over a list can't be put together from parts, so a node's ids pass through one task, in order and not held.
    """
    rows = trie.members.where("n_convs > 1").select("end_depth", "end_node", "conv_id")
    ordered = rows.repartition("end_depth", "end_node").sortWithinPartitions("end_depth", "end_node", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()

        def made(done: list[tuple]) -> pa.RecordBatch:
            depths, nodes, digests = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(depths, pa.int64()), pa.array(nodes, pa.int64()), pa.array(digests, pa.string())], names=["depth", "conv_id", "ends_sha256"])

        for b in batches:
            depth, at, conv = (c.to_numpy() for c in b.columns)
            cuts = np.flatnonzero((depth[1:] != depth[:-1]) | (at[1:] != at[:-1])) + 1
            done = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if i == j:
                    continue
                key, text = (int(depth[i]), int(at[i])), ",".join(map(str, conv[i:j].tolist()))
                if key == node:
                    text = "," + text
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield made(done)
        if node is not None:
            yield made([(*node, digest.hexdigest())])

    return map_batches(ordered, run, "depth bigint, conv_id bigint, ends_sha256 string")


def with_end_digests(trie: Trie) -> DataFrame:
    """The nodes with ends_sha256; where nothing ends, the empty string's digest."""
    own = F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string"), 256))  # of one conversation, which ends or goes on
    several = trie.nodes.join(end_digests(trie), ["depth", "conv_id"], "left")
    return several.withColumn("ends_sha256", F.coalesce("ends_sha256", F.when(F.col("n_convs") == 1, own), F.lit(NO_ENDS)))
