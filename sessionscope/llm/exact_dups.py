"""Exact duplicates by an extendible-hash index on shared files.

A text's key is its 63-bit hash. The directory maps key prefixes to buckets: where a bucket holds more bytes of different
texts than it may, it is split by one more bit, and where no slot is left for that the directory doubles, until every
bucket fits or holds one key. Buckets lie in key order, so an owner task gets a range of keys that begins and ends with a
bucket. It reads its rows in key order, keeps the texts of one key as a chain, compares bytes along it, and writes an
entry per text. The entries are the index: a table on the shared folder to which more documents can be added.

Copies are counted where they are read, before anything moves, so a text that a third of all rows hold reaches its owner
once a task, and an owner holds one key's different texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.arrow import map_batches
from sessionscope.operators.ordering import with_global_index
from sessionscope.operators.staging import stage

KEY_BITS = 63
MOST_OWNERS = 1 << 16  # so many lower bounds of owners are held by the driver and each task


@dataclass(frozen=True)
class DedupConfig:
    """bucket_bytes: of different texts in a bucket; owner_bytes: of an owner's buckets together, where there are enough owners;
    held_bytes: of texts whose copies a reading task counts at a time."""

    bucket_bytes: int = 1 << 20
    owner_bytes: int = 64 << 20
    held_bytes: int = 24 << 20
    step_bits: int = 12  # depths of the directory looked at in one pass over the keys
    key_bits: int = KEY_BITS  # fewer for tests of collisions


@dataclass
class DedupIndex:
    """directory: prefix, depth, texts, bytes of each bucket. entries: key, chain (place among the texts of a key), keep_id, n (rows),
    n_keep (rows that have keep_id), sha256, text."""

    directory: DataFrame
    entries: DataFrame
    config: DedupConfig

    @property
    def global_depth(self) -> int:
        """Bits that the directory looks at: it has two to this power slots."""
        return self.directory.agg(F.max("depth")).first()[0] or 0


def text_key(text: Column, bits: int = KEY_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def _texts(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """(key, id, text); a null text is an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(text_key(F.col("text"), bits).alias("key"), "id", "text")


def directory(sizes: DataFrame, config: DedupConfig) -> DataFrame:
    """Buckets of keys (key, bytes): the fewest bits of each prefix under which a bucket holds at most bucket_bytes or one key.

    A pass looks at step_bits more depths of the buckets that are still too full; what it counts is added up along the tree.
    """
    bits, done, depth = config.key_bits, None, 0
    live = sizes
    while True:
        to = min(depth + config.step_bits, bits)
        counts = live.groupBy(F.shiftright("key", bits - to).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("texts").alias("texts"))
        levels = counts.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(to))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(prefix, {to} - depth)"))
        tree = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("texts").alias("texts"))
        tree = stage(tree.withColumn("full", (F.col("bytes") > config.bucket_bytes) & (F.col("texts") > 1) & (F.col("depth") < bits)), "bucket-tree")
        split = tree.where("full").select((F.col("depth") + 1).alias("_depth"), F.col("prefix").alias("_above"))
        leaf = tree.where("not full")
        below = leaf.join(split, (F.col("depth") == F.col("_depth")) & (F.shiftright("prefix", 1) == F.col("_above")), "left_semi")
        found = leaf.where(F.col("depth") == depth).unionByName(below).drop("full")
        done = found if done is None else done.unionByName(found)
        over = tree.where((F.col("depth") == to) & F.col("full")).select(F.col("prefix").alias("_over"))
        if over.isEmpty():
            return done
        live = live.join(over, F.shiftright("key", bits - to) == F.col("_over"), "left_semi")
        # the overfull ones come again as the first depth of the next pass, where they are full once more
        depth = to


def _owner_bounds(buckets: DataFrame, config: DedupConfig) -> np.ndarray:
    """Least key of every owner: buckets in key order, cut where their bytes reach an owner's share. At most MOST_OWNERS numbers."""
    lowest = buckets.withColumn("low", F.expr(f"shiftleft(prefix, {config.key_bits} - depth)")).select("low", "bytes")
    placed = with_global_index(lowest, [F.col("low")], "_place", {"bytes": "_upto"})
    total = buckets.agg(F.sum("bytes")).first()[0] or 0
    wanted = max(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // config.owner_bytes))
    owners = min(wanted, MOST_OWNERS)
    owner = F.floor((F.col("_upto") - F.col("bytes")) * owners / F.lit(max(total, 1)))
    lows = placed.groupBy(owner.alias("owner")).agg(F.min("low").alias("low")).collect()
    return np.array(sorted(r["low"] for r in lows) or [0], np.int64)


class _Counted:
    """Copies of texts, counted: text to [key, greatest id, rows, rows of that id]."""

    def __init__(self) -> None:
        self.texts: dict[bytes, list] = {}
        self.held = 0

    def add(self, key: int, top: Any, text: bytes, n: int, n_top: int) -> None:
        seen = self.texts.get(text)
        if seen is None:
            self.texts[text] = [key, top, n, n_top]
            self.held += len(text) + 300
            return
        _join(seen, top, n, n_top)


def _join(seen: list, top: Any, n: int, n_top: int) -> None:
    """Add rows to what is known of a text: [key, greatest id, rows, rows of that id]."""
    seen[2] += n
    if top is None and seen[1] is not None:
        return
    if seen[1] is None and top is not None or top != seen[1] and top > seen[1]:
        seen[1], seen[3] = top, n_top
    elif top == seen[1]:
        seen[3] += n_top


def _combined(rows: DataFrame, bounds: np.ndarray, held_bytes: int, id_type: str) -> DataFrame:
    """(owner, key, keep_id, n, n_keep, text): a task's copies of a text as one row, with the owner of its key."""
    shared = rows.sparkSession.sparkContext.broadcast(bounds)  # at most MOST_OWNERS numbers

    def out(counted: _Counted, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        found = list(counted.texts.items())
        for at in range(0, len(found), 2048):
            part = found[at : at + 2048]
            keys = np.array([v[0] for _, v in part], np.int64)
            owners = np.maximum(np.searchsorted(shared.value, keys, side="right") - 1, 0)
            columns = [
                pa.array(owners, pa.int32()), pa.array(keys), pa.array([v[1] for _, v in part], kind),
                pa.array([v[2] for _, v in part], pa.int64()), pa.array([v[3] for _, v in part], pa.int64()), pa.array([t for t, _ in part], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "key", "keep_id", "n", "n_keep", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, kind = _Counted(), pa.null()
        for b in batches:
            kind = b.column(1).type
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                counted.add(*row)
                if counted.held > held_bytes:
                    yield from out(counted, kind)
                    counted = _Counted()
        yield from out(counted, kind)

    return map_batches(rows.select("key", "id", "text", "n", "n_keep"), run, f"owner int, key bigint, keep_id {id_type}, n bigint, n_keep bigint, text binary")


def _owned(rows: DataFrame, owners: int, id_type: str) -> DataFrame:
    """The entries of every owner's keys, in key order."""
    names = ["key", "chain", "keep_id", "n", "n_keep", "sha256", "text"]

    def entries(key: int, chain: list[list]) -> list[tuple]:
        return [(key, i, *known, hashlib.sha256(text).hexdigest(), text) for i, (text, known) in enumerate((e[0], e[1][1:]) for e in chain)]

    def made(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), kind, pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain, found, held, kind = None, [], [], 0, pa.null()
        for b in batches:
            kind = b.column(1).type
            for k, top, n, n_top, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != key:
                    found += entries(key, chain)
                    key, chain = k, []
                    if held > 4 << 20:
                        yield made(found, kind)
                        found, held = [], 0
                same = next((e for e in chain if e[0] == text), None)
                if same is None:
                    chain.append([text, [k, top, n, n_top]])
                    held += len(text) + 200
                else:
                    _join(same[1], top, n, n_top)
        found += entries(key, chain)
        if found:
            yield made(found, kind)

    dealt = rows.repartitionById(owners, F.col("owner")).sortWithinPartitions("key").select("key", "keep_id", "n", "n_keep", "text")
    return map_batches(dealt, run, f"key bigint, chain int, keep_id {id_type}, n bigint, n_keep bigint, sha256 string, text binary")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: DedupConfig = DedupConfig(), index: DedupIndex | None = None) -> DedupIndex:  # noqa: B008
    """The index of documents, or ``index`` with these documents added. Both its tables are written to the shared folder.

    A null text is an empty one. Texts are equal when their bytes are; a key's different texts stand in one chain. Null ids are less
    than all others.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _texts(docs, id_col, text_col, config.key_bits).withColumns({"n": F.lit(1).cast("long"), "n_keep": F.lit(1).cast("long"), "text": F.col("text").cast("binary")})
    if index is not None:
        if index.config.key_bits != config.key_bits:
            raise ValueError("an index is added to with the key width that it has")
        rows = rows.unionByName(index.entries.withColumnRenamed("keep_id", "id").select(rows.columns))
    # copies of a text count once: what has the same key and length is one text here, and only its owner looks closer
    sizes = rows.groupBy("key", F.octet_length("text").alias("bytes")).count().groupBy("key").agg(F.sum("bytes").cast("long").alias("bytes"))
    sizes = stage(sizes.withColumn("texts", F.lit(1)), "key-sizes")
    buckets = stage(directory(sizes, config), "directory")
    bounds = _owner_bounds(buckets, config)
    combined = _combined(rows, bounds, config.held_bytes, id_type)
    return DedupIndex(buckets, stage(_owned(combined, len(bounds), id_type), "index-entries"), config)


def mark_copies(docs: DataFrame, index: DedupIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, looked up in an index that holds these documents.

    The row with the greatest id of a text stays; of rows repeated with that id, one. A text's address is its key and digest: of
    those the index has compared the bytes. Only texts that stand more than once are looked up.
    """
    rows = _texts(docs, id_col, text_col, index.config.key_bits).select("key", "id", F.sha2("text", 256).alias("text_sha256"))
    rows = rows.groupBy("key", "id", "text_sha256").agg(F.count("*").cast("int").alias("_repeats"))
    groups = index.entries.where("n > 1").select(F.col("key").alias("_key"), F.col("sha256").alias("_sha"), "keep_id", "n")
    found = rows.join(groups, (F.col("key") == F.col("_key")) & (F.col("text_sha256") == F.col("_sha")), "left")
    each = found.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.col("_repeats"))))
    alone = F.col("n").isNull()
    return each.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        ((alone | F.col("id").eqNullSafe(F.col("keep_id"))) & (F.col("_repeat") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: DedupConfig = DedupConfig()) -> DataFrame:  # noqa: B008
    """One row of every text, with all its columns: that with the greatest id."""
    index = build_index(docs, id_col=id_col, text_col=text_col, config=config)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_key(text, config.key_bits).alias("_key"), F.sha2(text, 256).alias("_sha"))
    entries = index.entries.select(F.col("key").alias("_k"), F.col("sha256").alias("_s"), F.col("keep_id").alias("_keep"), "n_keep")
    met = (F.col("_key") == F.col("_k")) & (F.col("_sha") == F.col("_s")) & F.col("_id").eqNullSafe(F.col("_keep"))
    stays = whole.join(entries, met)
    once = stays.where("n_keep = 1").unionByName(stays.where("n_keep > 1").dropDuplicates(["_key", "_sha"]))
    return once.select("_row.*")
