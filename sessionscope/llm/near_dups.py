"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. Every text becomes its set of hashed word shingles; texts with one set form a class, which goes on as one node.
2. A node has ``bands x rows`` MinHash samples, kept as band keys and as an odd sketch: each (sample number,
   value) flips one bit of a small bitmap. The population count of two sketches' XOR tells how many samples
   differ, and is precise where few do, so candidates are turned down without touching their sets.
3. Nodes that share a band key form a bucket. In the first rounds every node of a bucket is compared with one pivot
   only, another one in each bucket and round. Confirmed links are joined into components. The last round then
   compares, bucket by bucket, all nodes that are not in one component yet. A bucket whose nodes are all one
   component makes no pairs, so a large group of near copies costs its size and not its square, and no link that
   could join two components is left out. A large bucket is cut by set size (sets that may link are in the same or
   neighbouring steps of the length window) and then into tiles of at most ``tile`` by ``tile`` nodes, so no task holds a bucket.
   A bucket that would make more pairs than its sets' items are worth, as one of texts with much in common and too little to
   be linked, is dealt anew by rare items: of two sets that reach the threshold, both hold a common item among their rarest
   ``n - ceil(n x percent / 100) + 1`` ones, rarest in one order for all. So pairs follow what texts share beside the
   boilerplate, and none that may link is lost.
4. A second parity bitmap is folded from the full set. Its XOR count never exceeds the number of shingles that two
   sets don't share, so turning down pairs by it loses nothing; it is sharp for short texts, where few samples
   differ by chance, and the sample sketch for long ones.
5. Pairs that pass are confirmed by exact Jaccard similarity of the full sets.

At similarity 0.8 a pair shares none of 48 bands of 6 with probability (1 - 0.8^6)^48 = 5e-7; sketches reject a pair
at the threshold when their estimate is over ``slack`` too low, about six standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.components import connected_components
from sessionscope.llm.shingles import WordHashes, mix64, shingle_set
from sessionscope.operators.arrow import map_batches
from sessionscope.operators.staging import stage


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    percent: int = 80  # linked from this similarity on
    bands: int = 48
    rows: int = 6
    sketch_bits: int = 512
    parity_bits: int = 1024
    slack: float = 0.22
    pivot_rounds: int = 3
    tile: int = 4096  # nodes of a bucket that one task compares with as many others
    item_cost: int = 16  # pairs of sketches compared that cost as much as one item of a set dealt by rarity
    seed: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_bits(self) -> int:
        """XOR population count up to which the estimate is within ``slack`` of the threshold."""
        differ = 2 * self.samples * (1 - (self.percent / 100 - self.slack))
        return math.ceil(self.sketch_bits / 2 * (1 - math.exp(-2 * differ / self.sketch_bits)))


def minhash(sets: list[np.ndarray], config: NearDupConfig) -> np.ndarray:
    """Samples, a row a set: the least of the set's values under each of the random permutations x -> a x mod 2^64."""
    rng = np.random.default_rng(config.seed)
    factors = rng.integers(0, 1 << 63, config.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), config.samples), np.uint64)
    at = 0
    while at < len(sets):
        end, n = at + 1, len(sets[at])
        while end < len(sets) and n + len(sets[end]) <= 1 << 15:  # what stays in the processor's cache
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.intp)
        for i, a in enumerate(factors):
            out[at:end, i] = np.minimum.reduceat(flat * a, starts)
        at = end
    return out


def band_keys(samples: np.ndarray, config: NearDupConfig) -> np.ndarray:
    cut = samples.reshape(len(samples), config.bands, config.rows)
    keys = np.broadcast_to(np.arange(config.bands, dtype=np.uint64), cut.shape[:2])
    for r in range(config.rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return keys.view(np.int64)


def _parity(owner: np.ndarray, values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmaps of ``n`` owners as 64-bit words: every value flips one bit of its owner's."""
    bit = (values % np.uint64(bits)).astype(np.intp)
    flips = np.bincount(owner * bits + bit, minlength=n * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def odd_sketches(samples: np.ndarray, config: NearDupConfig) -> np.ndarray:
    """Parity bitmaps of the samples, each told apart by its number."""
    n, k = samples.shape
    salted = mix64(samples + np.arange(k, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return _parity(np.repeat(np.arange(n), k), salted.ravel(), n, config.sketch_bits)


def set_parities(sets: list[np.ndarray], config: NearDupConfig) -> np.ndarray:
    """Parity bitmaps of whole sets, a part of the sets at a time."""
    out, at = [], 0
    while at < len(sets):
        part = sets[at : at + 256]
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        out.append(_parity(owner, mix64(np.concatenate(part) + np.uint64(0x632BE59BD9B4E019)), len(part), config.parity_bits))
        at += 256
    return np.concatenate(out)


def _lists(a: np.ndarray) -> pa.Array:
    offsets = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a).ravel()))


def signatures(docs: DataFrame, id_col: str, text_col: str, config: NearDupConfig) -> DataFrame:
    """(id, digest, n, set_key, bands, sketch, parity) of every row; the last four are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                sets = [shingle_set(t or b"", config.shingle, hashes) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                bands: list[pa.Array] = []
                if full:
                    for i in full:
                        keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    there = [sets[i] for i in full]
                    samples = minhash(there, config)
                    take = np.full(len(sets), -1)
                    take[full] = np.arange(len(full))
                    index = pa.array(take, mask=take < 0)
                    bands = [_lists(x).take(index) for x in (band_keys(samples, config), odd_sketches(samples, config), set_parities(there, config))]
                else:
                    bands = [pa.nulls(len(sets), pa.list_(pa.int64()))] * 3
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *bands],
                    names=["id", "digest", "n", "set_key", "bands", "sketch", "parity"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, f"id {kind}, digest string, n bigint, set_key binary, bands array<bigint>, sketch array<bigint>, parity array<bigint>")


def text_digest(text: Column) -> Column:
    """What tells texts of one id apart; a null text has none."""
    return F.md5(text.cast("string").cast("binary"))


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, config: NearDupConfig) -> DataFrame:
    """(node, n, items) for ``wanted`` (node, id, set_key): its texts are read and shingled again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [shingle_set(t or b"", config.shingle, hashes) for t in batch.column(2).cast(pa.binary()).to_pylist()]
                same = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, batch.column(1).to_pylist(), strict=True)]
                sets = [s if ok else s[:0] for s, ok in zip(sets, same, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
                made = pa.RecordBatch.from_arrays([batch.column(0), items], names=["node", "items"])
                yield made.filter(pa.array(same))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(wanted.withColumnRenamed("id", "want"), F.col("id").eqNullSafe(F.col("want")))
    return map_batches(joined.select("node", "set_key", "text"), run, "node bigint, items array<bigint>")


def _xor_count(a: str, b: str, name: str, words: int) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{name}{i}").bitwiseXOR(F.col(f"{b}.{name}{i}"))) for i in range(words)), F.lit(0))


def _may_link(a: str, b: str, config: NearDupConfig) -> Column:
    """Whether sizes and full parities allow the threshold and sample sketches come near it; a, b: aliases with n, s0..., p0..."""
    n, m, p = F.col(f"{a}.n"), F.col(f"{b}.n"), config.percent
    sizes = F.lit(100) * F.least(n, m) >= F.lit(p) * F.greatest(n, m)
    whole = F.lit(100 + p) * _xor_count(a, b, "p", config.parity_bits // 64) <= F.lit(100 - p) * (n + m)
    return sizes & whole & (_xor_count(a, b, "s", config.sketch_bits // 64) <= config.most_bits())


def _confirmed(pairs: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("y"))
    both = pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(config.percent) * (F.size("x") + F.size("y") - F.col("common"))).select("u", "v")


def _joined(label: DataFrame, pairs: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """``label`` (node, comp) with the components that confirmed pairs of nodes bring together."""
    cu = label.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    cv = label.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    links = _confirmed(pairs, sets, config).join(cu, "u").join(cv, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = connected_components(links).select(F.col("node").alias("comp"), "root")
    return stage(label.join(merged, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "dup-labels")


def _open_buckets(buckets: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """(key, node, comp, pivot) of the buckets whose nodes are in several components. The pivot depends on key and turn:
    the node that is least after its id's bits are flipped by a hash of both."""
    placed = buckets.join(label, "node")
    flip = F.xxhash64("key", F.lit(turn))
    best = placed.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(flip)).alias("best"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    best = best.where("low <> high").select("key", F.col("best").bitwiseXOR(flip).alias("pivot"))
    return placed.join(best, "key").select("key", "node", "comp", "pivot")


def _tiled(placed: DataFrame, config: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """(outsiders, all) of the open buckets with ``step`` and ``cell``, the keys beside ``key`` that pairs must agree on.

    Small buckets have one step and one cell. In a large one, ``step`` counts the length window: sets within it are at most a
    step apart, so an outsider goes to its own step and both beside it. Where a step still holds more than ``tile`` nodes,
    outsiders and all are each dealt by hash into parts, and a pair of parts is a cell. Every pair of an outsider and another
    node in the window meets once.
    """
    width = 1.0001 * math.log(100 / config.percent)  # a little wider, for logarithms are rounded
    sizes = placed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > config.tile).select(F.col("key").alias("k"))
    marked = placed.join(sizes, F.col("key") == F.col("k"), "left").withColumn("large", F.col("k").isNotNull()).drop("k")
    marked = stage(marked.withColumn("step", F.when(F.col("large"), F.floor(F.log("n") / width)).otherwise(0)), "dup-open")
    outsiders = marked.where("comp <> main")
    around = F.when(F.col("large"), F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).otherwise(F.array("step"))
    outsiders = outsiders.withColumn("step", F.explode(around))
    parts = lambda df, name: df.where("large").groupBy("key", "step").agg(F.ceil(F.count("*") / config.tile).cast("int").alias(name))
    grid = stage(parts(marked, "across").join(parts(outsiders, "down"), ["key", "step"]), "dup-tiles")
    grid = grid.select(F.col("key").alias("k"), F.col("step").alias("s"), "across", "down")

    def dealt(df: DataFrame, own: str, other: str, cell: Callable[[Column, Column], Column]) -> DataFrame:
        sized = df.join(grid, (F.col("key") == F.col("k")) & (F.col("step") == F.col("s")), "left").drop("k", "s").na.fill(1, ["across", "down"])
        mine = F.pmod(F.xxhash64("node", F.lit(own)), F.col(own))
        copies = sized.withColumn("o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return copies.withColumn("cell", cell(mine, F.col("o"))).drop("o", "across", "down", "large")

    return dealt(outsiders, "down", "across", lambda mine, o: mine * F.col("across") + o), dealt(marked, "across", "down", lambda mine, o: o * F.col("across") + mine)


def _rare_item_buckets(sets: DataFrame, nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """(key, node): buckets of the given nodes by items, in which every two of them that reach the threshold meet.

    Items are ordered by the number of ``nodes`` that hold them, then by value; an item that one node holds makes no bucket, though it
    has its place among the node's rarest.
    """
    items = sets.join(nodes, "node", "left_semi").select("node", F.size("items").alias("n"), F.explode("items").alias("item"))
    held = items.groupBy("item").agg(F.count("*").alias("held"))
    ranked = items.join(held, "item").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "item"))).alias("ranked"))
    count = F.col("n") - F.ceil(F.lit(config.percent) * F.col("n") / 100).cast("int") + 1
    return ranked.select("node", F.explode(F.slice("ranked", F.lit(1), count)).alias("r")).where("r.held > 1").select(F.col("r.item").alias("key"), "node")


def _last_buckets(buckets: DataFrame, label: DataFrame, sets: DataFrame, sizes: DataFrame, config: NearDupConfig) -> DataFrame:
    """(key, node, comp, main) of the open buckets of the last round; costly ones are dealt anew by rare items. ``sizes``: (node, n)."""
    pivot_comp = label.select(F.col("node").alias("pivot"), F.col("comp").alias("main"))
    opened = stage(_open_buckets(buckets, label, config.pivot_rounds).join(pivot_comp, "pivot").drop("pivot").join(sizes, "node"), "dup-opened")
    cost = opened.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("comp") != F.col("main")).alias("out"), F.sum("n").alias("items"))
    # in double precision, for counts multiply
    costly = stage(cost.where(F.col("size").cast("double") * F.col("out") > F.lit(config.item_cost) * F.col("items")).select("key"), "dup-costly")
    opened = opened.drop("n")
    if costly.isEmpty():
        return opened
    nodes = stage(opened.join(costly, "key", "left_semi").select("node").distinct(), "dup-dealt")
    dealt = stage(_rare_item_buckets(sets, nodes, config), "dup-rare")
    again = _open_buckets(dealt, label, config.pivot_rounds).join(pivot_comp, "pivot").select("key", "node", "comp", "main")
    return opened.join(costly, "key", "left_anti").select("key", "node", "comp", "main").union(again)


def _judged(docs: DataFrame, id_col: str, text_col: str, config: NearDupConfig) -> DataFrame:
    """(id, digest, n, rep) of every row; ``rep`` (none, id, digest) is the least row of its component, null where the set is empty."""
    sig = stage(signatures(docs, id_col, text_col, config), "dup-signatures")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "digest")  # null ids come last
    by_set = sig.where("n > 0").groupBy("set_key").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("bands", "sketch", "parity")])
    nodes = stage(by_set.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")
    word = lambda c, name, bits: [F.element_at(c, i + 1).alias(f"{name}{i}") for i in range(bits // 64)]
    sketches = nodes.select("node", "n", *word("sketch", "s", config.sketch_bits), *word("parity", "p", config.parity_bits))

    in_band = nodes.select("node", F.explode("bands").alias("key"))
    shared = in_band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = stage(in_band.join(shared, "key"), "dup-buckets")
    label = stage(buckets.select("node").distinct().withColumn("comp", F.col("node")), "dup-labels")
    wanted = nodes.select("node", F.col("rep.id").alias("id"), "set_key").join(label.select("node"), "node", "left_semi")
    sets = stage(_full_sets(docs, wanted, id_col, text_col, config).dropDuplicates(["node"]), "dup-sets")

    for turn in range(config.pivot_rounds):
        pivot_comp = label.select(F.col("node").alias("pivot"), F.col("comp").alias("main"))
        stars = _open_buckets(buckets, label, turn).join(pivot_comp, "pivot").where("comp <> main")
        stars = stars.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
        near = stars.alias("p").join(sketches.alias("a"), F.col("p.u") == F.col("a.node")).join(sketches.alias("b"), (F.col("p.v") == F.col("b.node")) & _may_link("a", "b", config))
        label = _joined(label, near.select("p.u", "p.v"), sets, config)

    placed = _last_buckets(buckets, label, sets, nodes.select("node", "n"), config).join(sketches, "node")
    outsiders, everyone = _tiled(stage(placed, "dup-placed"), config)
    open_pair = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.cell") == F.col("b.cell"))
    across = outsiders.alias("a").join(everyone.alias("b"), met & open_pair & _may_link("a", "b", config))
    pairs = across.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    label = _joined(label, pairs, sets, config)

    final = stage(nodes.select("node", "rep", "set_key").join(label, "node", "left").select("rep", "set_key", F.coalesce("comp", "node").alias("root")), "dup-roots")
    # a table of its own, so that the join below can split a root with many texts over several tasks
    least = stage(final.groupBy("root").agg(F.min("rep").alias("least")), "dup-least")
    by_key = final.join(least, "root").select(F.col("set_key").alias("k"), "least")
    return sig.join(by_key, F.col("set_key") == F.col("k"), "left").select("id", "digest", "n", F.col("least").alias("rep"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: NearDupConfig = NearDupConfig()) -> DataFrame:  # noqa: B008
    """One row for every row of ``docs``: id, ``n_shingles``, ``component_id`` (least id of its component), ``kept`` (id = component_id).

    Texts without words, null texts too, have no shingles and are linked with nothing. A null id counts as
    larger than any other; a component of null ids only has a null component_id and keeps all. Repeated
    rows are copies of each other. Empty tables give empty results. Other columns play no part.
    """
    component = F.when(F.col("n") > 0, F.col("rep.id")).otherwise(F.col("id"))
    return _judged(docs, id_col, text_col, config).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: NearDupConfig = NearDupConfig()) -> DataFrame:  # noqa: B008
    """One document of each component, all columns: the one of the least id, and of several texts of that id the one of the
    least digest. Texts without words stay. Of repeated rows (one id, one text) one stays."""
    judged = _judged(docs, id_col, text_col, config)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    kept = judged.where((F.col("n") == 0) | (F.col("rep") == own)).select(F.col("id").alias("__kept"), F.col("digest").alias("__of")).distinct()
    marked = docs.withColumn("__text", text_digest(F.col(text_col)))
    chosen = marked.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")) & F.col("__text").eqNullSafe(F.col("__of")), "left_semi")
    return chosen.dropDuplicates([id_col, "__text"]).drop("__text")
