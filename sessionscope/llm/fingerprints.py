"""Quartile bucket digests of texts.

A window of five bytes slides over the UTF-8 text. Six triplets of each window are hashed to ``BUCKETS``
counters; the digest tells for every counter in which quartile of all counters it lies (two bits), after a
byte for the length on a logarithmic scale. Texts that share passages share which buckets are full, so digests
are compared by a difference that adds up quartile steps and length steps and is bounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.arrow import map_batches
from sessionscope.operators.staging import literal_rows, stage

BUCKETS = 256
WINDOW = 5
#: Offsets of the other two bytes of a triplet, counted back from the window's last byte.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FAR = 6  # what three quartile steps count: opposite ends are no accident
LENGTH_BASE = 1.3
LENGTH_STEPS = 12  # more steps than this count as this many
BOUND = int(1.5 * BUCKETS)  # unrelated texts come near this difference; more counts as this much

_rng = np.random.default_rng(20)
_TABLES = _rng.integers(0, 256, (3, 256), dtype=np.uint8)
_SALTS = _rng.integers(0, 256, len(TRIPLETS), dtype=np.uint8)


def bucket_counts(text: bytes) -> np.ndarray:
    """Counters of the hashed triplets; texts shorter than a window are filled up with zero bytes, an empty one has none."""
    if not text:
        return np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    step = 1 << 20
    for at in range(0, len(b) - WINDOW + 1, step):  # long texts in pieces that overlap by a window
        piece = b[at : at + step + WINDOW - 1]
        one, two, three = (t[piece] for t in _TABLES)
        n = len(piece) - WINDOW + 1
        for (i, j), salt in zip(TRIPLETS, _SALTS, strict=True):
            h = one[WINDOW - 1 :] ^ two[WINDOW - 1 - i :][:n] ^ three[WINDOW - 1 - j :][:n] ^ salt
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def fingerprint(text: bytes) -> str:
    """Hex digits: a byte for the length, then two bits a bucket."""
    counts = bucket_counts(text)
    ranked = np.sort(counts)
    cuts = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    code = np.searchsorted(cuts, counts, side="left").astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    length = min(255, int(math.log(len(text)) / math.log(LENGTH_BASE)) + 1) if text else 0
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _quarters(digest: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return int(raw[0]), np.stack([raw[1:] >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the bound on."""
    (la, qa), (lb, qb) = _quarters(a), _quarters(b)
    steps = np.abs(qa - qb)
    difference = int(steps.sum() + (FAR - 3) * (steps == 3).sum()) + min(abs(la - lb), LENGTH_STEPS)
    return 1.0 - min(difference, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the next document's first ones, or to all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [fingerprint(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = map_batches(made, run, f"id {kind}, fingerprint string")
    return made.withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) dealt by range and sorted so that inside a partition every row is followed by its next document.

    Next means by descending id, null ids last, rows of one id by their text's MD5. Copies of one row are dealt by their
    place in the scan, so that one repeated row doesn't fill a partition.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc(), F.col("place")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")


_COMPARED = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, digest: str, following: str, next_digest: str) -> tuple:
    changed = edited(text, following).encode()
    other = fingerprint(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), digest, other, likeness(digest, other), likeness(digest, next_digest)


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text and of its edited form, and how like they and the next document's are.

    Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts count
    as empty; the last document's next one is the first, an only document is its own; repeated rows are each other's. Ids are of
    any type that has an order. Empty tables give empty results.

    One shuffle deals the texts by range. A partition compares its rows with each other and keeps its first and last
    text as rows of their own, at most two a partition, which are then joined over the borders.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first: tuple | None = None  # id, text, digest
        last: tuple | None = None
        id_type: pa.DataType | None = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", *[c.split()[0] for c in _COMPARED.split(", ")], "part", "side", "text"])

        for b in batches:
            id_type = b.column(0).type
            out: list[tuple] = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                now = (key, raw.decode("utf-8", errors="replace"), fingerprint(raw))
                if last is None:
                    first = now
                else:
                    out.append((last[0], *_compared(last[1], last[2], now[1], now[2]), part, None, None))
                last = now
            yield made(out)
        if first is not None and last is not None:
            yield made([(x[0], None, None, x[2], None, None, None, part, side, x[1]) for x, side in ((first, "first"), (last, "last"))])

    schema = f"id {kind}, {_COMPARED}, part int, side string, text string"
    found = stage(map_batches(in_order(docs, id_col, text_col), run, schema), "fingerprint-pairs")
    inside = found.where("side is null").drop("part", "side", "text")
    parts = [r["part"] for r in found.where("side = 'first'").select("part").orderBy("part").collect()]  # a number a partition
    following = literal_rows(docs.sparkSession, [(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, behind int")
    firsts = found.where("side = 'first'").select(F.col("part").alias("behind"), F.col("text").alias("t"), F.col("fingerprint").alias("f"))
    borders = found.where("side = 'last'").join(following, "part").join(firsts, "behind").select("id", "text", "fingerprint", "t", "f")

    def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["id"], *_compared(r["text"], r["fingerprint"], r["t"], r["f"])) for r in b.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", *[c.split()[0] for c in _COMPARED.split(", ")]])

    return inside.unionByName(map_batches(borders, over_borders, f"id {kind}, {_COMPARED}")).withColumnRenamed("id", id_col)
