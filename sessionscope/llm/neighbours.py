"""Approximate nearest neighbours by largest inner product: inverted file, product-quantised residuals, exact reranking.

Fitted on a bounded sample: coarse centroids by k-means, their number in proportion to the root of the table's size, and for
every group of dimensions a codebook of the residuals that the centroids leave. Every vector is indexed: its cell and its
codes. A query probes the cells whose centroids it likes best; how many is measured on the sample against brute force, as the
least share of cells that reaches ``target_recall``. Data without clusters thus probe most cells, clustered data few.

Cells are packed into blocks of a bounded number of bytes, large cells are cut over several, and queries go to the blocks that
hold cells they probe, in parts of bounded bytes too: no task holds more than a block and a part. In a block, distance
tables give every probed vector's approximate score, the best ``rerank`` are scored exactly, and the best ``k`` of each block
meet in a top-k per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.arrow import map_batches
from sessionscope.operators.staging import literal_rows, stage


@dataclass(frozen=True)
class AnnConfig:
    k: int = 20
    sample: int = 65_536  # vectors that the index is fitted on, at most
    sample_per_cell: int = 64
    cells_per_root: float = 2.0  # cells are this many times the root of the number of vectors, ``most_cells`` at most
    most_cells: int = 1024
    groups: int = 16
    codes: int = 256
    target_recall: float = 0.97
    tuning_queries: int = 100
    rerank: int = 200
    margins: float = 4.0
    block_bytes: int = 24 << 20
    query_bytes: int = 4 << 20
    rounds: int = 8
    seed: int = 11

    def n_cells(self, vectors: int) -> int:
        return max(1, min(self.most_cells, int(self.cells_per_root * vectors**0.5)))

    def n_sample(self, vectors: int) -> int:
        return min(vectors, self.sample, max(16_000, self.sample_per_cell * self.n_cells(vectors)))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        for j in range(len(centres)):
            own = x[nearest == j]
            centres[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


@dataclass
class AnnIndex:
    """Centroids, codebooks (one a group of dimensions), where the groups are cut, how many cells a query probes, and the
    standard error of approximate scores."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    probes: int
    error: float = 0.0

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        liked = q @ self.centres.T
        return np.argsort(-liked, axis=1, kind="stable")[:, : self.probes]

    def approximate(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of all queries against all vectors, from tables of partial inner products."""
        out = (q @ self.centres.T).astype(np.float32)[:, cell]
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, a:b] @ book.T).astype(np.float32)[:, codes[:, m]]
        return out


def fit_index(x: np.ndarray, config: AnnConfig, vectors: int | None = None) -> AnnIndex:
    """``x`` is a sample of ``vectors`` vectors."""
    rng = np.random.default_rng(config.seed)
    dims = x.shape[1]
    edges = np.linspace(0, dims, min(config.groups, dims) + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    centres = _kmeans(x, max(1, min(config.n_cells(vectors or len(x)), len(x) // 8)), config.rounds, rng)
    rest = x - centres[_nearest(x, centres)]
    books = [_kmeans(rest[:, a:b], config.codes, config.rounds, rng) for a, b in cuts]
    index = AnnIndex(centres, books, cuts, len(centres))
    q = rng.choice(len(x), min(config.tuning_queries, len(x)), replace=False)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    index.error = float((index.approximate(x[q], *index.assign(x)) - x[q] @ x.T).std())
    k = min(config.k, len(x) - 1)
    if k > 0:
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-(x[q] @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        needed = np.sort(np.take_along_axis(place, _nearest(x, centres)[best], axis=1).ravel())
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(config.target_recall * len(needed))))]) + 1
    return index


def _element(vectors: DataFrame, vector_col: str) -> str:
    return vectors.schema[vector_col].dataType.elementType.simpleString()


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) of the vectors that may take part: not null, without a null or non-finite part, not all zero."""
    v = F.col(vector_col) if _element(vectors, vector_col) in ("float", "double") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _of_one_length(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of the commonest length, their number and that length."""
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    dims, n = (sizes[0]["dims"], sizes[0]["n"]) if sizes else (0, 0)
    return rows.where(F.size("v") == dims), n, dims


def _stack(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class _Places:
    """Where the cells lie: the first block of each and over how many it is dealt. A row a cell, so bounded by ``most_cells``."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def pack(cls, sizes: dict[int, int], cells: int, block_rows: int) -> _Places:
        first, parts = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        block, room = 0, block_rows
        for cell, n in sorted(sizes.items()):
            if n > room and room < block_rows:
                block, room = block + 1, block_rows
            first[cell], parts[cell] = block, -(-n // block_rows)
            if parts[cell] > 1:
                block, room = block + int(parts[cell]), block_rows
            else:
                room -= n
        return cls(first, parts)

    def blocks(self, cells: np.ndarray) -> np.ndarray:
        """All blocks of the cells, each once."""
        spans = [np.arange(f, f + p) for f, p in zip(self.first[cells].tolist(), self.parts[cells].tolist(), strict=True)]
        return np.unique(np.concatenate(spans)) if spans else np.empty(0, np.int64)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", config: AnnConfig = AnnConfig()) -> DataFrame:  # noqa: B008
    """Each query's ``k`` best candidates: query_id, rank from 1, vec_id, score (inner product in double precision).

    Candidates are all usable rows of ``vectors`` but those with the query's own id; ties go to the smaller id.
    ``queries`` has the same two columns. Vectors take part in the commonest length of ``vectors``. Unusable vectors are neither queries nor candidates. With fewer candidates
    all are returned; empty tables give empty results.
    """
    spark = vectors.sparkSession
    rows, n, dims = _of_one_length(usable(vectors, id_col, vector_col))
    kind = vectors.schema[id_col].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(config.n_sample(n)).select("v").toPandas()  # so many rows at most
    index = fit_index(np.stack(sample["v"].to_list()).astype(np.float64), config, n)
    shared = spark.sparkContext.broadcast(index)  # centroids and codebooks: fixed sizes
    held_type = np.float32 if _element(vectors, vector_col) == "float" else np.float64  # what holds the given numbers exactly

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _stack(b.column(1), dims)
                cell, codes = shared.value.assign(x.astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x.astype(held_type)], pa.binary())],
                    names=["id", "cell", "codes", "v"],
                )

    coded = stage(map_batches(rows, code, f"id {kind}, cell int, codes binary, v binary"), "ann-index")
    sizes = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    row_bytes = dims * np.dtype(held_type).itemsize
    block_rows, query_rows = (max(1, int(x // row_bytes)) for x in (config.block_bytes, config.query_bytes))
    places = _Places.pack(sizes, len(index.centres), block_rows)
    table = literal_rows(spark, [(c, int(places.first[c]), int(places.parts[c])) for c in sizes], "cell int, first int, parts int")
    placed = coded.join(table, "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("first", "parts")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                q = _stack(part.column(1), dims)
                to = [places.blocks(c) for c in shared.value.probed(q.astype(np.float64))]
                raw = [r.tobytes() for r in q.astype(held_type)]
                which = np.repeat(np.arange(len(to)), [len(x) for x in to])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which, pa.int64())), pa.array(np.concatenate(to), pa.int32()), pa.array([raw[i] for i in which.tolist()], pa.binary())],
                    names=["qid", "block", "q"],
                )

    own = usable(queries, id_col, vector_col).where(F.size("v") == dims)  # the table's length, whatever is common among the queries
    asked = stage(map_batches(own, send, f"qid {kind}, block int, q binary"), "ann-queries")
    demand = stage(asked.groupBy("block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("qparts")), "ann-demand")
    asked = asked.join(demand, "block").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("qparts")).cast("int"))
    asked = asked.select("block", "part", "qid", "q")
    held = placed.join(demand, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    held = held.select("block", "part", "id", "cell", "codes", "v")

    def search(asks: pd.DataFrame, holds: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series(dtype="int64"), "found": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        if asks.empty or holds.empty:
            return empty
        ix = shared.value
        holds = holds.sort_values("id", kind="stable")
        ids, cell = holds["id"].to_numpy(), holds["cell"].to_numpy()
        codes = np.frombuffer(b"".join(holds["codes"]), np.uint8).reshape(len(ids), -1)
        x = np.frombuffer(b"".join(holds["v"]), held_type).reshape(len(ids), dims)
        del holds
        qid, q = asks["qid"].to_numpy(), np.frombuffer(b"".join(asks["q"]), held_type).reshape(len(asks), dims).astype(np.float64)
        cells = ix.probed(q)
        order = np.argsort(cells[:, 0], kind="stable")  # queries that probe alike stand together and look at fewer vectors
        step = max(1, min(64, (2 << 20) // len(ids)))
        found, scores = [], []
        for at in range(0, len(q), step):
            now = order[at : at + step]
            wanted = np.zeros((len(now), len(ix.centres)), bool)
            np.put_along_axis(wanted, cells[now], True, axis=1)
            near = np.flatnonzero(wanted.any(axis=0)[cell])
            rough = np.where(wanted[:, cell[near]] & (ids[None, near] != qid[now, None]), ix.approximate(q[now], cell[near], codes[near]), -np.inf)
            for i, one in enumerate(now.tolist()):
                pick = np.flatnonzero(rough[i] > -np.inf)
                if len(pick) > config.rerank:
                    best_first = -np.partition(-rough[i], [config.k - 1, config.rerank - 1])
                    pick = np.flatnonzero(rough[i] >= min(best_first[config.rerank - 1], best_first[config.k - 1] - config.margins * ix.error))
                pick = near[pick]
                exact = (x[pick] * q[one]).sum(axis=1)
                best = np.lexsort((ids[pick], -exact))[: config.k]
                found.append(ids[pick][best])
                scores.append(exact[best])
        return pd.DataFrame({"qid": qid[order], "found": found, "scores": scores})

    local = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(search, f"qid {kind}, found array<{kind}>, scores array<double>")
    pairs = local.select("qid", F.explode(F.arrays_zip("found", "scores")).alias("p")).select("qid", F.col("p.found").alias("vec_id"), F.col("p.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= config.k).select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")
