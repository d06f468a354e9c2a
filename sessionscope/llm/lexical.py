"""Ranked lexical search: exact top documents of queries by dual-sorted wavelet trees, a tree per shard of documents.

A shard's posting lists stand behind each other in one sequence of document numbers, each list ordered by falling impact.
The sequence is kept as a wavelet matrix over the document numbers: a level tells by a bit a posting whether its document lies in
the left or the right half of the node's documents, and deals the postings out in their order. So a node holds of every list
what falls into its documents, still by impact, and the first of it bounds the rest: the sum over a query's terms is a
bound for all documents of the node. The search takes the best nodes first and goes down with the ranges of
all terms at once, until the next bound is below the k-th best score found. The k-th best score of seeds (heads of each query's
rarest lists, scored in full, over all shards) is a lower bound from the start.

Numbers of a shard's documents follow their ids, so equal scores come by id. Only N (documents with a term), L (their terms) and
a document's own length make an impact; a term's weight is applied when a query is asked.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.operators.arrow import map_batches
from sessionscope.operators.staging import stage

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Term bytes as they are but A-Z in lower case, all others a blank.
FOLD = bytes((b + 32 if b in UPPER else b) if IS_TERM[b] else 32 for b in range(256))


@dataclass(frozen=True)
class LexicalConfig:
    """shard_bytes: of texts in one tree. block_cells: (query, term) places of queries
    searched for at a time. step_nodes: best nodes of a query opened in one
    step. cells: (query, node, term) ranges that a step works on at once. seeds: documents scored in full of each of seed_terms lists."""

    k: int = 10
    shard_bytes: int = 16 << 20
    block_cells: int = 1 << 19
    step_nodes: int = 8
    cells: int = 1 << 18
    seed_terms: int = 3
    seeds: int = 10


@dataclass
class LexicalIndex:
    """shards: a row a shard, on the shared folder: ids (Arrow stream of the documents' ids, ascending), terms (Arrow stream), offsets (int32,
    of the lists), bits (packed, a level after the other), impacts (int32, in the sequence's order). n_docs and n_terms: N and L."""

    shards: DataFrame
    n_docs: int
    n_terms: int
    id_type: str
    config: LexicalConfig


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return text.translate(FOLD).split()


def _term_count(column: pa.Array) -> np.ndarray:
    """Terms of every text of an Arrow column of binaries without nulls, without making them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    inside = IS_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1] - offsets[0]
    first = starts[(starts < len(data)) & (np.diff(offsets) > 0)]
    begins[first] = inside[first]  # a text's first byte begins a term, whatever stands before it
    upto = np.concatenate([[0], np.cumsum(begins)])
    return upto[offsets[1:] - offsets[0]] - upto[starts]


def _binary(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.binary()), b"")


def _packed(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", column.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([column], ["x"]))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def corpus_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with at least one term, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            counts = _term_count(_binary(b.column(0)))
            n, total = n + int(np.count_nonzero(counts)), total + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    rows = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "n bigint, total bigint")
    found = rows.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return found["n"] or 0, found["total"] or 0


def _tokens(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all terms of all texts, numbers of terms of each)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = np.concatenate([[False], IS_TERM[data], [False]])
    begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    folded = np.frombuffer(FOLD, np.uint8)[data[inside[1:-1]]]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(folded)])
    return words.dictionary_encode(), np.diff(np.searchsorted(begins, starts))


def make_shard(ids: pa.Array, texts: list[bytes], n_docs: int, n_terms: int) -> dict[str, bytes]:
    """The columns of a shard's row."""
    order = pc.sort_indices(ids, null_placement="at_start")
    ids, texts = ids.take(order), [texts[i] for i in order.to_pylist()]
    words, lengths = _tokens(texts)
    by_name = pc.sort_indices(words.dictionary)
    place = np.empty(len(by_name), np.int64)
    place[by_name.to_numpy()] = np.arange(len(by_name))
    tokens = place[words.indices.to_numpy()]
    pairs, tf = np.unique(tokens << 32 | np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    term, doc = pairs >> 32, pairs & 0xFFFFFFFF
    m = 100 - 75 + (75 * lengths[doc] * n_docs) // max(n_terms, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)  # at most a million
    by_impact = np.argsort(term << 20 | (1_000_000 - impact), kind="stable")  # of equal ones the smaller number first
    sequence, impact = doc[by_impact].astype(np.int32), impact[by_impact].astype(np.int32)
    offsets = np.searchsorted(term, np.arange(len(by_name) + 1)).astype(np.int32)
    levels, at, depth = [], sequence, _depth(len(texts))
    for level in range(depth):
        bit = ((at >> (depth - 1 - level)) & 1).astype(bool)
        levels.append(np.packbits(bit))
        at = np.concatenate([at[~bit], at[bit]])
    bits = np.concatenate([*levels, np.empty(0, np.uint8)])
    return {"ids": _packed(ids), "terms": _packed(words.dictionary.take(by_name)), "offsets": offsets.tobytes(), "bits": bits.tobytes(), "impacts": impact.tobytes()}


def _depth(n: int) -> int:
    return max(n - 1, 0).bit_length()


SHARD = ("ids", "terms", "offsets", "bits", "impacts")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: LexicalConfig = LexicalConfig()) -> LexicalIndex:  # noqa: B008
    """Every document with at least one term goes into a shard where it is read; nothing is shuffled. A null text has none."""
    n_docs, n_terms = corpus_counts(docs, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def shard() -> pa.RecordBatch:
            made = make_shard(pa.concat_arrays(ids), texts, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([made[c]], pa.binary()) for c in SHARD], names=list(SHARD))

        for b in batches:
            column = _binary(b.column(1))
            size = pc.binary_length(column).to_numpy()
            full = np.flatnonzero(_term_count(column))
            while len(full):
                # as many as the shard has room for, at least one where it is empty
                fits = int(np.searchsorted(held + np.cumsum(size[full]), config.shard_bytes, side="right")) or (0 if texts else 1)
                taken, full = pa.array(full[:fits]), full[fits:]
                ids.append(b.column(0).take(taken))
                texts += column.take(taken).to_pylist()
                held += int(size[taken.to_numpy()].sum())
                if len(full):
                    yield shard()
                    ids, texts, held = [], [], 0
        if texts:
            yield shard()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = stage(map_batches(rows, run, ", ".join(f"{c} binary" for c in SHARD)), "lexical-shards")
    return LexicalIndex(shards, n_docs, n_terms, id_type, config)


class Shard:
    """A shard's tree, opened: per level the bits' prefix counts, and the impacts in the level's order."""

    def __init__(self, row: dict[str, Any]):
        self.ids, self.terms = _unpacked(row["ids"]), _unpacked(row["terms"])
        self.offsets = np.frombuffer(row["offsets"], np.int32)
        impact = np.frombuffer(row["impacts"], np.int32)
        n, self.depth = len(impact), _depth(len(self.ids))
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.depth, -(-n // 8))
        self.impacts, self.ones, self.zeros = [impact], [], []
        for level in range(self.depth):
            bit = np.unpackbits(packed[level], count=n).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            impact = np.concatenate([impact[~bit], impact[bit]])
            self.impacts.append(impact)

    def lists(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Range of every word's list in the sequence; an empty one for words that the shard lacks."""
        at = pc.index_in(words, value_set=self.terms)
        there = pc.is_valid(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy()
        if not len(self.terms):
            return np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        return np.where(there, self.offsets[at], 0), np.where(there, self.offsets[at + 1], 0)

    def down(self, level: int, place: np.ndarray, right: np.ndarray | bool) -> np.ndarray:
        """Where places of a level's order fall in the next one's, in the node's left or right half."""
        ones = self.ones[level][place]
        return np.where(right, self.zeros[level] + ones, place - ones)

    def documents(self, place: np.ndarray) -> np.ndarray:
        """Document numbers of places of the sequence."""
        number = np.zeros(len(place), np.int64)
        for level in range(self.depth):
            bit = self.ones[level][place + 1] - self.ones[level][place]
            place = self.down(level, place, bit == 1)
            number = number << 1 | bit
        return number

    def scores(self, number: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents for the lists given in the same row (documents by lists)."""
        for level in range(self.depth):
            right = (((number >> (self.depth - 1 - level)) & 1) == 1)[:, None]
            low, high = self.down(level, low, right), self.down(level, high, right)
        return _bounds(self.impacts[self.depth], low, high, weight)


def _bounds(impact: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over the lists of weight times the first impact of the range; exact where a range is one document."""
    first = impact[np.minimum(low, len(impact) - 1)] if len(impact) else np.zeros(low.shape, np.int64)
    return np.where(low < high, weight * first, 0).sum(axis=1)


@dataclass
class Asked:
    """Queries as numbers: for query i the words (into ``words``) and their weights times repeats, padded with weight 0."""

    word: np.ndarray  # (queries, most words)
    weight: np.ndarray


class _Best:
    """The k best (score, id) of every query so far, and what a document must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.found: list[list[tuple[int, Any]]] = [[] for _ in floor]

    def add(self, query: np.ndarray, score: np.ndarray, ids: list[Any]) -> None:
        for q, s, i in zip(query.tolist(), score.tolist(), ids, strict=True):
            self.found[q].append((s, i))
        for q in np.unique(query).tolist():
            best = sorted(self.found[q], key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))[: self.k]
            self.found[q] = best
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], best[-1][0])


def seed_scores(shard: Shard, asked: Asked, words: pa.Array, config: LexicalConfig) -> tuple[np.ndarray, np.ndarray]:
    """(query, score) of at most seeds documents from the head of each query's seed_terms heaviest lists here, each document once."""
    low, high = shard.lists(words)
    lows, highs = low[asked.word], high[asked.word]
    there = np.where(lows < highs, asked.weight, 0)
    chosen = np.argsort(-there, axis=1, kind="stable")[:, : config.seed_terms]
    query = np.repeat(np.arange(len(asked.word)), chosen.shape[1] * config.seeds)
    first = np.take_along_axis(lows, chosen, 1)[:, :, None] + np.arange(config.seeds)
    good = (first < np.take_along_axis(highs, chosen, 1)[:, :, None]).ravel() & (np.take_along_axis(there, chosen, 1)[:, :, None] + np.zeros(config.seeds, np.int64) > 0).ravel()
    query, place = query[good], first.ravel()[good]
    pairs = np.unique(query << 32 | shard.documents(place))
    query, number = pairs >> 32, pairs & 0xFFFFFFFF
    scores = [np.empty(0, np.int64)]
    step = max(1, config.cells // max(1, asked.word.shape[1]))
    for at in range(0, len(query), step):
        q = query[at : at + step]
        scores.append(shard.scores(number[at : at + step], lows[q], highs[q], asked.weight[q]))
    return query, np.concatenate(scores)


class _Ranges:
    """Rows of (low, high) ranges by slot; slots that are given back are used again."""

    def __init__(self, width: int):
        self.low, self.high = np.empty((0, width), np.int32), np.empty((0, width), np.int32)
        self.free = np.empty(0, np.int64)

    def put(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(self.free) < len(low):
            held = len(self.low)
            more = max(len(low) - len(self.free), held)
            spare = np.empty((more, self.low.shape[1]), np.int32)
            self.low, self.high = np.concatenate([self.low, spare]), np.concatenate([self.high, spare])
            self.free = np.concatenate([self.free, np.arange(held, held + more)])
        slot, self.free = self.free[: len(low)], self.free[len(low) :]
        self.low[slot], self.high[slot] = low, high
        return slot

    def give_back(self, slot: np.ndarray) -> None:
        self.free = np.concatenate([self.free, slot])


def search_shard(shard: Shard, asked: Asked, words: pa.Array, best: _Best, config: LexicalConfig) -> int:
    """Best nodes first: add to ``best`` all documents of the shard that may be among the k best. Gives the number of nodes opened.

    All queries go on together. A step opens the step_nodes best nodes of each, more where few queries are left; a node whose bound is
    below its query's k-th score is never opened.
    """
    low, high = shard.lists(words)
    width = max(1, asked.word.shape[1])
    most = max(1, config.cells // width)  # nodes that a step works on at once
    ranges, opened_nodes = _Ranges(width), 0
    query = np.arange(len(asked.word))
    lows, highs = low[asked.word], high[asked.word]
    bound = _bounds(shard.impacts[0], lows, highs, asked.weight)
    slot = ranges.put(lows, highs)
    number, level = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
    while True:
        alive = (bound >= best.floor[query]) & (bound > 0)
        ranges.give_back(slot[~alive])
        query, bound, number, level, slot = (x[alive] for x in (query, bound, number, level, slot))
        if not len(query):
            return opened_nodes
        # of equal bounds the deepest node first, then the smallest ids
        order = np.lexsort((number, -level, -bound, query))
        starts = np.append(True, query[order][1:] != query[order][:-1])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
        chosen = order[rank < max(config.step_nodes, most // int(starts.sum()))]
        opened_nodes += len(chosen)
        rest = np.ones(len(order), bool)
        rest[chosen] = False
        leaf = chosen[level[chosen] == shard.depth]
        if len(leaf):
            best.add(query[leaf], bound[leaf], shard.ids.take(pa.array(number[leaf])).to_pylist())
        parts = [(query[rest], bound[rest], number[rest], level[rest], slot[rest])]
        inner = chosen[level[chosen] < shard.depth]
        for depth in np.unique(level[inner]).tolist():
            at_depth = inner[level[inner] == depth]
            for at in range(0, len(at_depth), most):
                here = at_depth[at : at + most]
                q, lo, hi = query[here], ranges.low[slot[here]], ranges.high[slot[here]]
                for right in (False, True):
                    lo_next, hi_next = shard.down(depth, lo, right), shard.down(depth, hi, right)
                    reach = _bounds(shard.impacts[depth + 1], lo_next, hi_next, asked.weight[q])
                    good = (reach >= best.floor[q]) & (reach > 0)
                    put = ranges.put(lo_next[good], hi_next[good])
                    parts.append((q[good], reach[good], number[here][good] << 1 | right, level[here][good] + 1, put))
        ranges.give_back(slot[chosen])
        query, bound, number, level, slot = (np.concatenate(x) for x in zip(*parts, strict=True))


def _blocks(queries: DataFrame, cells: int) -> Iterator[list[tuple[Any, list[bytes]]]]:
    """Queries with their terms, so many at a time that queries times the most terms of one stay bounded (a longer one comes alone)."""
    block, width = [], 1
    for r in queries.toLocalIterator():
        found = terms((r["text"] or "").encode("utf-8", "surrogatepass"))
        if block and (len(block) + 1) * max(width, len(found)) > cells:
            yield block
            block, width = [], 1
        block.append((r["id"], found))
        width = max(width, len(found))
    if block:
        yield block



def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _list_lengths(index: LexicalIndex, words: list[bytes]) -> np.ndarray:
    """In how many documents each word stands."""
    shared = index.shards.sparkSession.sparkContext.broadcast(words)  # of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for row in _opened(batches):
            at = pc.index_in(wanted, value_set=_unpacked(row["terms"]))
            there = pc.is_valid(at).to_numpy(zero_copy_only=False)
            lengths = np.diff(np.frombuffer(row["offsets"], np.int32))
            total[there] += lengths[at.drop_null().to_numpy()]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["word", "df"])

    counted = map_batches(index.shards.select("terms", "offsets"), run, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    out = np.zeros(len(words), np.int64)
    for r in counted.toLocalIterator():
        out[r["word"]] = r["df"]
    return out


def _weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _asked(block: list[tuple[Any, list[bytes]]], place: dict[bytes, int], weights: np.ndarray) -> Asked:
    rows = []
    for _, found in block:
        numbers, repeats = np.unique(np.array([place[w] for w in found], np.int64), return_counts=True)
        rows.append((numbers, weights[numbers] * repeats))
    width = max([1, *(len(n) for n, _ in rows)])
    word, weight = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
    for i, (n, w) in enumerate(rows):
        word[i, : len(n)], weight[i, : len(n)] = n, w
    return Asked(word, weight)


def search(index: LexicalIndex, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", doc_id_col: str = "doc_id") -> DataFrame:
    """(query id, rank, doc id, score): the k documents of the highest scores above 0 of every query, equal ones by ascending id
    (a null id first).

    Queries are asked in blocks of bounded size, each against all shards: once for the lengths of its words' lists, once for
    seeds, once for the answers. A task keeps k answers a query, which its later shards must reach.
    """
    out = None
    kind = queries.schema[id_col].dataType.simpleString()
    for block in _blocks(queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), index.config.block_cells):
        answers = _answer(index, block)
        numbered = queries.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query int, {id_col} {kind}")
        done = stage(answers.join(numbered, "query").select(id_col, "rank", F.col("id").alias(doc_id_col), "score"), "lexical-answers")
        out = done if out is None else out.unionByName(done)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"{id_col} {kind}, rank int, {doc_id_col} {index.id_type}, score bigint")
    return out


def _answer(index: LexicalIndex, block: list[tuple[Any, list[bytes]]]) -> DataFrame:
    spark, config = index.shards.sparkSession, index.config
    words = sorted({w for _, found in block for w in found})
    if not words:
        return spark.createDataFrame([], f"query int, score bigint, id {index.id_type}, rank int")
    place = {w: i for i, w in enumerate(words)}
    asked = _asked(block, place, _weights(index.n_docs, _list_lengths(index, words)))
    shared = spark.sparkContext.broadcast(pickle.dumps((words, asked)))  # one block of queries

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asked = pickle.loads(shared.value)
        known, names = _Best(np.zeros(len(asked.word), np.int64), config.k), pa.array(words, pa.binary())
        for row in _opened(batches):
            query, score = seed_scores(Shard(row), asked, names, config)
            known.add(query, score, [0] * len(query))
        found = [(q, s) for q, best in enumerate(known.found) for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array([s for _, s in found], pa.int64())], names=["query", "score"])

    by_query = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = map_batches(index.shards, seeds, "query int, score bigint").withColumn("_at", F.row_number().over(by_query)).where(F.col("_at") == config.k)
    floor = np.zeros(len(block), np.int64)
    for r in kth.collect():  # at most a row a query of the block
        floor[r["query"]] = r["score"]
    reach = spark.sparkContext.broadcast(floor)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asked = pickle.loads(shared.value)
        best, names, kind = _Best(reach.value, config.k), pa.array(words, pa.binary()), pa.null()
        for row in _opened(batches):
            shard = Shard(row)
            kind = shard.ids.type
            search_shard(shard, asked, names, best, config)
        found = [(q, s, i) for q, rows in enumerate(best.found) for s, i in rows]
        if found:
            q, s, i = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array(i, kind)], names=["query", "score", "id"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    found = map_batches(index.shards, answers, f"query int, score bigint, id {index.id_type}")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.k)
