"""Byte-level BPE encoding and decoding with a public vocabulary file.

Texts are cut into words by the vocabulary's pattern (special strings first). Words that an executor's memo
doesn't hold are encoded together: the symbols of all of them lie in one flat array, and in every round each
word merges its lowest-ranked adjacent pair, which is found by binary search over the sorted pair keys. Words
that have no pair left leave the array. A long word (unspaced script, encoded data) has too many rounds for that: it is an
array of its own, in which places wait by rank and only those beside a merge are looked up again. The vocabulary is
read once on the driver and has a fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm.memo import Memo
from sessionscope.operators.arrow import map_batches

# Fixed value: the word pattern of byte-level BPE, with Unicode white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_RANK = np.iinfo(np.int64).max


def _byte_characters() -> list[str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Bytes of every id, ids of single bytes, sorted pair keys with their ranks and merged ids, special strings."""

    token_bytes: list[bytes]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    specials: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {c: b for b, c in enumerate(_byte_characters())}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token_bytes = [b""] * (1 + max([*ids.values(), *specials.values()]))
        for token, i in ids.items():
            token_bytes[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
        for token, i in specials.items():
            token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        byte_ids = np.array([ids[c] for c in _byte_characters()], np.int64)
        return cls(token_bytes, byte_ids, keys[order], order.astype(np.int64), merged[order], specials)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.token_bytes[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids (as bytes of int32) of non-empty words, by rounds over all of them at once."""
    ended: list[tuple[np.ndarray, np.ndarray]] = []  # words that have left, with their symbols
    symbols = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    while len(symbols):
        keys = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(vocab.pair_keys, keys), len(vocab.pair_keys) - 1)
        known = (vocab.pair_keys[at] == keys) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, vocab.pair_ranks[at], NO_RANK), NO_RANK)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lengths = np.diff(np.append(starts, len(word)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        done = lowest == NO_RANK
        if done.any():
            ended.append((word[done], symbols[done].astype(np.int32)))
        hit = (rank == lowest) & ~done
        # equal symbols in a row: of overlapping pairs every second one counts, from the left
        first = hit & ~np.append(False, hit[:-1] & (word[1:] == word[:-1]))
        run_start = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit &= (np.arange(len(hit)) - run_start) % 2 == 0
        left = np.flatnonzero(hit)
        symbols[left] = vocab.pair_ids[at[left]]
        keep = ~done
        keep[left + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not ended:
        return []
    places, ids = (np.concatenate(x) for x in zip(*ended, strict=True))
    flat = ids[np.argsort(places, kind="stable")].tobytes()
    cuts = (4 * np.cumsum(np.bincount(places, minlength=len(words)))).tolist()
    return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class _Queue:
    """Places of pairs by rank: the lowest rank's places come out together, in order."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.ranks: list[int] = []

    def add(self, rank: np.ndarray, place: np.ndarray) -> None:
        known = rank != NO_RANK
        rank, place = rank[known], place[known]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank[:0]
        for r, part in zip(rank[cuts].tolist(), np.split(place, cuts[1:]), strict=bool(len(cuts))):
            if r not in self.places:
                self.places[r] = []
                heapq.heappush(self.ranks, r)
            self.places[r].append(part)

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.ranks)
        return r, np.unique(np.concatenate(self.places.pop(r)))


def merge_long_word(word: bytes, vocab: Vocabulary) -> np.ndarray:
    """Token ids of one long word. A round merges the lowest-ranked pair wherever it stands, and only pairs beside a
    merge get a new rank, so the work follows the word's length and the vocabulary's, not their product."""
    n = len(word)
    symbols = np.append(vocab.byte_ids[np.frombuffer(word, np.uint8)], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours that are left; n stands for the end
    last = len(vocab.pair_keys) - 1

    def lookup(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and row of the pair that starts at each place."""
        right = symbols[after[place]]
        keys = symbols[place] << 32 | right
        at = np.minimum(np.searchsorted(vocab.pair_keys, keys), last)
        return np.where((vocab.pair_keys[at] == keys) & (right >= 0), vocab.pair_ranks[at], NO_RANK), at

    queue = _Queue()
    everywhere = np.arange(n)
    queue.add(lookup(everywhere)[0], everywhere)
    while queue.ranks:
        r, place = queue.pop()
        place = place[symbols[place] >= 0]
        rank, at = lookup(place)
        place, at = place[rank == r], at[rank == r]
        if not len(place):
            continue
        # equal symbols in a row: of overlapping pairs every second one counts, from the left
        chained = np.append(False, after[place[:-1]] == place[1:])
        start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(place))))
        chosen = (np.arange(len(place)) - start) % 2 == 0
        place, at = place[chosen], at[chosen]
        gone = after[place]
        symbols[place] = vocab.pair_ids[at]
        symbols[gone] = -1
        after[place] = after[gone]
        inside = after[place] < n
        before[after[place][inside]] = place[inside]
        left = before[place]
        beside = np.unique(np.concatenate([place, left[left >= 0]]))
        queue.add(lookup(beside)[0], beside)
    return symbols[symbols >= 0].astype(np.int32)


LONG_WORD = 1024  # bytes from which a word is merged by itself


class Encoder:
    """Encodes texts; remembers the ids of short words up to a fixed number of bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocab.specials, key=len, reverse=True)))) if vocab.specials else None
        self.memo = Memo(40 << 20)

    def _words(self, text: str) -> list[str | int]:
        """Words, and ids of special strings in their places."""
        if self.special is None or not self.special.search(text):
            return self.find(text)
        out: list[str | int] = []
        end = 0
        for m in self.special.finditer(text):
            out += [*self.find(text[end : m.start()]), self.vocab.specials[m[0]]]
            end = m.end()
        return out + self.find(text[end:])

    def _merged(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with the bytes of their ids, a bounded number of them at a time."""
        short: list[tuple[str, bytes]] = []
        held = 0
        for w in words:
            raw = w.encode()
            if len(raw) >= LONG_WORD:
                yield w, merge_long_word(raw, self.vocab).tobytes()
                continue
            short.append((w, raw))
            held += len(raw)
            if held > 1 << 18:
                yield from zip([w for w, _ in short], merge_words([r for _, r in short], self.vocab), strict=True)
                short, held = [], 0
        if short:
            yield from zip([w for w, _ in short], merge_words([r for _, r in short], self.vocab), strict=True)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self._words(t) for t in texts]
        have = self.memo.find_all(dict.fromkeys(chain.from_iterable(cut)))
        new = [w for w, ids in have.items() if ids is None]
        fresh = {w: w.to_bytes(4, "little") for w in new if isinstance(w, int)}
        fresh.update(self._merged([w for w in new if isinstance(w, str)]))
        have |= fresh
        short = {w: ids for w, ids in fresh.items() if isinstance(w, int) or len(w) < 64}
        self.memo.keep_all(short)
        return [np.frombuffer(b"".join(map(have.__getitem__, ws)), np.int32) for ws in cut]


def _texts(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", errors="replace") for b in column.cast(pa.binary()).to_pylist()]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary.load(path))  # a fixed-size table


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_ids) of every row's whole text; a null text counts as empty and has no tokens.

    The same ids as the vocabulary's own library gives without special tokens added; special strings that
    stand in a text are their single id.
    """
    vocab = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for b in _pieces(batches):
            ids = encoder.encode(_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), _lists(ids)], names=["id", "n_tokens", "token_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, f"id {kind}, n_tokens bigint, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) of token id arrays. Bytes that are no UTF-8 become replacement characters; a null array is an empty text."""
    vocab = _shared(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            texts = [vocab.value.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    ids = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_batches(ids, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again in one pass, ids not kept."""
    vocab = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = list(map(str, range(len(vocab.value.token_bytes)))).__getitem__
        bytes_of = vocab.value.token_bytes.__getitem__
        encoder = Encoder(vocab.value)
        for b in _pieces(batches):
            found = [ids.tolist() for ids in encoder.encode(_texts(b.column(1)))]
            lists = [",".join(map(number, ids)) for ids in found]
            texts = [b"".join(map(bytes_of, ids)).decode("utf-8", errors="replace") for ids in found]
            numbers = list(map(len, found))
            digests = [[hashlib.sha256(x.encode()).hexdigest() for x in xs] for xs in (lists, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(numbers, pa.int64()), *[pa.array(x, pa.string()) for x in digests]],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
