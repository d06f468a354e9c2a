"""Toxicity by noisy-channel deobfuscation.

Writers hide words behind look-alike characters, spaces and repeated letters. Each hidden token is a lattice: every
observed character may stand for itself, for a letter it resembles, or (if repeated or a mark) for nothing. Viterbi
decoding picks the path of least cost under a channel cost and a character trigram model that is counted over
all documents. The restored words are scored with weights learnt from labelled documents.

* Trigram counts: every document, in one pass with partial sums; a table of 28^3 counts.
* Weights: a bounded sample of labelled training rows (``sample``, by hash of the id). Features are whole
  restored words, and stems (prefixes, inner five-grams) of other words, kept where they are significantly commoner in toxic rows.
* Scores: a logistic curve over the sum of the weights of a document's distinct restored words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.memo import Memo
from sessionscope.operators.arrow import map_batches
from sessionscope.operators.staging import stage

# Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}

SYMBOLS = 28  # boundary, a to z, any other letter
OTHER = SYMBOLS - 1
SELF_COST, SWAP_COST, DROP_COST, KEEP_PAIR_COST = 0.0, 0.7, 2.5, 1.0
MOST_EVIDENCE = 12.0  # a document's weights beyond this add nothing

WORDS = re.compile(r"[^\W\d_]+")
#: What a hidden token has: a character beside a letter that may stand for another, or a letter three times in a row.
HIDDEN = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*]|[0-9@$!|+(€£¡*][^\W\d_]|([^\W\d_])\1\1")
#: Three or more single characters set apart by one space or mark each.
SPACED = re.compile(r"(?<![^\s])[^\W_](?:[ ._*\-][^\W_]){2,}(?![^\s.,;:!?])")
MARKS_BEHIND = re.compile(r"([^\w\s])\1*[.,;:!?]*$")


@dataclass(frozen=True)
class ToxicityConfig:
    sample: int = 5000  # labelled rows used for the weights
    threshold: float = 0.7
    min_toxic_rows: int = 8
    min_weight: float = 2.0  # of a word: log odds less two standard errors
    min_stem_weight: float = 2.5
    min_stem_words: int = 4  # different words of toxic rows that a stem is seen in
    smoothing: float = 0.3  # of the trigram model


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


# ---- the character model


_BYTE_SYMBOL = np.zeros(256, np.uint8)
_BYTE_SYMBOL[97:123] = np.arange(1, 27)
_BYTE_SYMBOL[65:91] = np.arange(1, 27)
_BYTE_SYMBOL[0xC3:0xF5] = OTHER  # lead bytes of letters beyond ASCII


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of symbol triplets over all documents; runs of anything but letters count as one boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                raw = np.frombuffer(b" " + t + b" ", np.uint8)
                s = _BYTE_SYMBOL[raw[(raw < 0x80) | (raw >= 0xC0)]].astype(np.int32)  # a symbol a character
                s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["g", "n"])

    counts = map_batches(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), run, "g int, n bigint")
    rows = counts.groupBy("g").agg(F.sum("n").alias("n")).collect()  # 28^3 rows at most
    out = np.zeros(SYMBOLS**3, np.float64)
    for r in rows:
        out[r["g"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def trigram_costs(counts: np.ndarray, smoothing: float) -> list:
    """-log p(c | a b), with the bigram's distribution behind the trigram's."""
    pair = counts.sum(axis=0) + smoothing
    behind = pair / pair.sum(axis=1, keepdims=True)
    p = (counts + 5 * behind[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return (-np.log(p)).tolist()


def restore(token: str, costs: list) -> str:
    """The likeliest word behind a token: Viterbi over (last two symbols)."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    i = 0
    while i < len(token):
        c, run = token[i], 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        i += run
        if c.isalpha():
            options = [(c, SELF_COST)] + ([(c + c, SELF_COST if run == 2 else KEEP_PAIR_COST)] if run > 1 else [])
        else:
            options = [(x, SWAP_COST) for x in LOOKALIKES.get(c, "")] + ([(x + x, SWAP_COST + KEEP_PAIR_COST) for x in LOOKALIKES.get(c, "")] if run > 1 else []) + [("", DROP_COST)]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, out) in best.items():
            for letters, more in options:
                x, y, total = a, b, cost + more
                for letter in letters:
                    s = symbol(letter)
                    total += costs[x][y][s]
                    x, y = y, s
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, out + letters)
        best = after
    return min(((cost + costs[a][b][0], out) for (a, b), (cost, out) in best.items()), default=(0.0, ""))[1]


class Restorer:
    """Distinct words of texts with hidden ones restored; remembers tokens up to a fixed number of bytes."""

    def __init__(self, costs: list):
        self.costs = costs
        self.memo = Memo()

    def token_words(self, token: str) -> tuple[str, ...]:
        """Words that a lower-case token without spaces holds, as written and, if it hides something, restored."""
        if token.isalpha() and not HIDDEN.search(token):
            return (token,)
        found = set(WORDS.findall(token))
        if HIDDEN.search(token):
            core = MARKS_BEHIND.sub("", token)
            if not ("@" in core.strip("@") and "." in core or "://" in core):  # an address hides nothing
                found.update(restore(x, self.costs) for x in {token.strip(".,;:?\"'"), core} if x and HIDDEN.search(x))
        found.discard("")
        return tuple(found)

    def spaced_words(self, low: str) -> list[str]:
        """Words restored from single characters set apart."""
        return [w for m in SPACED.finditer(low) if (w := restore(re.sub(r"[ ._*\-]", "", m[0]), self.costs))]

    def words(self, text: str) -> set[str]:
        low = text.lower()
        found = set(self.spaced_words(low))
        for token in set(low.split()):
            ws = self.memo.find(token)
            if ws is None:
                ws = self.token_words(token)
                if len(token) < 64:
                    self.memo.keep(token, ws)
            found.update(ws)
        return found


# ---- weights and scores


def grams(word: str) -> set[str]:
    """Prefixes of three to six letters and inner five-grams: what words of one stem share."""
    return {"^" + word[:n] for n in range(3, min(7, len(word)))} | {word[i : i + 5] for i in range(1, len(word) - 4)}


@dataclass
class ToxicityModel:
    costs: list
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -3.0

    def word_weight(self, word: str) -> float:
        own = self.weights.get("=" + word)
        return own if own is not None else max((self.weights[f] for f in grams(word) if f in self.weights), default=0.0)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.offset))))


def _weights(counts: list, n_toxic: int, n_clean: int, least: float) -> dict[str, float]:
    """Log odds of being in a toxic row less two standard errors, of the features (f, toxic, clean) that reach ``least``."""
    out = {}
    for r in counts:
        t, c = r["toxic"], r["clean"]
        odds = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((c + 0.5) / (n_clean - c + 0.5))
        weight = odds - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if weight >= least:
            out[r["f"]] = weight
    return out


def _row_counts(features: DataFrame, least_toxic: int) -> DataFrame:
    """(f, toxic, clean): in how many rows of each label a feature stands; ``features`` has arrays of distinct ones. Rare ones are left out."""
    counted = features.select("y", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), (F.count("*") - F.sum("y")).alias("clean"))
    return counted.where(F.col("toxic") >= least_toxic)


def fit_weights(sample: DataFrame, model: ToxicityModel, config: ToxicityConfig) -> None:
    """Weights and the logistic curve, from rows (words, y): distinct words, label 0 or 1. Without both classes: no weights, all scores low.

    Whole words come first. Stems are then counted over the other words only, so that what merely begins like a
    known word weighs nothing, and need several different words behind them. Spark counts; the driver sees the
    features of ``min_toxic_rows`` rows or more, and a number a row for the curve.
    """
    r = sample.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n_toxic = int(r["t"] or 0)
    n_clean = r["n"] - n_toxic
    if not n_toxic or not n_clean:
        return
    words = _row_counts(sample.withColumnRenamed("words", "fs"), config.min_toxic_rows)
    whole = _weights(words.collect(), n_toxic, n_clean, config.min_weight)

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set().union(*[grams(w) for w in ws if w not in whole])) for ws in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1)], names=["fs", "y"])

    stem_counts = _row_counts(sample.select("words", "y").mapInArrow(stems, "fs array<string>, y int"), config.min_toxic_rows)
    single = sample.where("y = 1").select(F.explode("words").alias("w")).distinct().select(F.array("w").alias("words"), F.lit(1).alias("y"))
    behind = single.mapInArrow(stems, "fs array<string>, y int").select(F.explode("fs").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    behind = behind.where(F.col("n") >= config.min_stem_words)
    kept = stem_counts.join(behind, F.col("f") == F.col("g"), "left_semi").collect()
    model.weights = {"=" + w: x for w, x in whole.items()} | _weights(kept, n_toxic, n_clean, config.min_stem_weight)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [sum(map(model.word_weight, ws)) for ws in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), b.column(1)], names=["x", "y"])

    points = sample.select("words", "y").mapInArrow(evidence, "x double, y int").collect()  # config.sample rows at most
    x = np.minimum([p["x"] for p in points], MOST_EVIDENCE)
    y = np.array([p["y"] for p in points], float)
    a, b = 1.0, -2.0
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * x).sum() + 0.5 * a, (p - y).sum() + 0.05 * b])
        hess = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    model.slope, model.offset = a, b


def held_out(doc_id: Column) -> Column:
    """The third of the ids that learning never sees; null ids aren't in it (and have no labels)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:  # noqa: B008
    """Character model over all documents; weights from at most ``config.sample`` labelled rows outside the held-out third."""
    costs = trigram_costs(trigram_counts(docs, text_col), config.smoothing)
    model = ToxicityModel(costs)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(config.sample)  # so many rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for b in batches:
            sets = [sorted(restorer.words(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string())), b.column(1)], names=["words", "y"])

    rows = texts.select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    fit_weights(stage(map_batches(rows, run, "words array<string>, y int"), "toxicity-sample"), model, config)
    return model


class Scorer:
    """Scores of texts; remembers, up to a fixed number of bytes, which words of a token carry weight, most often none."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.restorer = Restorer(model.costs)
        self.memo = Memo()

    def _weighted(self, words: Iterable[str]) -> tuple[tuple[str, float], ...]:
        return tuple((w, x) for w in words if (x := self.model.word_weight(w)) > 0)

    def __call__(self, raw: bytes | None) -> float:
        low = (raw or b"").decode("utf-8", errors="replace").lower()
        hits = dict(self._weighted(self.restorer.spaced_words(low)))
        memo = self.memo
        for token in set(low.split()):
            found = memo.find(token)
            if found is None:
                found = self._weighted(self.restorer.token_words(token))
                if len(token) < 64:
                    memo.keep(token, found)
            if found:
                hits.update(found)
        return self.model.score(min(sum(sorted(hits.values())), MOST_EVIDENCE))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text, 0 to 1. Null and empty texts have no evidence and get the lowest score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a trigram table and the features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            scores = [score(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", config: ToxicityConfig = ToxicityConfig()) -> DataFrame:  # noqa: B008
    """The rows scored under the threshold, all columns, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([score(t) < config.threshold for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
