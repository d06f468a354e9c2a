"""Exact duplicates, ranked search and the prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from sessionscope.llm import exact_dups, lexical, prefix_trie

from .data import awkward, awkward_rows, empty


def plain_copies(rows):
    """rows: (id, text) → multiset of (id, keep_id, group_size, kept, sha256)."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest, kept = hashlib.sha256(text.encode()).hexdigest(), False
        for i in ids:
            out[(i, keep, len(ids), i == keep and not kept, digest)] += 1
            kept = kept or i == keep
    return out


def marked(docs, index):
    return Counter(map(tuple, exact_dups.mark_copies(docs, index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


CHAINS = exact_dups.DedupConfig(bucket_bytes=40, owner_bytes=100, held_bytes=3000, step_bits=1, key_bits=3)


@pytest.mark.parametrize("config", [exact_dups.DedupConfig(), CHAINS, exact_dups.DedupConfig(bucket_bytes=300, step_bits=2)])
def test_copies_equal_plain_groups(spark, config):
    rng = random.Random(3)
    texts = ["", None, "é", "a" * 3000, *(f"text {i}" for i in range(60))]
    rows = [(rng.randrange(300) if rng.random() > 0.03 else None, rng.choice(texts)) for _ in range(400)] + [(1000 + i, "hot") for i in range(300)] + [(7, "same row")] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    index = exact_dups.build_index(docs, config=config)
    assert marked(docs, index) == plain_copies(rows)
    entries = index.entries.collect()
    assert sum(e.n for e in entries) == len(rows) and len({(e.key, e.chain) for e in entries}) == len(entries)
    if config.key_bits == 3:
        assert max(e.chain for e in entries) > 3  # several texts under one key
    buckets = [(b.prefix << (config.key_bits - b.depth), b.depth, b.bytes, b.texts) for b in index.directory.collect()]
    assert all(size <= config.bucket_bytes or texts == 1 or depth == config.key_bits for _, depth, size, texts in buckets)
    homes = [sum(low >> (config.key_bits - d) == e.key >> (config.key_bits - d) for low, d, _, _ in buckets) for e in entries]
    assert set(homes) == {1}
    kept = exact_dups.drop_copies(docs, config=config).collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter((i, t) for t, i in {t or "": max((j for j, u in rows if (u or "") == (t or "") and j is not None), default=None) for _, t in rows}.items())


def test_copies_of_awkward_tables(spark):
    docs = awkward(spark)
    assert marked(docs, exact_dups.build_index(docs)) == plain_copies([r[:2] for r in awkward_rows()])
    kept = exact_dups.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[1] or "" for r in awkward_rows()})
    assert exact_dups.mark_copies(empty(spark), exact_dups.build_index(empty(spark))).collect() == []
    assert exact_dups.drop_copies(empty(spark)).collect() == []


def test_index_is_added_to(spark):
    rows = [(i, f"t{i % 7}") for i in range(30)]
    frame = lambda part: spark.createDataFrame(part, "doc_id string, text string")
    rows = [(f"id{i:03d}", t) for i, t in rows]
    config = exact_dups.DedupConfig(bucket_bytes=4, step_bits=2)
    first = exact_dups.build_index(frame(rows[:11]), config=config)
    both = exact_dups.build_index(frame(rows[11:]), config=config, index=first)
    assert marked(frame(rows), both) == plain_copies(rows)
    assert both.global_depth >= first.global_depth > 0
    with pytest.raises(ValueError, match="key width"):
        exact_dups.build_index(frame(rows), index=first, config=exact_dups.DedupConfig(key_bits=5))


def plain_search(docs, items, k=10):
    """docs, items: lists of (id, text) → per item the ranked (doc id, score)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for _, text in items:
        found = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words(text) if c[w])
            if score > 0:
                found.append((-score, i is not None, i, score))
        out.append([(i, s) for _, _, i, s in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]])
    return out


def ranked(answers, items):
    got = defaultdict(list)
    for r in sorted(answers.collect(), key=lambda r: r.rank):
        assert r.rank == len(got[r.item_id]) + 1
        got[r.item_id].append((r.doc_id, r.score))
    return [got[i] for i, _ in items]


SMALL = lexical.LexicalConfig(shard_bytes=900, cells=64, block_cells=40, step_nodes=2, seeds=1, seed_terms=1)


@pytest.mark.parametrize("config", [lexical.LexicalConfig(), SMALL])
def test_search_equals_brute_force(spark, config):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "日本", "X9"]
    text = lambda n: rng.choice([" ", ", ", "\n--"]).join(rng.choice(vocabulary[: rng.choice([5, 43])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40]))) for i in range(150)] + [(500, None), (501, ""), (502, " .,; "), (None, "w1 w2"), (503, "W1 " * 3000)]
    docs += [(600 + i, "w1 w2 w3 日本") for i in range(40)] + [(700, "w3 w4")] * 3  # ties and repeated rows
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(12)] + [(20, None), (21, ""), (22, "unheard of"), (23, "w1 w1 w2 été"), (24, "x9 ÉTÉ"), (25, "w3 w4")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, bits string, query int").repartition(3)
    index = lexical.build_index(frame, config=config)
    assert (index.shards.count() > 5) == (config is SMALL)
    answers = lexical.search(index, spark.createDataFrame(items, "item_id bigint, text string"))
    assert ranked(answers, items) == plain_search(docs, items)


def test_search_of_awkward_and_empty_tables(spark):
    rows, items = [r[:2] for r in awkward_rows()], [(1, "alpha BETA apache license"), (2, "word"), (3, "9")]
    ask = spark.createDataFrame(items, "item_id int, text string")
    assert ranked(lexical.search(lexical.build_index(awkward(spark)), ask), items) == plain_search(rows, items)
    assert lexical.search(lexical.build_index(empty(spark)), ask).collect() == []
    assert lexical.search(lexical.build_index(awkward(spark)), ask.where("false")).collect() == []


def test_shard_counts_and_walks():
    """Terms are counted as they are found, across slices of a column; a tree gives every document's own scores back."""
    texts = [b"", b"a", b" a b", "é-é".encode(), b"", b"b-", b"1", b"zz zz A"]
    column = pa.array([b"x y", *texts], pa.binary())[1:]
    assert lexical._term_count(column).tolist() == [len(lexical.terms(t)) for t in texts]
    full = [t for t in texts if lexical.terms(t)]
    shard = lexical.Shard(lexical.make_shard(pa.array(range(len(full))), full, 6, 10))
    words = pa.array([b"a", b"b", b"zz", b"none"], pa.binary())
    low, high = shard.lists(words)
    for w, lo, hi in zip(words.to_pylist(), low, high, strict=True):
        import numpy as np

        assert sorted(shard.documents(np.arange(lo, hi)).tolist()) == [i for i, t in enumerate(full) if w in lexical.terms(t)]
        assert (np.diff(shard.impacts[0][lo:hi]) <= 0).all()


def plain_trie(rows, rebuilt=True):
    convs = defaultdict(list)
    for c, no, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            digest = hashlib.sha256(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}".encode()).hexdigest()
            convs[c].append((no is not None, no or 0, digest, turn))
    convs = {c: [t for *_, t in sorted(v)] for c, v in convs.items()}
    whole = convs
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        whole = {c: convs.get(c - int(math.fmod(c, 5)), [])[: h[c]] + own[h[c] :] for c, own in convs.items()}
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    parents = Counter(q[:-1] for q in nodes if q)
    out = set()
    for p, members in nodes.items():
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below[p])
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        leaves = sum(parents[q] == 0 for q in below[p])
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), parents[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(rng):
    rows = []
    for c in [*range(-6, 30), 1000, 1001]:
        shared = rng.choice(["one", "two"])
        for turn in range(rng.choice([0, 1, 3, 12])):
            rows.append((c, turn if rng.random() > 0.1 else None, rng.choice(["user", None]), f"{shared} {turn}" if turn < 9 else rng.choice(["é", "", None])))
    rows += [(40 + i, t, "user", f"copy {t}") for i in range(12) for t in range(14)]  # equal to the end
    rows += [(60, t, "user", f"long {t}") for t in range(120)] + [(None, 0, "user", "no conversation")]
    rows += [(70, 1, "user", x) for x in "cab"] + [(71, 2, "a", "b")] * 3  # equal numbers and repeated rows
    return rows


@pytest.mark.parametrize("build", [prefix_trie.rebuild, prefix_trie.sequences])
def test_trie_equals_plain_one(spark, build):
    rows = trie_rows(random.Random(8))
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int, node int").repartition(4)
    trie = prefix_trie.build_trie(build(table))
    got = [tuple(r) for r in prefix_trie.with_end_digests(trie).select(*NODE).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows, build is prefix_trie.rebuild)
    assert trie.members.count() == len({r[0] for r in rows} - {None})


def test_trie_of_few_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    none = spark.createDataFrame([], schema)
    assert prefix_trie.with_end_digests(prefix_trie.build_trie(prefix_trie.rebuild(none))).collect() == []
    for rows in ([(3, 0, "user", "x" * 100_000)], [(5, None, None, None)]):
        one = prefix_trie.with_end_digests(prefix_trie.build_trie(prefix_trie.rebuild(spark.createDataFrame(rows, schema))))
        assert {tuple(r) for r in one.select(*NODE).collect()} == plain_trie(rows)
