"""Near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np

from sessionscope.llm import near_dups, queries
from sessionscope.llm.components import connected_components
from sessionscope.llm.near_dups import NearDupConfig
from tests.llm.data import SCHEMA, awkward, awkward_rows, empty


def brute(docs, k):
    sets = []
    for _, t in docs:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    big = lambda x: (x is None, x)
    return sorted((docs[i][0] or -1, len(sets[i]), min(groups[find(i)], key=big)) for i in range(len(docs)))


def got(df):
    return sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in df.collect())


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op3_odd_sketch_dups(spark, sf_dir)
    assert got(rows) == brute(docs, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect())


def test_chains_and_groups_of_near_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(6):
        words = [rng.choice(vocab) for _ in range(120)]
        for i in range(25):
            rows.append((len(rows), " ".join(words)))
            if i % 2 or g < 3:  # a chain that drifts away, and groups around one text
                words = list(words)
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(1, 5)] = [rng.choice(vocab) for _ in range(rng.randrange(5))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in (2, 5):
        assert got(near_dups.near_duplicates(df, config=NearDupConfig(shingle=k))) == brute(rows, k)


def test_boilerplate_buckets_are_tiled(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    common = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(1200):  # similarities from 0.5 to 0.75 and around the threshold, sizes over several steps of the window
        words = list(common[: rng.choice((30, 45, 60))])
        at = rng.randrange(len(words) + 1)
        words[at:at] = [rng.choice(vocab) for _ in range(rng.choice((3, 5, 8, 20)))]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 2)
    assert len({c for _, _, c in want}) < 1200
    assert got(near_dups.near_duplicates(df, config=NearDupConfig(shingle=2, tile=40, pivot_rounds=1))) == want
    # every open bucket dealt anew by rare items, whole and in tiles
    assert got(near_dups.near_duplicates(df, config=NearDupConfig(shingle=2, tile=40, pivot_rounds=1, item_cost=0))) == want


def test_rare_items_bring_linked_sets_together_and_few_others(spark):
    rng = random.Random(21)
    common = list(range(70))
    sets = [common + [1000 * (i + 1) + j for j in range(30)] for i in range(1500)]  # 0.54 alike, all of them
    for i in range(0, 60, 2):  # linked ones, some just at the threshold
        drop = rng.choice((1, 5, 11))
        sets.append(sets[i][: 100 - drop] + [10_000_000 + 100 * i + j for j in range(drop)])
    sets += [[5], [5], [5, 6], [0, 1, 2, 3, 4], [0, 1, 2, 3]]  # sets of a few items, at the threshold too
    rows = spark.createDataFrame(list(enumerate(sets)), "node bigint, items array<bigint>")
    dealt = near_dups._rare_item_buckets(rows, rows.select("node"), NearDupConfig())
    keys = {}
    for r in dealt.collect():
        keys.setdefault(r.key, []).append(r.node)
    met = {(u, v) for nodes in keys.values() for u in nodes for v in nodes if u < v}
    full = [set(x) for x in sets]
    linked = set()
    for v in range(len(full)):
        for u in range(v):
            c = len(full[u] & full[v])
            if 100 * c >= 80 * (len(full[u]) + len(full[v]) - c):
                linked.add((u, v))
    assert len(linked) >= 30 and linked <= met
    assert len(met) < len(sets) * 2  # of more than a million pairs


def test_one_id_with_several_texts(spark):
    """What stays is told by id and text, so a repeated id brings no duplicate back."""
    w, other = "a b c d e f g", "one two three four five six"
    df = spark.createDataFrame([(3, w), (5, other), (5, w), (6, "h i j k"), (6, "h i j  k"), (7, None), (7, "")], "doc_id bigint, text string")
    left = sorted(((r.doc_id, r.text) for r in near_dups.drop_near_duplicates(df).collect()), key=str)
    assert [x for x in left if x[0] != 6] == [(3, w), (5, other), (7, ""), (7, None)]
    assert len([x for x in left if x[0] == 6]) == 1


def test_awkward(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert got(near_dups.near_duplicates(awkward(spark), config=NearDupConfig(shingle=2))) == brute(rows, 2)
    assert near_dups.near_duplicates(empty(spark)).count() == 0
    kept = near_dups.drop_near_duplicates(awkward(spark), config=NearDupConfig(shingle=2))
    assert kept.columns == awkward(spark).columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 17]


def test_odd_sketch_estimates_high_similarity():
    config = NearDupConfig()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = base.copy()
    other[:100] = rng.integers(0, 1 << 63, 100, dtype=np.uint64)  # Jaccard 900 / 1100
    a, b = near_dups.odd_sketches(near_dups.minhash([np.unique(base), np.unique(other)], config), config)
    bits = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
    differ = -config.sketch_bits / 2 * np.log(1 - 2 * bits / config.sketch_bits)
    assert abs(1 - differ / (2 * config.samples) - 900 / 1100) < 0.12
    assert bits <= config.most_bits()
    a, b = near_dups.set_parities([np.unique(base), np.unique(other)], config)
    assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= 200


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)] + [(100 + i, 101 + i) for i in range(40)]
    rows = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 25)} | {100 + i: 100 for i in range(41)}
    assert rows == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_schema_is_kept(spark):
    assert near_dups.drop_near_duplicates(empty(spark)).columns == spark.createDataFrame([], SCHEMA).columns
