"""Sharding, PII, mixing and license scans against plain Python on the same rows."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionscope.llm import licenses, mixing, oracles, pii, queries, sharding
from tests.llm.data import SCHEMA, awkward, awkward_rows, empty


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- sharding


def check_shards(rows, docs, shards, slack):
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((d[0] or -1, len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        assert sorted(m.slot for m in members) == list(range(len(members)))
    sizes = [sum(m.size for m in by[s]) for s in range(shards)]
    mean, largest = sum(sizes) / shards, max(r.size for r in rows)
    assert max(abs(s - mean) for s in sizes) <= slack * mean + 5 * largest
    return sizes


def test_shards_of_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    rows = queries.op1_kd_shards(spark, sf_dir).collect()
    check_shards(rows, docs, 24, 0.02)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_split_a_hot_value_evenly(spark):
    rows = [(i, "x" * 92, "en", "hot" if i % 3 else f"s{i}", 92) for i in range(6000)]
    found = sharding.kd_tree_shards(spark.createDataFrame(rows, SCHEMA), shards=6).collect()
    sizes = check_shards(found, rows, 6, 0.01)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 6


def plain_tree(rows, shards):
    """Rows (size, coords, fine) to shards: sort by the key of the widest dimension and cut where the bytes come nearest the share."""
    out, extent = {}, None

    def split(members, first, k):
        nonlocal extent
        if k == 1 or not members:
            out.update((m, first) for m in members)
            return
        spread = [(max(rows[m][1][d] for m in members), min(rows[m][1][d] for m in members)) for d in range(3)]
        extent = extent or [max(1, h - lo) for h, lo in spread]
        dim = max(range(3), key=lambda d: ((spread[d][0] - spread[d][1]) / extent[d], -d))
        ordered = sorted(members, key=lambda m: rows[m][1][dim] * sharding.FINE + rows[m][2])
        goal = sum(rows[m][0] for m in members) * (k // 2) / k
        sums = [0]
        for m in ordered:
            sums.append(sums[-1] + rows[m][0])
        at = min(range(len(sums)), key=lambda i: abs(sums[i] - goal))
        split(ordered[:at], first, k // 2)
        split(ordered[at:], first + k // 2, k - k // 2)

    split(list(rows), 0, shards)
    return out


def test_shards_are_the_plain_tree(spark, sf_dir):
    """The cuts found by ever finer ranges are those of sorting, but for rows within the tolerance of a cut."""
    docs = documents(spark, sf_dir)
    lo, hi = docs.agg(F.min("n_chars"), F.max("n_chars")).first()
    at = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32("text").alias("crc"), F.xxhash64("text").alias("x"), F.col("source").alias("d0"), F.col("lang").alias("d1"), F.col("n_chars").cast("double").alias("d2"))
    coords = F.array(*[sharding._coordinate(i, d, float(lo), float(hi)) for i, d in enumerate(sharding.DOCUMENT_DIMENSIONS)])
    # copies lie where the least of each dimension is; what tells them apart is their own metadata
    fine = F.pmod(F.xxhash64("x", "crc", "size"), F.lit(sharding.FINE // sharding.ROWS)) * sharding.ROWS + F.pmod(F.xxhash64("doc_id", "d0", "d1", "d2"), F.lit(sharding.ROWS))
    at = at.withColumn("fine", fine)
    at = at.withColumns({d: F.min(d).over(Window.partitionBy("x", "crc", "size")) for d in ("d0", "d1", "d2")})
    rows = {r.doc_id: (r.size, r.coords, r.fine) for r in at.select("doc_id", "size", coords.alias("coords"), "fine").collect()}
    want = plain_tree(rows, 24)
    got = {r.doc_id: r.shard for r in sharding.kd_tree_shards(docs, shards=24, tolerance=0.0, slack=0.0).collect()}
    assert got == want


def test_shards_keep_copies_together(spark):
    rows = [(i, f"text number {i // 5} " * 5, "en", "a", 80) for i in range(4000)]
    found = {r.doc_id: r.shard for r in sharding.kd_tree_shards(spark.createDataFrame(rows, SCHEMA), shards=8).collect()}
    assert all(len({found[5 * g + i] for i in range(5)}) == 1 for g in range(800))


def test_shards_keep_copies_of_unlike_metadata_together(spark):
    """Copies under other sources, languages and lengths, and without; one group is larger than a shard and is cut."""
    rows = [(i, f"text number {i // 5} " * 5, ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None, i % 13 or None) for i in range(3000)]
    rows += [(10_000 + i, "hot " * 25, f"l{i % 3}", f"s{i % 5}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sharding.kd_tree_shards(df, shards=6).collect()
    check_shards(found, rows, 6, 0.03)
    shard = {r.doc_id: r.shard for r in found}
    assert all(len({shard[5 * g + i] for i in range(5)}) == 1 for g in range(600))
    assert 2 <= len({shard[10_000 + i] for i in range(1500)}) <= 4


def test_shards_of_documents_keep_copies(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).select("doc_id", "text").collect()}
    groups, slack = defaultdict(set), 0.02 * sum(len(t.encode()) + 8 for t in texts.values()) / 24
    size = defaultdict(int)
    for r in queries.op1_kd_shards(spark, sf_dir).collect():
        groups[texts[r.doc_id]].add(r.shard)
        size[texts[r.doc_id]] += r.size
    assert any(len(t) for t in groups) and all(len(s) == 1 for t, s in groups.items() if size[t] <= slack)


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(200)], SCHEMA)
    placed = sharding.kd_tree_shards(docs, shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, f"text {r.doc_id}", r.shard, r.slot) for r in placed.collect())


def test_shards_awkward_and_empty(spark):
    check_shards(sharding.kd_tree_shards(awkward(spark), shards=3).collect(), awkward_rows(), 3, 1.0)
    assert sharding.kd_tree_shards(empty(spark), shards=24).count() == 0
    by_bytes = sharding.kd_tree_shards(awkward(spark), target_bytes=15_000)
    assert by_bytes.select("shard").distinct().count() >= 2
    with pytest.raises(ValueError):
        sharding.kd_tree_shards(empty(spark))


# ---- PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def check_pii(rows, texts):
    for r in rows:
        spans = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r.pii if s["rank"] < 4]
        assert spans == base_spans(texts[r.doc_id]), texts[r.doc_id][:200]


def test_pii_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pii(pii.find_pii(docs).select("doc_id", "pii").collect(), texts)
    for r in queries.op2_pii(spark, sf_dir).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert r.n_email == sum(x.startswith("email:") for x in want)


def test_pii_awkward(spark):
    rows = pii.find_pii(awkward(spark)).select("doc_id", "pii").collect()
    texts = {r[0]: r[1] for r in awkward_rows()}
    check_pii(rows, texts)
    by = {r.doc_id: [(s["kind"], texts[r.doc_id][s["start"] : s["end"]]) for s in r.pii] for r in rows}
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in by[11] and ("ssn", "123-45-6789") in by[11]
    assert not any("765433" in v for _, v in by[11])
    assert by[4] == [] and by[5] == []
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_redaction(spark):
    rows = {r.doc_id: r.text for r in pii.redact(pii.find_pii(awkward(spark))).collect()}
    assert rows[9] == "Mail me at [EMAIL] or [PHONE] from [IP], card [CARD]."
    assert rows[4] is None and rows[5] == "" and rows[7] == "one"


def test_pii_secrets(spark):
    hexes, mixed = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "q8Zr2Kx0Lm5Vb7Nc3Ty"
    texts = {
        1: f'erti token = "{hexes}" theaouor',
        2: f"password: {mixed}",
        3: f"commit {hexes} of the tree, and the key to it",
        4: "token = " + "a" * 40 + " and secret = thereisnodigithereatall",
        5: "AKIA" + "ABCDEFGH12345678" + " and -----BEGIN RSA PRIVATE KEY-----",
        6: f"a bearer {mixed}, x@y.zz, the access key is {hexes}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    by = {r.doc_id: [(s["kind"], texts[r.doc_id][s["start"] : s["end"]]) for s in r.pii] for r in pii.find_pii(df).collect()}
    assert by[1] == [("secret", hexes)] and by[2] == [("secret", mixed)] and by[3] == by[4] == []
    assert [k for k, _ in by[5]] == ["key", "key"]
    assert by[6] == [("secret", mixed), ("email", "x@y.zz"), ("secret", hexes)]
    assert {r.doc_id: r.text for r in pii.redact(pii.find_pii(df)).collect()}[1] == 'erti token = "[SECRET]" theaouor'


def test_pii_of_many_matches(spark):
    """Positions, context and redaction of a text with 100,000 addresses, in time that follows its length."""
    text = " ".join(f"é{i}@x{i % 7}.example" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    check_pii(pii.find_pii(df).collect(), {1: text})
    assert pii.redact(pii.find_pii(df)).first().text == " ".join(["é[EMAIL]"] * 100_000)
    assert time.time() - began < 60


@pytest.mark.parametrize("text", ["1.2.3.4.5.6.7.8", "a@b.c%d@e.f.g", "5 6  7-8", "+1 (((((((", "+12 34567890123", "+1+2+3 444 555 6666", "12-34 56  4111111111111111 2", "4111-1111-1111-1111-4111-1111", "000255.0.0.1", "@a.b", "a@b..c", "x@-.-"])
def test_pii_edge_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    check_pii(pii.find_pii(df).collect(), {1: text})


# ---- mixing


def expected_mix(docs, weights=(5, 2, 1), cap=3):
    size = [(d[0], len((d[1] or "").encode().split()), d[2]) for d in docs]
    names = sorted({s for *_, s in size if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for *_, s in size) else [])
    total = {n: sum(k for _, k, s in size if s == n) for n in names}
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(cap * total[n] for n in capped)
        open_w = sum(w[n] for n in names if n not in capped)
        target = {n: cap * total[n] if n in capped else left * w[n] / open_w for n in names}
        new = {n for n in names if n not in capped and target[n] > cap * total[n]}
        if not new:
            return size, total, target
        capped |= new


def check_mix(rows, docs):
    size, total, target = expected_mix(docs)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((i or -1, k) for i, k, _ in size)
    got = defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        got[r.source] += r.taken
    for n, t in target.items():
        largest = max((k for _, k, s in size if s == n), default=0)
        assert abs(got[n] - t) <= largest


def test_mix_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(mixing.hash_threshold_mix(docs).collect(), rows)


def test_mix_awkward_and_nested(spark):
    rows = [(r[0], r[1], r[3]) for r in awkward_rows()]
    found = mixing.hash_threshold_mix(awkward(spark)).collect()
    size, total, target = expected_mix(rows)
    assert {(r.source, r.source_size) for r in found} == set(total.items())
    assert all(r.target == pytest.approx(target[r.source]) for r in found)
    again = mixing.hash_threshold_mix(awkward(spark)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.hash_threshold_mix(empty(spark)).count() == 0
    one = mixing.hash_threshold_mix(spark.createDataFrame([(1, None, "en", None, None)], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in one] == [(0, 0)]


# ---- licenses


def license_base(text):
    text = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def template_labels(text, config=licenses.LicenseConfig()):
    """Every block against every template."""
    out = set()
    for line in re.split(r"[\n\r]+", text or ""):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        step = config.window // 2
        cuts = [ws[i : i + config.window] for i in range(0, max(len(ws) - step, 1), step)]
        for block in map(set, cuts):
            for label, t in config.templates:
                tw = set(re.sub(licenses.BREAK, " ", t.lower()).split())
                if len(tw & block) >= config.theta * len(tw) - 1e-9:
                    out.add(label)
    return out


def check_licenses(rows, texts):
    for r in rows:
        n, places, first, last, labels = license_base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, places, first, last, labels)
        assert r.labels == ",".join(sorted(template_labels(texts[r.doc_id]) | set(filter(None, labels.split(",")))))
        assert 0 <= r.score <= 1


def test_licenses_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    rows = queries.op9_licenses(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_licenses(rows, texts)


def test_licenses_awkward(spark):
    rows = licenses.scan_licenses(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    check_licenses(rows, {r[0]: r[1] for r in awkward_rows()})
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_licenses_of_repeated_ids(spark):
    """Rows of one id with unlike texts have each its own labels; equal rows have equal ones."""
    texts = ["Released under the MIT License", "nothing here at all", "nothing here at all", None]
    rows = licenses.scan_licenses(spark.createDataFrame([(1, t) for t in texts] + [(None, t) for t in texts], "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.labels) for r in rows) == sorted((i, n, x) for i in ("1", "None") for n, x in ((5, "mit"), (4, ""), (4, ""), (0, "")))


WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software"),
    ("bsd", " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:"),
    ("isc", "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that"),
    ("lgpl", "it under the terms of the GNU Lesser\nGeneral Public License as published by the Free\nSoftware Foundation"),
    ("agpl", "it under the terms of the GNU\nAffero General Public License as published by the\nFree Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the\nterms of the Mozilla Public\nLicense, v. 2.0."),
]


def test_licenses_wrapped_notices(spark):
    """At the start, and behind words that move the notice to any place in the windows; none from words that are far apart."""
    rows = [(f"{i} {n}", "filler\n" * n + text + "\nmore filler" * 50) for i, (_, text) in enumerate(WRAPPED) for n in (0, 7, 19, 20, 33, 140)]
    far = "\nfar off and away\n".join("Released under the MIT License".split())
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([*rows, ("far", far)], "doc_id string, text string")).collect()}
    assert len(got) == len(rows) + 1
    for i, (label, _) in enumerate(WRAPPED):
        for n in (0, 7, 19, 20, 33, 140):
            assert label in got[f"{i} {n}"].labels.split(","), (label, n)
            assert got[f"{i} {n}"].score == 1.0
    assert (got["far"].labels, got["far"].score) == ("", 0.0)


def test_licenses_wrapped_notices_by_sql(spark):
    """The operator and its SQL on wrapped notices, each with whole, cut and scattered ones beside it."""
    texts = ["filler\n" * n + text[: len(text) - cut] + "\nmore filler" * 50 for _, text in WRAPPED for n in (0, 20, 33) for cut in (0, 25, 60)]
    texts += ["\nfar off and away\n".join("Released under the MIT License".split()), "", None, "Released\nunder the\n\nMIT  License, cc by"]
    rows = list(enumerate(texts))
    got = sorted(tuple(r.asDict().items()) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cursor = con.execute(oracles.licenses_sql())
    names = [d[0] for d in cursor.description]
    assert got == sorted(tuple(zip(names, r, strict=True)) for r in cursor.fetchall())
    assert len({dict(r)["labels"] for r in got}) > len(WRAPPED)
