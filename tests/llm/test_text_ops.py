"""BPE, fingerprints, toxicity, URL templates and neighbours against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionscope.llm import bpe, fingerprints, neighbours, queries, toxicity, url_filters
from tests.llm.data import awkward, awkward_rows, empty

BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(BPE_PATH))


def same(encoder, library, texts):
    got = encoder.encode(texts)
    for t, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, repr(t[:100])
        assert encoder.vocab.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_edge_texts(encoder, library):
    texts = ["", " ", "  a", "a  ", "\n\n x\t\ty \r\n", "I'll we're don't 'S 's", "aaaa aaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 999, "ababababa" * 50, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "😀😀 👩‍👩‍👧 é e\u0301 \u00a0\u2003x", "12 345,678.9 ٣٤ Ⅷ", "\x1c\x1d\x85\u200b\ufeff x", "\x00\x01\x7f", "日本語 テキスト한국어", "mixed_under-score's"]
    same(encoder, library, texts)
    same(encoder, library, [f"a{chr(c)} {chr(c)}{chr(c)}b" for c in range(0x3000) if chr(c).isprintable() or c < 0x500])


def test_bpe_random_texts(encoder, library):
    rng = random.Random(5)
    alphabet = "aabbcdeeélnorst   \n\t'.,0123😀ñ<|>"
    same(encoder, library, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)])
    same(encoder, library, ["".join(rng.choice("abcde") for _ in range(20_000))])


def test_bpe_long_words(encoder, library):
    """Runs without a break: random letters, one letter, encoded data, unspaced script."""
    rng = random.Random(12)
    began = time.time()
    texts = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(1_000_000)), "a" * 300_001, "xy" * 100_000 + "x", "".join(rng.choice("日本語漢字仮名") for _ in range(50_000))]
    texts += ["".join(rng.choice("ABCDEFGHabcdefgh") for _ in range(n)) for n in (1023, 1024, 1025, 5000)]
    same(encoder, library, texts)
    assert time.time() - began < 60


def test_bpe_memo_is_bounded(library):
    from sessionscope.llm.memo import Memo

    small = bpe.Encoder(bpe.Vocabulary.load(BPE_PATH))
    small.memo = Memo(10_000)
    rng = random.Random(13)
    for _ in range(20):
        same(small, library, ["".join(rng.choice("abcde ") for _ in range(2000))])
        assert small.memo.held < 10_000 + 700 and len(small.memo) < 100


def test_bpe_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False)) == sha(texts[r.doc_id])


def test_bpe_awkward(spark, library):
    rows = bpe.encode(awkward(spark), BPE_PATH).collect()
    assert sorted((r.doc_id or -1, r.token_ids) for r in rows) == sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids) for r in awkward_rows())
    back = bpe.decode(bpe.encode(awkward(spark), BPE_PATH), BPE_PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r[0] or -1, r[1] or "") for r in awkward_rows())
    assert bpe.encode(empty(spark), BPE_PATH).count() == 0
    assert bpe.round_trip_digests(empty(spark), BPE_PATH).count() == 0


# ---- fingerprints


def slow_counts(text):
    counts = [0] * fingerprints.BUCKETS
    b = text.ljust(fingerprints.WINDOW, b"\0") if text else b""
    for end in range(fingerprints.WINDOW - 1, len(b)):
        for (i, j), salt in zip(fingerprints.TRIPLETS, fingerprints._SALTS, strict=True):
            counts[int(fingerprints._TABLES[0][b[end]] ^ fingerprints._TABLES[1][b[end - i]] ^ fingerprints._TABLES[2][b[end - j]] ^ salt)] += 1
    return counts


def check_fingerprints(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).hexdigest()), reverse=True)
    want = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        a, b, c = (fingerprints.fingerprint(x.encode()) for x in (text, edit, following))
        want.append((key or -1, len(text), sha(edit), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows) == sorted(want)


def test_fingerprint_counts():
    for text in [b"", b"a", b"abcd", b"abcde", "Émile was here".encode(), bytes(range(256)) * 3]:
        assert fingerprints.bucket_counts(text).tolist() == slow_counts(text)
    long = b"some words and others " * 60_000
    assert fingerprints.bucket_counts(long).sum() == 6 * (len(long) - 4)


def test_fingerprints_of_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op5_fingerprints(spark, sf_dir).collect()
    check_fingerprints(rows, docs)
    wins = sum(r.near_edited > r.near_next for r in rows if r.n_chars > 200) / sum(r.n_chars > 200 for r in rows)
    assert wins > 0.95
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_fingerprints_awkward(spark):
    check_fingerprints(fingerprints.compare_with_edits(awkward(spark)).collect(), [(r[0], r[1]) for r in awkward_rows()])
    assert fingerprints.compare_with_edits(empty(spark)).count() == 0
    check_fingerprints(fingerprints.compare_with_edits(awkward(spark).where("doc_id = 1")).collect(), [awkward_rows()[0][:2]])
    check_fingerprints(fingerprints.compare_with_edits(awkward(spark).where("doc_id is null")).collect(), [(None, "a row without an id")])
    assert {r.fingerprint for r in fingerprints.fingerprints(awkward(spark)).where("doc_id in (4, 5)").collect()} == {fingerprints.fingerprint(b"")}


def test_fingerprints_of_string_ids_and_repeated_rows(spark):
    docs = [(f"k{i % 40:02d}", f"text {i % 7} " * (i % 11)) for i in range(200)] + [("hot", "the same text " * 9)] * 300 + [(None, "last")]
    check_keyed(fingerprints.compare_with_edits(spark.createDataFrame(docs, "doc_id string, text string").repartition(7)).collect(), docs)


def check_keyed(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or "", hashlib.md5(d[1].encode()).hexdigest()), reverse=True)
    want = []
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edit = fingerprints.edited(text, following)
        want.append((key or "", len(text), sha(edit), *[fingerprints.fingerprint(x.encode()) for x in (text, edit)]))
    assert sorted((r.doc_id or "", r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows) == sorted(want)


# ---- toxicity


def corpus(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice(["the", "on", "ar", "li", "sten", "ver", "o", "ta"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["idiot", "stupid", "moron"]
    rows = []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(40)]
        y = int(i % 5 == 0)
        if y:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_learns_and_deobfuscates(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((score[i] >= 0.7) == bool(y) for i, _, y in rows)
    hidden = ["you 1d10t there", "so $tup1d of them", "what an i d i o t on", "an idioooot", "m.o.r.o.n", "stttupid", "M0R0N!!!"]
    plain = ["theon liar vertao sten", "3.14 and 2026-01-02 at 10:30", "a b c d e", "", None, "mail me: x1@y2.com", "liiiiar", "ver### on$$$ the%%%"]
    more = spark.createDataFrame(list(enumerate(hidden + plain)), "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(more, model).collect()}
    assert [i for i in range(len(hidden)) if score[i] < 0.7] == []
    assert [i for i in range(len(hidden), len(score)) if score[i] >= 0.7] == []
    kept = toxicity.drop_toxic(more.selectExpr("doc_id", "text", "1 as score", "'x' as id"), model)
    assert kept.columns == ["doc_id", "text", "score", "id"] and kept.count() == len(plain)


def test_toxicity_held_out(spark, sf_dir):
    import zlib

    docs = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert sum(r.predicted for r in rows if docs.get(r.doc_id) == 0) <= 0.03 * len(rows)


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(awkward(spark), labels)
    assert {r.score < 0.7 for r in toxicity.score_toxicity(awkward(spark), model).collect()} == {True}
    assert toxicity.score_toxicity(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0


def test_toxicity_model_is_plain_viterbi():
    """The decoder's path is the cheapest of all paths of a short lattice."""
    rng = np.random.default_rng(2)
    costs = rng.random((28, 28, 28)).tolist()

    def cost(word, extra):
        a = b = 0
        for c in word:
            s = toxicity.symbol(c)
            extra += costs[a][b][s]
            a, b = b, s
        return extra + costs[a][b][0]

    lattice = [[("a", 0.0)], [("i", toxicity.SWAP_COST), ("l", toxicity.SWAP_COST), ("", toxicity.DROP_COST)], [("b", 0.0)], [("o", toxicity.SWAP_COST), ("", toxicity.DROP_COST)]]
    paths = [("", 0.0)]
    for step in lattice:
        paths = [(w + x, c + e) for w, c in paths for x, e in step]
    assert toxicity.restore("a1b0", costs) == min(paths, key=lambda p: cost(*p))[0]


def test_toxicity_weights_and_scores_are_plain_counts(spark):
    """Weights from counting rows one by one, the curve from its own condition, scores from a document's distinct words."""
    import math

    rows, config = corpus(spark), toxicity.ToxicityConfig()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    used = [(set(t.split()), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    n = [sum(y == k for _, y in used) for k in (0, 1)]

    def weight(t, c):
        return math.log((t + 0.5) / (n[1] - t + 0.5)) - math.log((c + 0.5) / (n[0] - c + 0.5)) - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))

    def counted(sets):
        out = {}
        for fs, y in sets:
            for f in fs:
                out.setdefault(f, [0, 0])[y] += 1
        return {f: weight(t, c) for f, (c, t) in out.items() if t >= config.min_toxic_rows}

    whole = {w: x for w, x in counted(used).items() if x >= config.min_weight}
    stems = lambda ws: {g for w in ws if w not in whole for g in toxicity.grams(w)}
    behind = {}
    for w in {w for ws, y in used if y for w in ws if w not in whole}:
        for g in toxicity.grams(w):
            behind[g] = behind.get(g, 0) + 1
    parts = {g: x for g, x in counted([(stems(ws), y) for ws, y in used]).items() if x >= config.min_stem_weight and behind.get(g, 0) >= config.min_stem_words}
    want = {"=" + w: x for w, x in whole.items()} | parts
    assert set(model.weights) == set(want) and all(abs(model.weights[f] - x) < 1e-12 for f, x in want.items()) and len(whole) >= 3

    def evidence(ws):
        return min(sum(whole[w] if w in whole else max((parts[g] for g in toxicity.grams(w) if g in parts), default=0.0) for w in ws), toxicity.MOST_EVIDENCE)

    p = [(1 / (1 + math.exp(-model.slope * evidence(ws) - model.offset)), evidence(ws), y) for ws, y in used]
    assert abs(sum((q - y) * x for q, x, y in p) + 0.5 * model.slope) < 1e-3 and abs(sum(q - y for q, _, y in p) + 0.05 * model.offset) < 1e-3
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(abs(score[i] - 1 / (1 + math.exp(-model.slope * evidence(set(t.split())) - model.offset))) < 1e-9 for i, t, _ in rows)


# ---- URLs


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:stop]


def rule_of(host, path):
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def check_urls(rows, urls):
    for r in rows:
        host, path = split_url(urls[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name), urls[r.page_id]
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")


def test_urls_documents(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op7_url_templates(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    check_urls(rows, urls)


def test_urls_awkward(spark):
    odd = [None, "", "no scheme/a", "http://", "http://NET", "http://net/", "x://y://z/a", "http://A.Example.COM/de/x?y#z", "https://example.com/de", "http://notexample.net/en/", "http://q.example.net/en/1", "http://a.org/fr/", "http://a.org?x=/fr/", "http://É.org/fr/\nx", "http://a.b/1/2/3/4/5/6/7/8/9#f"]
    rows = [(i, u, 1, 2, "t") for i, u in enumerate(odd)] + [(6, odd[6], 1, 2, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, n int, good int, template string")
    labels = spark.createDataFrame([(1, 0, 1), (1, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = url_filters.judge_urls(pages, labels).collect()
    assert len(got) == len(rows)
    check_urls(got, dict(enumerate(odd)))
    assert url_filters.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_urls_reject_a_bad_branch(spark):
    rows = [(i, f"http://h.com/{['good', 'spam', 'fine'][i % 3]}/{i}.html") for i in range(300)]
    rows += [(1000 + i, f"http://t.com/tag-{chr(97 + i % 26)}{i}/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), 0) for i in range(200)] + [(1000 + i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, labels).collect()}
    assert {got[i].verdict for i in range(1, 300, 3)} == {"block"} and {got[i].template for i in range(1, 300, 3)} == {"/spam/*"}
    assert {got[i].verdict for i in range(0, 300, 3)} | {got[i].verdict for i in range(2, 300, 3)} == {"allow"}
    assert {got[1000 + i].template for i in range(60)} == {"/*/~"}


def test_urls_reject_a_deep_branch(spark):
    rows = [(i, f"http://h.com/a/b/c/d/e/{['good', 'spam', 'fine'][i % 3]}/{i}.html") for i in range(300)] + [(900, "http://h.com/a/b/c"), (901, "http://h.com/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, labels).collect()}
    assert len(got) == len(rows)
    assert {got[i].verdict for i in range(1, 300, 3)} == {"block"} and all(got[i].template.endswith("/spam/*") for i in range(1, 300, 3))
    assert {r.verdict for i, r in got.items() if i % 3 != 1 or i > 300} == {"allow"}


def plain_templates(pages, labels, config):
    """Template and purity of every page, one page at a time."""
    import math
    import re
    from collections import Counter, defaultdict

    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = max(good.get(i, q), q)
    segments, template = {}, {}
    for i, url in pages:
        host, path = split_url(url)
        names = [s for s in path.split("/") if s]
        names = ["*" if re.search(url_filters.VARIABLE.replace("\\z", r"\Z"), s, re.S) else "\\" + s if s[0] in "*~\\" else s for s in names]
        segments[i], template[i] = (host, names), ""
    for level in range(max(len(s) for _, s in segments.values())):
        live = [i for i in segments if len(segments[i][1]) > level or level == 0 or len(segments[i][1]) == level]
        groups = defaultdict(list)
        for i in live:
            host, names = segments[i]
            groups[host, template[i]].append((i, names[level] if level < len(names) else ""))
        for members in groups.values():
            n, bad, known = Counter(), Counter(), Counter()
            for i, s in members:
                n[s] += 1
                if i in good:
                    known[s] += 1
                    bad[s] += good[i] <= 0
            total, all_bad, all_known = sum(n.values()), sum(bad.values()), sum(known.values())
            variable = len(n) >= config.fan_out and len(n) >= config.distinct_share * total
            share = (all_bad + 0.5) / (all_known + 1)
            for i, s in members:
                others = all_known - known[s]
                alone = False
                if known[s] and others:
                    gap = abs(bad[s] / known[s] - (all_bad - bad[s]) / others)
                    alone = gap > config.z * math.sqrt(share * (1 - share) * (1 / known[s] + 1 / others))
                template[i] += "" if s == "" else "/*" if s == "*" or variable else "/" + s if alone else "/~"
    tally, by_host = defaultdict(Counter), defaultdict(Counter)
    for i, (host, _) in segments.items():
        if i in good:
            tally[host, template[i]]["good" if good[i] > 0 else "bad"] += 1
            by_host[host]["good" if good[i] > 0 else "bad"] += 1
    g, b = (sum(c[k] for c in by_host.values()) for k in ("good", "bad"))
    top = min(1.0, (g + 1) / (g + b + 1))
    out = {}
    for i, (host, _) in segments.items():
        h, t = by_host[host], tally[host, template[i]]
        share = (h["good"] + config.pull * top) / (h["good"] + h["bad"] + config.pull)
        out[i] = template[i], (t["good"] + config.pull * share) / (t["good"] + t["bad"] + config.pull)
    return out


def check_templates(rows, pages, labels):
    config = url_filters.TemplateConfig()
    want = plain_templates(pages, labels, config)
    for r in rows:
        template, purity = want[r.page_id]
        assert r.template == template and abs(r.purity - purity) < 1e-9, (r, template, purity)
        if r.rule is None:
            assert r.verdict == ("block" if purity < config.min_purity else "allow")
    return {r.verdict for r in rows if r.rule is None}


def test_urls_templates_against_plain_python(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    check_templates(queries_judged(spark, pages, labels), pages, labels)
    rng = random.Random(21)
    hosts, words = ["a.b", "c.d", "e.f"], ["news", "spam", "x", "*", "~", "\\", "de", "12", "77", "ab12cd34ef"]
    pages = [(i, f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(words) if rng.random() < 0.9 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(7)))) for i in range(1500)]
    labels = [(i, int(("spam" in u or "/*" in u) == (rng.random() < 0.1))) for i, u in pages if rng.random() < 0.7]
    assert check_templates(queries_judged(spark, pages, labels), pages, labels) == {"allow", "block"}


def queries_judged(spark, pages, labels):
    return url_filters.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()


def test_urls_tell_names_from_wildcards(spark):
    """Pages under a literal '*' are bad, those under numbers good."""
    pages = [(i, f"http://h.com/{'*' if i % 2 else i}/x") for i in range(40)] + [(100 + i, f"http://g.com/{'~' if i % 2 else 'n' + str(i % 4)}/x") for i in range(80)]
    labels = [(i, 1 - i % 2) for i in range(40)] + [(100 + i, 1 - i % 2) for i in range(80)]
    got = queries_judged(spark, pages, labels)
    check_templates(got, pages, labels)
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)


def test_urls_of_long_paths(spark):
    """Rounds follow branchings: paths of thousands of segments, alone, in pairs and of slashes only."""
    deep = "/s" * 5000
    urls = [f"http://h.com{deep}", f"http://h.com{deep}/end/7", "http://h.com/s/other", "http://g.com" + "/" * 5000, "http://g.com", "http://k.com/1" + "/a/2" * 2500]
    pages = list(enumerate(urls * 2))
    began = time.time()
    got = queries_judged(spark, pages, [(0, 1), (1, 0)])
    assert time.time() - began < 60
    templates = {r.page_id: r.template for r in got}
    # of two branches with a label on one side only, and none to tell apart, all is merged
    assert templates[0] == "/~" * 5000 and templates[1] == "/~" * 5000 + "/~/*" and templates[2] == "/~/~"
    assert templates[3] == templates[4] == "" and templates[5] == "/*" + "/~/*" * 2500


# ---- neighbours


def brute_neighbours(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted(((-(w * v).sum(), j) for j, w in good if j != i))[:k]
    return out


def recall_of(got, want):
    hits = total = 0
    for q, best in want.items():
        rows = sorted(got.get(q, []))
        assert [r for r, *_ in rows] == list(range(1, len(best) + 1))
        keys = [(-s, v) for _, v, s in rows]
        assert keys == sorted(keys)
        hits += len({v for _, v, _ in rows} & {v for _, v in best})
        total += len(best)
    return hits / total


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_neighbours_of_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_neighbours(rows)
    got = gathered(queries.op10_ivf_pq(spark, sf_dir))
    assert set(got) == set(want)
    assert recall_of(got, want) >= 0.95
    exact = {(q, v): -s for q, best in want.items() for s, v in best}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, best in got.items() for _, v, s in best if (q, v) in exact)


def test_neighbours_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    rows[:300] = [(i, rows[0][1]) for i in range(300)]  # one vector many times
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 7 + [None]), (None, [1.0] * 8), (1080, [1.0] * 3), (1100, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as block", "2 as cell", "3 as id")
    want = brute_neighbours([r for r in rows if r[1] is None or len(r[1]) == 8])
    config = neighbours.AnnConfig(sample=300, most_cells=16, block_bytes=64 * 64, query_bytes=8 * 64, rerank=40)
    got = gathered(neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0"), config=config))
    assert set(got) == set(want) and recall_of(got, want) >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == [v for _, v in want[0]]  # ties go to the smaller ids
    few = df.where("vec_id in (300, 301, 302)")
    assert len(neighbours.nearest_neighbours(few, few.where("vec_id = 300")).collect()) == 2
    assert neighbours.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_mixed_lengths(spark):
    """The table's commonest length holds, whatever is common among the queries."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 20 == 0 and i > 100 else 8).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute_neighbours([r for r in rows if len(r[1]) == 8])
    got = gathered(neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0")))
    assert set(got) == set(want) == {0, 20, 40, 60, 80, 100} and recall_of(got, want) >= 0.9


def test_neighbours_of_one_tight_cluster(spark):
    """Vectors that the codes can't tell apart are all reranked."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 1e-3).tolist() if i % 2 else rng.normal(size=16).tolist()) for i in range(3000)]
    rows = [(i, (centre + rng.normal(size=16) * 1e-3).tolist()) if i % 20 == 0 else (i, v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute_neighbours(rows)
    got = gathered(neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0"), config=neighbours.AnnConfig(sample=1000, most_cells=32, rerank=40)))
    assert set(got) == set(want) and recall_of(got, want) >= 0.95
