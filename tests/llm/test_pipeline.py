"""The pipeline's stages, each against plain Python on what the stage before it left."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sessionscope.llm import toxicity
from sessionscope.operators.staging import stage
from tests.llm.data import SCHEMA, awkward, awkward_rows, empty
from tests.llm.test_native_ops import base_spans, check_mix, expected_mix
from tests.llm.test_near_dups import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "pii", "mix", "tokens"]
    left = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"test-{name}")
        left[name] = docs.collect()
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = {r.doc_id: r.score for r in toxicity.score_toxicity(before, model).collect()}
            assert {r.doc_id for r in left[name]} == {i for i, s in scores.items() if s < 0.7}
        if name != "tokens":
            assert docs.columns == COLUMNS and docs.dtypes == before.dtypes
    rows = [(r.doc_id, r.text) for r in left["toxicity"]]
    assert {r.doc_id for r in left["near_duplicates"]} == {c for _, _, c in brute(rows, 5)}
    assert len(left["near_duplicates"]) == len({r.doc_id for r in left["near_duplicates"]})
    texts = {r.doc_id: r.text for r in left["near_duplicates"]}
    assert {r.doc_id for r in left["pii"]} == set(texts)
    for r in left["pii"]:
        assert r.text == texts[r.doc_id] if not base_spans(texts[r.doc_id]) and "[" not in r.text else base_spans(r.text) == []
        assert r.n_chars == len(r.text) or r.text == texts[r.doc_id]
    copies = Counter(r.doc_id for r in left["mix"])

    class Row:
        def __init__(self, r, size, total, target):
            self.doc_id, self.source, self.size, self.source_size, self.target, self.taken = r.doc_id, r.source, size, total[r.source], target[r.source], size * copies.get(r.doc_id, 0)

    plain = [(r.doc_id, r.text, r.source) for r in left["pii"]]
    sizes, total, target = expected_mix(plain)
    size = {i: k for i, k, _ in sizes}
    check_mix([Row(r, size[r.doc_id], total, target) for r in left["pii"]], plain)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = {r.doc_id: r.text for r in left["mix"]}
    assert Counter(r.doc_id for r in left["tokens"]) == copies
    for r in left["tokens"]:
        assert list(r.token_ids) == library.encode(final[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_run_is_registered(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "token_ids"]


def test_stages_on_awkward_and_empty_tables(spark, sf_dir):
    for start in (awkward(spark), empty(spark)):
        docs = start
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, sf_dir), f"test-{name}")
            if name != "tokens":
                assert docs.columns == start.columns
    assert docs.count() == 0 and len(awkward_rows()) == 18 and SCHEMA.startswith("doc_id")
