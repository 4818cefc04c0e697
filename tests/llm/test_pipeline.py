"""The pipeline's stages on awkward, empty and small tables."""

from collections import Counter

import corpus_pipeline
from foliant.llm import mixing

from . import brute


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = {0: docs.count()}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES, 1):
        out = step(spark, docs, awkward).cache()
        rows[k] = out.count()
        if name != "bpe":
            assert out.schema.names == docs.schema.names
        if name == "jaccard_join":
            found = brute.components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 5, 80)
            assert Counter(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == Counter({c if n else i for i, n, c in found})
        if name == "pii":
            assert rows[k] == rows[k - 1]
            left = [s for r in out.collect() for s in brute.base_spans(r["text"])]
            assert left == [] and any("[EMAIL]" in (r["text"] or "") for r in out.collect())
        if name == "mixing":
            taken = sum(r["taken"] for r in mixing.allocate(docs).collect())
            assert sum(len(brute.words(r["text"])) for r in out.collect()) == taken
        docs = out
    assert rows[2] < rows[1] <= rows[0]


def test_empty_table(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


def test_small_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 50
