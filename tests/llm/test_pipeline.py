"""The pipeline's stages, each on all its predecessor kept."""

import corpus_pipeline
from quayside.llm import minhash
from quayside.plans.runtime import materialize


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf), f"test-{k}")
        assert docs.count() > 0, name
        if k < 4:
            assert docs.columns == start.columns
        if name == "near-dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(before, shingle=5).where("kept").collect()}
            assert kept == {r.doc_id for r in docs.collect()} and docs.count() == len(kept)
        if name == "secret scans":
            assert docs.count() == before.count() and docs.where("text rlike 'token = \"[0-9a-f]{16}'").count() == 0
    assert docs.agg({"length": "max"}).first()[0] <= 4096


def test_stages_on_odd_rows_and_no_rows(odd, none):
    """Every stage in turn; rows without a language or without words go, all others reach the sequences."""
    for start, expected in ((odd, {0, 4, 7, 8, None}), (none, set())):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialize(stage(start.sparkSession, docs, "unused"), f"odd-{k}")
            if k < 4:
                assert docs.columns == start.columns
        left = {r.doc_id for r in docs.collect()}
        assert left <= {r.doc_id for r in start.collect()} and (not expected or {0, 4} <= left) and 1 not in left and 2 not in left
