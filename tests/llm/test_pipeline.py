"""The pipeline's stages against plain versions of their decisions."""

import numpy as np
import pandas as pd

import corpus_pipeline
from echoloom.llm import mixing, quality, toxicity
from echoloom.llm.common import Scratch, table
from tests.llm.test_llm_operators import brute_fingerprint, empty, odd_documents, reach

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    scratch = Scratch(spark)
    docs, seen = table(spark, sf, "documents"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = seen[name] = scratch.save(stage(spark, docs, sf), name)
        assert number == 4 or docs.columns == COLUMNS
    raw = table(spark, sf, "documents")
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in seen.items()}
    scores = toxicity.toxicity(raw, table(spark, sf, "labels")).toPandas()
    assert ids["toxicity"] == sorted(scores[scores.predicted == 0].doc_id)
    judged = quality.assess(seen["toxicity"], columns=["doc_id"]).toPandas()
    assert ids["quality"] == sorted(judged[judged.kept].doc_id)
    left = seen["quality"].select("doc_id", "text").toPandas()
    own = left.doc_id.to_numpy()
    assert ids["simhash_copies"] == sorted(own[reach(np.array([brute_fingerprint(t) for t in left.text], np.uint64), own.copy()) == own])
    copies = mixing.mix(seen["simhash_copies"]).toPandas()
    assert ids["mixing"] == sorted(np.repeat(copies.doc_id, copies.copies))
    packed = seen["packing"].toPandas()
    assert set(packed.doc_id) == set(ids["mixing"]) and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf).toPandas()
    assert isinstance(found, pd.DataFrame) and len(found) and corpus_pipeline.ORACLE_SQL is None


def test_run_on_odd_and_empty_tables(spark, sf, tmp_path):
    """Nulls, repeated rows, a long text and clashing columns go through all stages; an empty table gives no rows."""
    for name, docs in (("odd", odd_documents(spark)), ("none", empty(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).toPandas()
    assert set(found.doc_id.dropna()) <= set(range(1, 9)) and found.groupby("sequence_id").length.sum().max() <= 2048
    assert found.length.sum() == found[found.start == 0].doc_tokens.sum()
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
