"""All stages of the corpus pipeline in turn, on the smallest tables."""

import os
import sys

import pytest
from conftest import FOLDER

pytest.importorskip("postvet.llm")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_stages_take_effect_in_order(spark):
    import corpus_pipeline
    from postvet.llm.common import table
    from postvet.session import stored

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    docs = table(spark, FOLDER, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids, columns = set(texts), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        kept = docs.select("doc_id", "text").collect()
        # No stage brings in or alters a document, and only mixing repeats one.
        assert {r.doc_id for r in kept} <= ids and all(texts[r.doc_id] == r.text for r in kept)
        if name != "mixing":
            assert len({r.doc_id for r in kept}) == len(kept)
        if name == "near_dedup":
            assert len({r.text for r in kept}) == len(kept)
        ids = {r.doc_id for r in kept}
    assert 0 < len(ids) < len(texts)
    written = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in written) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    at = 0
    for r in sorted(written, key=lambda r: r.start):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
