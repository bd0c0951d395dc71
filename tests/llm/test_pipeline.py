import public_tokenizers

import corpus_pipeline
from tests.llm.conftest import table
from tracelace.llm import packing
from tracelace.storage import written


def test_stages_over_dirty_rows(spark, dirty):
    docs = dirty.select("doc_id", "text", "lang", "source", "n_chars")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), name)
        assert docs.columns == columns, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 2 not in kept and 3 not in kept and 11 not in kept
    assert all("hunter2" not in (t or "") for t in kept.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.count() >= docs.count()


def test_stages_over_no_rows(spark):
    docs = table(spark, [], extra=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_fewer_words_kept_and_batches_cut_give_the_same_pieces(spark, dirty, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = sorted(packing.pieces(dirty, path).collect(), key=str)
    monkeypatch.setattr(packing, "AT_ONCE", 2)
    assert sorted(packing.pieces(dirty, path, most=5).collect(), key=str) == whole
    encoder = packing.Encoder(path, 5)
    for i in range(4):
        list(encoder.of([b"%d word%d other%d" % (i, i, i) for _ in range(3)]))
    assert len(encoder.cache) <= 5 + 3
