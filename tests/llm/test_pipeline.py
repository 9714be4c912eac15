"""The pipeline's stages on planted cases."""

from __future__ import annotations

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.edge import DOCS, PROSE, documents, empty

ITEM = "Which of the seven lakes beyond the northern ridge was crossed first by the two brothers in the winter of that year?"


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = PROSE.replace("river", "stream").replace("mill", "house") + " Nobody knew how long it would last, and nobody asked."
    rows = [*DOCS, (20, other + " Write to a.b@c.org.", "en"), (21, f"{PROSE[:90]} {ITEM} It was asked of all who came to the place.", "en")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r["doc_id"] for r in out)
    # the loud text is too short to be judged by its characters
    assert ids == [1, 8, 20]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in out:
        assert r["piece_ids"] == library.encode(r["text"]) and r["n_chars"] == len(r["text"])
    assert [r["text"] for r in out if r["doc_id"] == 20] == [other + " Write to [EMAIL]."]


def test_each_stage_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).collect() == []
