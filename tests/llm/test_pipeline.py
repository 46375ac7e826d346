from __future__ import annotations

import corpus_pipeline
from sedgewood.llm import packing, queries


def test_stages(spark, documents, awkward, nothing, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents.select(*columns)
    benchmark = spark.createDataFrame([(1, docs.where("doc_id = 20").first()["text"])], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for other in (nothing, awkward):
            assert stage(spark, other, str(tmp_path)).count() <= other.count() + 1
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before, name
        if k < 4:
            assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0
        before = after
    assert 20 not in before and 10 in before
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_run_is_the_stages(spark, documents, tmp_path):
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "not in any document at all, this text of ours is here alone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    expected = packing.token_pieces(docs, f"{queries.TOKENIZERS}/word_bpe_49k.json").select("doc_id", "piece", "ids_crc32")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
