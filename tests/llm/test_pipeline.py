"""The pipeline's stages, each on what the one before kept, against the operators' brute-force meaning."""

from __future__ import annotations

import corpus_pipeline
from prismal.llm import bpe, decontaminate


def test_stages_chain_and_take_effect(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, {"start": docs.count()}
    benchmark = spark.read.parquet(f"{tiny}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tiny).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.where("n_chars <> char_length(text)").count() == 0
        if name == "decontaminate":
            assert decontaminate.contamination(docs, benchmark).where("contaminated").count() <= 1
            clean = docs.select("text", "doc_id")
    assert kept["language_id"] >= 0.98 * kept["start"] and kept["bpe"] == kept["decontaminate"] > 0.8 * kept["start"]
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(bpe.default_path()), {r["doc_id"]: r["ids"] for r in docs.collect()}
    for r in clean.collect():
        assert ids[r["doc_id"]] == tok.encode(r["text"] or "", add_special_tokens=False).ids


def test_run_equals_the_chained_stages(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert {"doc_id", "ids", "n_tokens", "decoded"} <= set(out.columns) and out.count() > 0


def test_stages_take_nulls_and_empty_tables(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "the words of a text", "en", "s", 19)], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, tiny).collect()
        assert stage(spark, odd.limit(0), tiny).count() == 0
