"""Corpus cleaning: five stages over `documents`, each written as Parquet and read by the next.

Language identification drops what it rejects; line dedup deletes later copies of runs of lines and
the documents that consist of such runs only; MinHash near-dedup keeps one document of each
group; decontamination cuts passages of the benchmark and drops documents that are mostly such
passages; BPE encodes what stays. All but the last return the columns of `documents`; n_chars follows
the text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismal.llm import bpe, decontaminate, langid, linededup, neardup


def _with_text(docs: DataFrame, changed: DataFrame, text) -> DataFrame:
    """The columns of docs from `changed`, with another text and its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return changed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.identify(docs, langid.fit(docs)).where(~F.col("rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those left without a word by it go."""
    found = linededup.line_dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("clean_text").rlike(r"\S")
    return _with_text(docs, found.where(left), F.col("clean_text"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.near_dedup(docs).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    cleaned = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(docs, cleaned, F.col("text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and their text."""
    return bpe.tokenize(docs.select("doc_id", "lang", "source", "text"), bpe.default_path(), keep_text=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", remove_benchmark),
    ("bpe", encode),
]

#: SQL cannot state the trained language model; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; intermediate tables lie under the checkpoint folder of the session."""
    from prismal.llm import _store

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_store.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
