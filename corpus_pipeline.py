"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, ngram_join, packing, queries, rule_classifier, substring_dedup
from textloom.llm.runtime import checkpointed, free_name, n_files, shared_folder

#: Near-duplicate stages on word shingles: five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
WINDOW_WORDS = 20
CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the rule ensemble on the labels of these documents; rejected documents go, at a score of just 0.5 one stays.

    A null or empty text is scored like any other; rows that repeat an id, or have
    none, are judged each by its own text; columns of any name stay as they are; an
    empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rule_classifier.train(docs, labels)
    score = free_name(docs, "__quality")
    return rule_classifier.with_score(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns).coalesce(n_files(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays.

    Rows that repeat an id count as one document with the first of their texts, and
    all but one of those that also repeat the text go.  Rows without an id, and
    documents without a word, link with nothing and stay; so does every row of an
    id that stays with another text.  Other columns are carried along.
    """
    linked = ngram_join.class_links(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone, times = free_name(docs, "__gone"), free_name(docs, "__times")
    told = linked.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("component_id") != F.col("doc_id")).alias(gone), F.count(F.lit(1)).alias(times))
    told = checkpointed(told.where(F.col(gone) | (F.col(times) > 1)))
    left = docs.join(told, docs["doc_id"] == told["__id"], "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    if told.where(F.col(times) > 1).isEmpty():
        return left.select(*docs.columns)
    again = left.where(F.col(times) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.where(F.col(times).isNull() | (F.col(times) == 1)).select(*docs.columns).unionByName(again)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that also start earlier go; a document without words left goes.

    A document that loses words keeps the others with one space between; any
    other document stays as it is, also a null or empty text.  Rows that repeat an
    id follow each other in order of text, rows without an id come last; other columns
    are carried along.
    """
    words, removed, kept = names = tuple(free_name(docs, n) for n in substring_dedup.NAMES)
    done = substring_dedup.dedup(docs, WINDOW_WORDS, names=names)
    cut = F.col(removed) > 0
    done = done.where((F.col(removed) < F.col(words)) | ~cut)
    done = done.withColumn("text", F.when(cut, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")))
    return done.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, edited or not, go.

    Null and empty texts hold none and stay; every row is judged by its own text,
    whatever its id; other columns are carried along.
    """
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).coalesce(n_files(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in sequences of ``CAPACITY`` tokens.

    A null or empty text is one piece of one token; rows that repeat an id, or have
    none, are packed each; of other columns nothing is kept.
    """
    return packing.pack_documents(docs, queries.tokenizer_path(), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_spans),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: A fitted classifier, links and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
