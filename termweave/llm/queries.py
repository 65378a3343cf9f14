"""Queries of the operators in this package, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import spread
from . import bpe, distinctive, language, leakage, near_duplicates, residue, sentences, term_trie


#: Where the vocabulary files lie.
TOKENIZERS = os.environ.get("TERMWEAVE_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    words = distinctive.from_positioned(_table(spark, folder, "positioned_document"))
    return distinctive.distinctive_terms(words, distinctive.tf_idf).select(F.col("record").alias("document_id"), "term")


def p3_log_entropy(spark: SparkSession, folder: str) -> DataFrame:
    words = distinctive.from_positioned(_table(spark, folder, "positioned_document"))
    return distinctive.distinctive_terms(words, distinctive.log_entropy).select(F.col("record").alias("document_id"), "term", "f", "df", "score")


def _abstracts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "structured_document").select("record_id", F.col("abstract_paragraphs_clean").alias("paragraphs")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(_abstracts(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.record_classes(_abstracts(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_trie.marked_counts(_abstracts(spark, folder)).select("term", "total_frequency", "document_frequency", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    paragraphs = _table(spark, folder, "processed_document").select("document_id", "segment_id", "text")
    return sentences.sentence_ranges(paragraphs, ["document_id", "segment_id"])


def p4_unpunctuated(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of whole documents whose marks are taken off: what the events between any two words find by themselves. The model is fitted on the texts as they are."""
    paragraphs = _table(spark, folder, "processed_document").select("document_id", "segment_id", "text")
    bare = F.regexp_replace("text", r"[.!?…]+(?=[\s\"'”’»)\]]|$)|[。！？।॥…]+", "")
    parts = F.array_sort(F.collect_set(F.struct("segment_id", F.trim(bare).alias("t"))))
    documents = paragraphs.where(F.trim("text") != "").groupBy("document_id").agg(F.array_join(parts["t"], " ").alias("text"))
    return sentences.sentence_ranges(documents, ["document_id"], sentences.fit(paragraphs))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    records = _table(spark, folder, "structured_document")
    return records.select("record_id", F.col("language").alias("label"), F.col("abstract_paragraphs_clean").alias("paragraphs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.corrected_languages(_labelled(spark, folder)).select("record_id", "paragraph_no", "char_start", "lang")


def p5_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and every one-language stretch with its language and confidence."""
    return language.languages(_labelled(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(_table(spark, folder, "documents"), "doc_id", "text", TOKENIZERS)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = _table(spark, folder, "eval_item").select(F.col("item_id").alias("item"), "text")
    return leakage.leaked_items(documents, items).toDF("doc_id", "item_id")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = _table(spark, folder, "eval_item").select(F.col("item_id").alias("item"), "text")
    return leakage.near_items(documents, items).toDF("doc_id", "item_id")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text", "title", F.col("journal").alias("slug"), F.col("source").alias("host")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_pages(spark, folder)).select(F.col("doc").alias("doc_id"))


def p8_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_pages(spark, folder)).groupBy("kind").agg(F.count("*").alias("documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_log_entropy": p3_log_entropy,
    "p4_found": p4_found,
    "p4_unpunctuated": p4_unpunctuated,
    "p5_found": p5_found,
    "p5_confidence": p5_confidence,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
}
