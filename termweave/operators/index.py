"""A positional index, built once and read by every search: segments, sentences, token positions in the order of their terms, term statistics.

Token rows lie sorted by base and surface, in ranges of it, so that a search for a term, its forms or its prefixes reads the row groups of those terms
and no others; the statistics that Parquet keeps for each row group prune the rest. Segments and sentences lie by document.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import checkpoint_folder, exists, written
from . import tables

PARTS = ("segments", "sentences", "tokens", "terms")


@dataclass(frozen=True)
class Index:
    folder: str
    segments: DataFrame
    sentences: DataFrame
    tokens: DataFrame
    terms: DataFrame


def build(docs: DataFrame, folder: str) -> Index:
    """Writes the tables of (document_id, text, ...) to a folder and opens them."""
    spark = docs.sparkSession
    # Segments and sentences keep their partitioning by document, so that the windows of the next table shuffle nothing.
    segs = written(tables.segments(docs), "document_id", f"{folder}/segments")
    sents = written(tables.sentences(segs), "document_id", f"{folder}/sentences")
    # Ranges are drawn from the rows, so the rows should not be worked out for that.
    toks = written(tables.tokens(sents))
    toks.repartitionByRange("base", "surface", "document_id").sortWithinPartitions("base", "surface", "document_id", "global_word_index").write.mode("overwrite").parquet(f"{folder}/tokens")
    posts = spark.read.parquet(f"{folder}/tokens").groupBy("term", "surface", "base", "document_id").agg(F.count("*").alias("n"))
    terms = posts.groupBy("term", "surface", "base").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    return Index(folder, *(spark.read.parquet(f"{folder}/{name}") for name in PARTS))


_BUILT: dict[tuple[str, str], Index] = {}


def of_folder(spark: SparkSession, folder: str) -> Index:
    """The index of a folder's documents table: built at its first use in this application, in the checkpoint folder, then read; built again if it was removed."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT or not exists(spark, f"{_BUILT[key].folder}/terms"):
        _BUILT[key] = build(tables.documents(spark, folder), f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}")
    return _BUILT[key]


_COUNTED: dict[tuple[str, str], tuple[str, DataFrame, DataFrame]] = {}


def counts_of_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(condition, document_id, term, n) and (condition, term, cf, df) of a folder's documents under all four conditions: worked out and
    written at their first use in this application, a directory for each condition."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _COUNTED or not exists(spark, f"{_COUNTED[key][0]}/stats"):
        path = f"{checkpoint_folder(spark)}/counts-{uuid.uuid4().hex}"
        tables.condition_counts(tables.documents(spark, folder)).write.partitionBy("condition").parquet(f"{path}/counts")
        counts = spark.read.parquet(f"{path}/counts").select("condition", "document_id", "term", "n")
        tables.term_stats(counts).write.partitionBy("condition").parquet(f"{path}/stats")
        _COUNTED[key] = path, counts, spark.read.parquet(f"{path}/stats").select("condition", "term", "cf", "df")
    return _COUNTED[key][1:]


def lookup(index: Index, term: str) -> DataFrame:
    """Positions of one term; its base is worked out first, so that only its row groups are read."""
    from .retrieval import base_of, folded

    surface = folded(term).replace("’", "'").strip()
    return index.tokens.where((F.col("base") == base_of(surface)) & (F.col("surface") == surface) & (F.col("term") == folded(term)))


def posting_lists(index: Index) -> DataFrame:
    """(term, document_id, frequency, positions): one list for each term and document, positions in order; as long as a document at most."""
    rows = index.tokens.groupBy("term", "document_id").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_list("global_word_index")).alias("positions"))
    return rows.select("term", "document_id", "frequency", "positions")
