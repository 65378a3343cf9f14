"""What a build leaves: Parquet tables, a JSON manifest, exports, a hash of the corpus. Everything is written and read by Spark, so that a folder may lie anywhere."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write_manifest(spark: SparkSession, about: dict, folder: str) -> None:
    spark.createDataFrame([(json.dumps(about, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifest").collect()))


def write_tables(tables: dict[str, DataFrame], folder: str, manifest: dict | None = None) -> None:
    """Each table as Parquet, then the manifest with their names and columns."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    about = {"schema_version": VERSION, "written": datetime.now(timezone.utc).isoformat(), "tables": {n: df.dtypes for n, df in tables.items()}} | (manifest or {})
    write_manifest(next(iter(tables.values())).sparkSession, about, folder)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in read_manifest(spark, folder)["tables"]}


def write_corpus(documents: DataFrame, key: str, content: str, folder: str, audit: dict | None = None) -> None:
    """The accepted documents, with their hash, number and audit in the manifest."""
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    kept = documents.sparkSession.read.parquet(f"{folder}/documents")
    about = {"schema_version": VERSION, "documents": kept.count(), "corpus_hash": corpus_hash(kept, key, F.col(content)).first()[0], "key": key, "content": content, "audit": audit or {}}
    write_manifest(documents.sparkSession, about, folder)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The documents; ValueError if they are not those that were written."""
    about, documents = read_manifest(spark, folder), spark.read.parquet(f"{folder}/documents")
    if about["schema_version"] != VERSION or corpus_hash(documents, about["key"], F.col(about["content"])).first()[0] != about["corpus_hash"]:
        raise ValueError(f"{folder} does not hold the corpus that its manifest names")
    return documents


def write_vectors(model, folder: str) -> None:
    """A trained model of word vectors."""
    model.write().overwrite().save(folder)


def read_vectors(folder: str):
    from pyspark.ml.feature import Word2VecModel

    return Word2VecModel.load(folder)


def export_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def export_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def corpus_hash(docs: DataFrame, key: str, content: Column) -> DataFrame:
    """One hash for a corpus, whatever its order: the hashes of its rows, summed in parts of four bytes, hashed again. Nothing is gathered in one place."""
    row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), content), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("bigint")).cast("string").alias(f"p{k}") for k in range(4)]
    return docs.agg(*parts, F.count("*").cast("string").alias("n")).select(F.sha2(F.concat_ws("-", "n", "p0", "p1", "p2", "p3"), 256).alias("corpus_hash"))
