"""New documents as a stream: tokenised and counted as they arrive, appended to term counts. Each batch is written under its number, so that a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables


def new_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def append_counts(stream: DataFrame, target: str, checkpoint: str, condition: str = "B_no_punctuation"):
    """A query that adds (batch, term, cf, df) for each batch of documents to a Parquet table partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("document_id"), "text", "lang", "source")
        counts = tables.counted(docs, condition).groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counts(spark: SparkSession, target: str) -> DataFrame:
    """Counts over all batches; documents belong to one batch each."""
    return spark.read.parquet(target).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
