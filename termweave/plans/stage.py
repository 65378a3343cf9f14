"""Cutting a plan where a result is used more than once."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one of this machine if the session is local, as in tests; on a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="termweave-"))
    return context.getCheckpointDir()


def written(df: DataFrame, by: str | None = None, path: str | None = None) -> DataFrame:
    """The rows written as a Parquet table in the checkpoint folder and read from there: as `settled`, but columnar and compressed, so that
    a later use reads only the columns it needs.

    by: a column by whose hash the rows lie together (``repartition(n, by)``); the table keeps that as buckets, and grouping by it shuffles nothing.
    path: where to write instead, replacing what is there.
    """
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_folder(spark)}/{name}"
    if by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name is given up; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is (still) there, wherever it lies."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there: no later use computes them again, and
    losing an executor loses nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies, when they start in another folder than the driver."""
    home = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The rows as they are read, unless the input has fewer splits than a quarter of this session's cores and no more than a few: a small or
    unsplittable input is dealt out evenly. Nothing but where the rows lie depends on it; inputs of many splits are never shuffled."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits <= 4 and splits * 4 <= cores else df
