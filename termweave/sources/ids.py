"""Record ids: out of text, normalised, in batches, requested against returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked

# How an id stands in a text, in the order the forms are tried.
LABELLED = r"(?i)\bPMID\s*[:#=]?\s*([0-9]+)\b"
ADDRESS = r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/([0-9]+)"
LINE = r"(?m)^[ \t\r\f]*[,;]*([0-9]+)[,;]*[ \t\r\f]*$"
LOOSE = r"\b([0-9]{5,10})\b"


def ids_in_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, pos): ids behind a label, in an address or alone on a line; if a text has none, numbers of 5 to 10 digits. Each once, in order."""
    forms = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (LABELLED, ADDRESS, LINE)]
    clear = F.array_distinct(F.concat(*forms))
    found = F.when(F.size(clear) > 0, clear).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(LOOSE), F.lit(1))))
    return texts.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(found).alias("pos", "id"))


def normalised(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """(id, pos): digits only, first occurrence kept, in order."""
    digits = rows.select(F.regexp_replace(value, "[^0-9]", "").alias("id"), F.col(pos).alias("pos")).where(F.col("id") != "")
    return digits.groupBy("id").agg(F.min("pos").alias("pos"))


def batches(ids: DataFrame, size: int) -> DataFrame:
    """(id, batch): consecutive ids in batches. Ranks come from counts by range of positions, so no task sees all ids."""
    width = 4096
    block = F.floor(F.col("pos") / width)
    sizes = ids.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("pos")) - 1
    rows = ids.withColumn("block", block).withColumn("k", inside).join(starts, "block")
    return rows.select("id", F.floor((F.col("start") + F.col("k")) / size).alias("batch"))


def missing(requested: DataFrame, returned: DataFrame) -> DataFrame:
    return requested.join(returned, "id", "left_anti")


def in_requested_order(requested: DataFrame, documents: DataFrame, id: str = "pmid") -> DataFrame:
    """The documents that were asked for, each once, with ``pos``, their place in the request (id, pos); of several under one id one counts."""
    once = documents.where(F.trim(id) != "").dropDuplicates([id])
    return requested.join(once, requested["id"] == once[id]).drop(requested["id"])


def ids_in_files(files: DataFrame) -> DataFrame:
    """(path, id, pos) from text files (path, content): as `ids_in_text`, bytes that are no UTF-8 replaced."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return ids_in_text(files.select("path", text.alias("text")), "path", "text")


def in_manifest_order(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, ...) with ``pos``: by a manifest (pos, file, pmcid), if it names any of them, files it does not name left out; else by name.

    A row of the manifest without a file names the file of its pmcid.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    listed = F.regexp_extract(F.trim(F.coalesce("file", F.lit(""))), "[^/]*$", 0)
    named = manifest.select(F.when(listed != "", listed).when(F.trim(F.coalesce("pmcid", F.lit(""))) != "", F.concat(F.trim("pmcid"), F.lit(".xml"))).alias("name"), "pos")
    met = files.withColumn("name", name).join(named.groupBy("name").agg(F.min("pos").alias("pos")), "name")
    if not met.isEmpty():
        return met.drop("name")
    return ranked(files.withColumn("name", name), [], [F.asc("name"), F.asc("path")], "pos").drop("name")
