"""Accepting records into a corpus: required fields, language, one record for each id, a target size; and why others were left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decided(records: DataFrame) -> DataFrame:
    """Records (name, pmid, abstract, language, ...) with a ``reason``: null if accepted, else the first rule that fails, in this order:
    missing_pmid, duplicate_pmid, missing_abstract, non_english. Of records with one id the first acceptable in order of name counts."""
    pmid, abstract, language = F.trim(F.coalesce("pmid", F.lit(""))), F.trim(F.coalesce("abstract", F.lit(""))), F.lower(F.trim(F.coalesce("language", F.lit(""))))
    fit = (pmid != "") & (abstract != "") & ((language == "") | language.startswith("en"))
    rows = records.withColumns({"_p": pmid, "_fit": fit})
    earlier = F.sum(F.col("_fit").cast("int")).over(Window.partitionBy("_p").orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    # Records without an id are spread by name: they never compete.
    spread = rows.where(F.col("_p") != "").withColumn("_before", F.coalesce(earlier, F.lit(0))).unionByName(rows.where(F.col("_p") == "").withColumn("_before", F.lit(0).cast("bigint")))
    reason = (
        F.when(F.col("_p") == "", "missing_pmid").when(F.col("_before") > 0, "duplicate_pmid").when(abstract == "", "missing_abstract").when((language != "") & ~language.startswith("en"), "non_english")
    )
    return spread.withColumn("reason", reason).drop("_p", "_fit", "_before")


def audit(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("records"))


def accepted(decisions: DataFrame, target: int) -> DataFrame:
    """The first ``target`` accepted records by name."""
    return decisions.where(F.col("reason").isNull()).orderBy("name").limit(target)


# Names and forms of the representations counted in a corpus.
REPRESENTATIONS = {
    "glp-1_ascii_exact": r"glp\-1",
    "glp‐1_u2010_exact": "glp‐1",
    "glp‑1_u2011_exact": "glp‑1",
    "glp–1_u2013_exact": "glp–1",
    "glp_1_space_exact": r"glp\s+1",
    "glp-1r_ascii_exact": r"glp\-1r",
    "glucagon-like_peptide-1_ascii": r"glucagon\-like\s+peptide\-1",
    "glucagon-like_peptide_1_ascii": r"glucagon\-like\s+peptide\s+1",
    "glp−1_u2212_exact": "glp−1",
    "glp—1_u2014_exact": "glp—1",
    "glp‐1r_u2010_exact": "glp‐1r",
    "glp1_exact": "glp1",
    "glp1r_exact": "glp1r",
    "glucagon_like_peptide_1_spaces": r"glucagon\s+like\s+peptide\s+1",
}


def bounded(pattern: str) -> str:
    """Not within a longer run of letters and digits; written without look-around."""
    return f"(^|[^a-z0-9]){pattern}([^a-z0-9]|$)"


def representations(texts: DataFrame) -> DataFrame:
    """(pattern, documents): how many texts hold each form, and any of them, in one pass."""
    low = F.lower("text")
    counts = [F.count_if(low.rlike(bounded(p))).alias(n) for n, p in REPRESENTATIONS.items()]
    anyone = F.count_if(low.rlike("|".join(bounded(p) for p in REPRESENTATIONS.values()))).alias("any_form")
    one = texts.agg(*counts, anyone)
    names = [*REPRESENTATIONS, "any_form"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"`{n}`").alias("documents")) for n in names])).alias("x")).select("x.*")


def _anyone() -> str:
    return "|".join(bounded(p) for p in REPRESENTATIONS.values())


def coverage(texts: DataFrame) -> DataFrame:
    """One row: documents, those with any of the forms, their share, those without."""
    one = texts.agg(F.count("*").alias("documents"), F.count_if(F.lower("text").rlike(_anyone())).alias("matched"))
    share = F.when(F.col("documents") > 0, F.round(F.col("matched") / F.col("documents"), 6)).otherwise(0.0)
    return one.select("documents", "matched", share.alias("share"), (F.col("documents") - F.col("matched")).alias("unmatched"))


def unmatched_preview(texts: DataFrame, most: int = 10, signs: int = 500) -> DataFrame:
    """(document_id, preview): the first documents without any of the forms, by id, and how their texts begin."""
    without = texts.where(~F.lower("text").rlike(_anyone()))
    return without.orderBy("document_id").limit(most).select("document_id", F.substring("text", 1, signs).alias("preview"))
