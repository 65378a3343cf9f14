"""Zipf tables and fits, IDF and TF-IDF, significant words, condition and domain comparisons.

Ranks are made by ranges (`ranks.ranked`): no task sorts the vocabulary of a condition. Windows are left only where a
filter on a small rank stands above them, which Spark turns into the best k of each partition before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .tables import by_term


def zipf_table(stats: DataFrame) -> DataFrame:
    """Rank, probability, rank times frequency and logarithms of every term, by condition; ties by term."""
    seen = stats.where(F.col("cf") > 0).select("condition", "term", F.col("cf").alias("frequency"))
    rows = ranked(seen, ["condition"], [F.desc("frequency"), F.asc("term")], "rank")
    total = F.broadcast(rows.groupBy("condition").agg(F.sum("frequency").alias("total")))
    rows = rows.join(total, "condition").select("condition", "term", "rank", "frequency", (F.col("frequency") / F.col("total")).alias("probability"))
    return rows.select("*", (F.col("rank") * F.col("frequency")).alias("rank_frequency"), F.log10("rank").alias("log_rank"), F.log10("frequency").alias("log_frequency"))


def fitted(rows: DataFrame, *keys: str) -> DataFrame:
    """Least squares of log frequency on log rank for each group: null fit for fewer than two points or one rank, null R² where all frequencies are equal."""
    x, y = F.col("log_rank"), F.col("log_frequency")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_r2(y, x).alias("r2"),
        F.min("rank").alias("rank_start"), F.max("rank").alias("rank_end"),
    )
    valid = (F.col("n") >= 2) & (F.col("sxx") > 1e-15)
    flat = F.col("syy") <= 1e-15
    rest = F.greatest(F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"), F.lit(0.0))
    return sums.select(
        *keys, valid.alias("valid"), "n", F.when(valid, F.round("b", 6)).alias("slope"), F.when(valid, F.round("a", 6)).alias("intercept"), F.when(valid, F.round(-F.col("b"), 6)).alias("zipf_exponent"),
        F.when(valid & ~flat, F.round("r2", 6)).alias("r_squared"), F.when(valid, F.round(F.sqrt(rest / F.col("n")), 6)).alias("rmse"), "rank_start", "rank_end",
    )


def regions(table: DataFrame) -> DataFrame:
    """The rank table with the third each rank lies in."""
    sizes = F.broadcast(table.groupBy("condition").agg(F.max("rank").alias("n")))
    name = F.when(F.col("rank") <= F.ceil(F.col("n") / 3), "high").when(F.col("rank") <= F.ceil(2 * F.col("n") / 3), "middle").otherwise("low")
    return table.join(sizes, "condition").withColumn("region", name).drop("n")


def best_region(fits: DataFrame) -> DataFrame:
    """The region of best fit by (R², -RMSE), among those with an R²."""
    order = Window.partitionBy("condition").orderBy(F.desc("r_squared"), "rmse", "rank_start")
    return fits.where(F.col("r_squared").isNotNull()).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def frequency_summary(stats: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.col("cf")).alias("cf"), "term"))["term"]
    return stats.groupBy("condition").agg(
        F.sum("cf").alias("total_tokens"), F.count("*").alias("vocabulary"), F.count_if(F.col("cf") == 1).alias("singletons"), (F.count_if(F.col("cf") == 1) / F.count("*")).alias("singleton_ratio"), first.alias("most_common"), F.max("cf").alias("most_common_frequency")
    )


def reported(fits: DataFrame, preferred: str = "B_no_punctuation", baseline: DataFrame | None = None) -> DataFrame:
    """The fit a report shows: that of the preferred condition, else the baseline's, else none."""
    chosen = fits.where(F.col("condition") == preferred)
    return baseline if baseline is not None and chosen.isEmpty() else chosen


def idf(n: Column, df: Column, base: float = 10.0) -> Column:
    """log(N / df) to a base; null where either is not positive."""
    value = F.log10(n / df) if base == 10.0 else F.log(n / df) / F.log(F.lit(float(base)))
    return F.when((n > 0) & (df > 0), value)


def term_rows(stats: DataFrame, n: float) -> DataFrame:
    total = F.lit(float(n))
    return stats.select(
        *[c for c in stats.columns if c not in ("cf", "df")], F.col("cf").alias("collection_frequency"), F.col("df").alias("document_frequency"), F.when(total > 0, F.col("df") / total).alias("document_coverage"),
        F.when(F.col("df") > 0, F.col("cf") / F.col("df")).alias("cf_per_containing_document"), F.round(idf(total, F.col("df")), 9).alias("idf"),
    )


def top_terms(stats: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("condition").orderBy(F.desc("cf"), F.desc("df"), "term")
    return stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_tfidf(counts: DataFrame, stats: DataFrame, n: float, normalised: bool = False, terms: list[str] | None = None, base: float = 10.0, document: str | None = None) -> DataFrame:
    """(document_id, term, tf, idf, tf_idf): raw or length-normalised term frequency times IDF.

    terms: only these, folded; document: only this one, ValueError if the collection has none of that id.
    """
    if document is not None:
        counts = counts.where(F.col("document_id") == document)
        if counts.isEmpty():
            raise ValueError(f"unknown document {document!r}")
    lengths = counts.groupBy("document_id").agg(F.sum("n").alias("total")) if normalised else None
    rows = counts.select("document_id", "term", "n")
    if terms is not None:
        rows = rows.where(F.col("term").isin([t.lower().replace("ß", "ss") for t in terms]))
    tf = F.col("n") / F.col("total") if normalised else F.col("n").cast("double")
    rows = rows.join(lengths, "document_id") if normalised else rows
    value = idf(F.lit(float(n)), F.col("df"), base)
    met = by_term(rows.select("document_id", "term", tf.alias("tf")), stats.select("term", "df"))
    return met.select("document_id", "term", F.round("tf", 9).alias("tf"), F.round(value, 9).alias("idf"), F.round(F.col("tf") * value, 9).alias("tf_idf"))


def significant_words(stats: DataFrame, n: float, k: int = 20) -> DataFrame:
    """Terms by log10(1 + cf) * idf, with their rank by frequency; ties by that rank, then by term."""
    rows = ranked(stats, ["condition"], [F.desc("cf"), F.desc("df"), F.asc("term")], "frequency_rank")
    rows = rows.withColumn("score", F.round(F.log10(1 + F.col("cf")) * idf(F.lit(float(n)), F.col("df")), 9))
    order = Window.partitionBy("condition").orderBy(F.desc("score"), "frequency_rank", "term")
    return rows.withColumn("significance_rank", F.row_number().over(order)).where(F.col("significance_rank") <= k)


# Exponents and widths of the two sides of the curve; the default cut-offs.
LEFT_POWER, LEFT_WIDTH, RIGHT_POWER, RIGHT_WIDTH = 2.2, 1.35, 1.8, 0.90
UPPER, LOWER = 0.05, 0.25


def resolving_curve(ranks: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The conceptual curve of resolving power over ranks: a hump between two cut-offs, steeper on its left, with a maximum of 1.

    The cut-offs are put in order and kept within 1 and the last rank; the lower one stays below the upper. Without cut-offs they are a twentieth and a quarter of the ranks.
    """
    last = ranks.agg(F.max("rank")).first()[0] or 1
    low, high = (max(1, round(last * UPPER)) if low is None else low), (max(2, round(last * LOWER)) if high is None else high)
    low, high = min(low, high), max(low, high)
    low = min(max(1, low), max(1, last - 1))
    high = min(max(low + 1, high), max(low + 1, last))
    middle, half = (low + high) / 2, max(1.0, (high - low) / 2)
    d = F.col("rank") - middle
    left = 1 / (1 + F.pow(-d / max(1.0, half / LEFT_WIDTH), F.lit(LEFT_POWER)))
    right = 1 / (1 + F.pow(d / max(1.0, half / RIGHT_WIDTH), F.lit(RIGHT_POWER)))
    rows = ranks.withColumn("v", F.when(d <= 0, left).otherwise(right))
    highest = rows.agg(F.max("v")).first()[0]
    return rows.select("rank", F.round(F.col("v") / F.lit(highest), 9).alias("resolving_power"))


def domain_measures(counts: DataFrame) -> DataFrame:
    """Size and fit of each domain over (domain, document_id, term, n): documents, tokens, vocabulary, average tokens, exponent, R², RMSE."""
    terms = counts.groupBy("domain", "term").agg(F.sum("n").alias("cf"))
    sizes = terms.groupBy("domain").agg(F.sum("cf").alias("tokens"), F.count("*").alias("vocabulary"))
    docs = counts.groupBy("domain").agg(F.countDistinct("document_id").alias("documents"))
    fits = fitted(zipf_table(terms.withColumnRenamed("domain", "condition")), "condition").select(F.col("condition").alias("domain"), "zipf_exponent", "r_squared", "rmse")
    both = sizes.join(docs, "domain").join(fits, "domain", "left")
    return both.withColumn("average_tokens", F.round(F.col("tokens") / F.col("documents"), 6))


# Words that the last resort of representative terms passes over.
FUNCTION_WORDS = "and the of in to a with for that is were was are as by on or from at be their not an have has this these".split()


def representative_terms(stats: DataFrame, asked: list[tuple[str, list[str]]], others: list[str], most: int) -> DataFrame:
    """(priority, asked, term, cf, df): the asked terms, each by its first spelling that exists, then of the others as many as are missing, then
    the most frequent terms that are no function words, until there are ``most``; no term twice. ``asked`` is null for the last.

    The lists are a few words; what is read of the statistics is a filter on them and one top list.
    """
    names = [t for t, _ in asked] + [x for _, al in asked for x in al] + others
    known = {r["term"]: r for r in stats.where(F.col("term").isin(names)).select("term", "cf", "df").collect()}
    rows, taken = [], set()
    for wanted, spellings in [(t, [t, *al]) for t, al in asked] + [(t, [t]) for t in others]:
        if wanted in others and wanted not in [t for t, _ in asked] and len(rows) >= most:
            break
        found = next((x for x in spellings if x in known and x not in taken), None)
        if found:
            taken.add(found)
            rows.append((wanted, found, known[found]["cf"], known[found]["df"]))
    rows = rows[:most]
    if len(rows) < most:
        left = stats.where(~F.col("term").isin(sorted(taken | set(FUNCTION_WORDS))) & (F.trim("term") != ""))
        for r in left.orderBy(F.desc("cf"), "term").limit(most - len(rows)).select("term", "cf", "df").collect():
            rows.append((None, r["term"], r["cf"], r["df"]))
    numbered = [(i, *r) for i, r in enumerate(rows)]
    return stats.sparkSession.createDataFrame(numbered, "priority int, asked string, term string, cf bigint, df bigint")
