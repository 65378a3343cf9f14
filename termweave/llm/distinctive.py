"""How distinctive a term is for a record, against the whole collection.

Two SQL aggregations: the first gives the local frequency of each term in each record, the second the
spread of each term over the records (records holding it, total, sum of f ln f). From the two come the
log-entropy weight ``log10(1 + f) * (1 - H / ln N)``, where H is the entropy of the term's spread over
the N records, and ``f * log10(N / df)``.

Defined results. A null record key belongs to no record and is left out, so are null and blank terms and terms without a letter.
Rows equal in every column count once. A record without terms gives no row. N = 1 gives the weight 1 - 0 = 1
for the entropy factor and 0 for the other score. Ties go to the term first in code point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_list
from ..plans.stage import written

#: Terms held in most records whose spread is sent to every task. A constant, whatever the collection.
COMMON_TERMS = 20_000


def local_frequencies(words: DataFrame) -> DataFrame:
    """(record, term, f) from rows of (record, part, words: array<struct<text, ...>>), and one row with a null term for each record.

    One shuffle, of whole rows by record; the frequencies are then counted where the rows lie. Copies of a
    row are told from other rows of the same part by a hash over the whole list of words.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        words.where(F.col("record").isNotNull())
        .select("record", "part", F.xxhash64("words", *[c for c in words.columns if c not in ("words", "record", "part")]).alias("copy"), F.col("words.text").alias("texts"))
        .repartition(parts, "record")
        .dropDuplicates(["record", "part", "copy"])
    )
    kept = fold_list(F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    return (
        rows.select("record", F.explode(F.concat(kept, F.array(F.lit(None).cast("string")))).alias("term"))
        .where(F.col("term").isNull() | F.col("term").rlike(r"\p{L}"))
        .groupBy("record", "term")
        .agg(F.count("*").alias("f"))
    )


def term_spread(local: DataFrame) -> DataFrame:
    """(term, df, cf, flnf): records holding the term, its total and sum of f ln f."""
    f = F.col("f").cast("double")
    return local.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("cf"), F.sum(f * F.log(f)).alias("flnf"))


def tf_idf(n: Column) -> Column:
    return F.round(F.col("f") * F.log10(n / F.col("df")), 6)


def log_entropy(n: Column) -> Column:
    entropy = F.log(F.col("cf").cast("double")) - F.col("flnf") / F.col("cf")
    spread = F.when(n > 1, entropy / F.log(n)).otherwise(F.lit(0.0))
    return F.round(F.log10(1 + F.col("f")) * (1 - spread), 6)


def distinctive_terms(words: DataFrame, score, top: int = 3, least_df: int = 2, common: int = COMMON_TERMS) -> DataFrame:
    """(record, term, f, df, score): the up to ``top`` terms of highest score of each record.

    A term qualifies if it has a letter and at least ``least_df`` records hold it. The spread of the
    ``common`` most widely held terms goes to every task (a fixed number of rows), so that a term held by a third of
    all records never meets in one reducer; of those terms each record keeps its best ``top`` on the spot.
    All other terms meet their spread in a shuffle join, where no key is frequent any more.
    """
    # Written once, by record; the spread, the scores and N all read it.
    every = written(local_frequencies(words), by="record")
    total = every.where(F.col("term").isNull()).count()
    local = every.where(F.col("term").isNotNull())
    n = F.lit(float(total))
    spread = written(term_spread(local).where(F.col("df") >= least_df))
    head = F.broadcast(spread.orderBy(F.desc("df"), "term").limit(common))
    known = local.join(head, "term", "left").withColumn("score", score(n))

    # Terms of the head compete at once; the others wait, with their term as key. What has its score already
    # takes its record as key, which spreads it evenly and finds nothing.
    waits = F.col("df").isNull()
    early = Window.partitionBy("record", waits).orderBy(F.desc("score"), "term")
    left = (
        known.withColumn("rank", F.row_number().over(early))
        .where(waits | (F.col("rank") <= top))
        .select("record", "term", "f", F.col("df").alias("df0"), F.col("score").alias("score0"), F.when(waits, F.col("term")).otherwise(F.concat(F.lit("\x01"), "record")).alias("key"))
    )
    late = left.join(spread.withColumnRenamed("term", "key"), "key", "left").withColumn("late", score(n))
    scored = late.select("record", "term", "f", F.coalesce("df0", "df").alias("df"), F.coalesce("score0", "late").alias("score")).where(F.col("df").isNotNull())
    best = Window.partitionBy("record").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank")


def from_positioned(positioned: DataFrame) -> DataFrame:
    """The rows the operator takes, from a table of segments with word positions."""
    return positioned.select(F.col("document_id").alias("record"), F.col("segment_id").alias("part"), "words", "field", "journal")
