"""The tables everything else reads: segments, sentences, tokens, tokens by condition, term statistics.

All of them are narrow or partitioned by document; only term statistics shuffle by term, after a partial count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stemmed, token_parts
from ..plans.stage import spread, written

CONDITIONS = ["A_basic", "B_no_punctuation", "C_no_stopwords", "D_porter"]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, text, lang, source): one row for each document with a text."""
    read = spark.read.parquet(f"{folder}/documents.parquet")
    return spread(read.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("document_id"), "text", "lang", "source"))


def segments(docs: DataFrame) -> DataFrame:
    """(document_id, segment_id, field, text, seg_start): non-empty normalised lines; seg_start is the offset in the text of all, joined by one sign."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.normal_statistics), lambda x: x != "")
    # The one shuffle of all positions: whole texts by document, before they are taken apart.
    rows = docs.select("document_id", "text").repartition("document_id").select("document_id", F.posexplode(lines).alias("segment_id", "text"))
    before = Window.partitionBy("document_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return rows.select("document_id", "segment_id", F.lit("body").alias("field"), "text", start.cast("bigint").alias("seg_start"))


def sentences(segs: DataFrame) -> DataFrame:
    """(document_id, segment_id, sentence_index, global_sentence_index, text, char_start, char_end, g_start, g_end)."""
    rows = segs.select("document_id", "segment_id", "seg_start", F.posexplode(T.sentence_list(F.col("text"))).alias("sentence_index", "text"))
    before = Window.partitionBy("document_id", "segment_id").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("document_id").orderBy("segment_id", "sentence_index")
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("bigint")
    rows = rows.withColumn("char_start", start).withColumn("global_sentence_index", F.row_number().over(order).cast("bigint") - 1)
    end = F.col("char_start") + F.length("text")
    return rows.select(
        "document_id", "segment_id", "sentence_index", "global_sentence_index", "text", "char_start", end.alias("char_end"), (F.col("seg_start") + F.col("char_start")).alias("g_start"), (F.col("seg_start") + end).alias("g_end")
    )


def tokens(sents: DataFrame) -> DataFrame:
    """One row for each search token, with its place in sentence, segment and document.

    A token cannot cross a sentence boundary, so sentences are tokenised one by one and the word-to-sentence range join is not needed. What lies between
    the tokens gives the offsets: they are running sums over gaps and tokens.
    """
    found, gaps = T.term_list(F.col("text")), F.split("text", T.TERM_PATTERN)
    pairs = F.transform(found, lambda t, i: F.struct(t.alias("t"), F.length(gaps[i]).alias("gap")))
    rows = sents.select("document_id", "segment_id", "sentence_index", F.col("char_start").alias("s"), (F.col("g_start") - F.col("char_start")).alias("seg"), F.posexplode(pairs).alias("i", "p"))
    # Offsets count from the start of the sentence. Segments lie by document already (their offsets need it), which serves all windows here.
    inside = Window.partitionBy("document_id", "segment_id", "sentence_index").orderBy("i")
    end = F.sum(F.col("p.gap") + F.length("p.t")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("s")
    segment = Window.partitionBy("document_id", "segment_id").orderBy("sentence_index", "i")
    whole = Window.partitionBy("document_id").orderBy("segment_id", "sentence_index", "i")
    rows = rows.select("*", end.cast("bigint").alias("char_end"), (F.row_number().over(segment) - 1).alias("word_index"), (F.row_number().over(whole).cast("bigint") - 1).alias("global_word_index"))
    start = F.col("char_end") - F.length("p.t")
    out = rows.select(
        "document_id", "segment_id", "sentence_index", "word_index", "global_word_index", F.col("p.t").alias("text"), T.fold(F.col("p.t")).alias("term"), T.surface(F.col("p.t")).alias("surface"),
        start.alias("char_start"), "char_end", (F.col("seg") + start).alias("g_start"), (F.col("seg") + F.col("char_end")).alias("g_end"),
    )
    return out.withColumn("base", F.expr(T.lexical_base("surface")))


def corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, sentences and tokens of the documents table."""
    segs = segments(documents(spark, folder))
    sents = sentences(segs)
    return segs, sents, tokens(sents)


def counted(docs: DataFrame, condition: str, stopwords: list[str] | None = None, tokenizer: Callable[[Column], Column] = T.folded_terms) -> DataFrame:
    """(document_id, term, n): terms of a condition by document, D excepted. Narrow up to a partial count.

    stopwords: those of condition C instead of the usual ones; tokenizer: text to an array of folded terms, for B and C.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), T.normal_statistics), lambda x: x != "")
    whole = F.array_join(lines, "\n")
    if condition.startswith("A"):
        terms = T.fold_list(F.regexp_extract_all(whole, F.lit("(?U)\\S+"), F.lit(0)))
    else:
        terms = tokenizer(whole)
    rows = docs.select("document_id", F.explode(terms).alias("term")).where(F.col("term") != "")
    if condition.startswith("C"):
        left_out = T.STOPWORDS if stopwords is None else [w.lower().replace("ß", "ss") for w in stopwords]
        rows = rows.where(~F.col("term").isin(left_out))
    return rows.groupBy("document_id", "term").agg(F.count("*").alias("n"))


def stem_map(terms: DataFrame) -> DataFrame:
    """(term, stem): each distinct term stemmed part by part; its joining signs stay, a curly apostrophe as a straight one.

    Stemming runs over the vocabulary, not over the tokens.
    """
    vocabulary = terms.select("term").distinct()
    parts = vocabulary.select("term", F.posexplode(token_parts(F.col("term"))).alias("i", "part"))
    words = stemmed(parts.select(F.col("part").alias("word")))
    back = parts.join(words, parts.part == words.word).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("i", "stem"))).alias("p"))
    return back.select("term", F.replace(F.array_join(F.col("p.stem"), ""), F.lit("’"), F.lit("'")).alias("stem"))


#: The most widely held terms, whose values go to every task instead of being joined by term. A constant, whatever the collection.
COMMON = 20_000


def by_term(rows: DataFrame, values: DataFrame, common: int = COMMON) -> DataFrame:
    """Rows with a term joined to the values of their term (term, df, ...): terms held by many documents never meet in one task.

    The values of the ``common`` most widely held terms are sent along; the rows of all other terms meet theirs in a shuffle join.
    """
    head = F.broadcast(values.orderBy(F.desc("df"), "term").limit(common))
    known = rows.join(head, "term", "left")
    rest = known.where(F.col("df").isNull()).select(*rows.columns).join(values, "term")
    return known.where(F.col("df").isNotNull()).unionByName(rest)


def restemmed(counts: DataFrame) -> DataFrame:
    """Counts by stem instead of term."""
    held = counts.groupBy("term").agg(F.count("*").alias("df"))
    stems = written(held.join(stem_map(held), "term"))
    return by_term(counts, stems).where(F.col("stem") != "").groupBy("document_id", F.col("stem").alias("term")).agg(F.sum("n").alias("n"))


def condition_counts(docs: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(condition, document_id, term, n) for the conditions asked for; D is C by stem."""
    out = None
    for condition in conditions:
        part = restemmed(counted(docs, "C")) if condition.startswith("D") else counted(docs, condition)
        part = part.select(F.lit(condition).alias("condition"), "document_id", "term", "n")
        out = part if out is None else out.unionByName(part)
    return out


def before_and_after_stems(counts: DataFrame) -> DataFrame:
    """(condition, documents, tokens_before, tokens_after, vocabulary_before, vocabulary_after, reduction, reduction_ratio) of conditions A, B and C, as they are and stemmed."""
    out = None
    for condition in CONDITIONS[:3]:
        plain = counts.where(F.col("condition") == condition).select("document_id", "term", "n")
        both = plain.withColumn("side", F.lit("before")).unionByName(restemmed(plain).withColumn("side", F.lit("after"))).withColumn("condition", F.lit(condition))
        out = both if out is None else out.unionByName(both)
    terms = out.groupBy("condition", "side", "term").agg(F.sum("n").alias("cf"))
    sizes = terms.groupBy("condition").pivot("side", ["before", "after"]).agg(F.sum("cf").alias("tokens"), F.count("term").alias("vocabulary"))
    docs = counts.groupBy("condition").agg(F.countDistinct("document_id").alias("documents"))
    rows = sizes.join(docs, "condition").select("condition", "documents", *[F.col(f"{side}_{m}").alias(f"{m}_{side}") for m in ("tokens", "vocabulary") for side in ("before", "after")])
    rows = rows.withColumn("reduction", F.col("vocabulary_before") - F.col("vocabulary_after"))
    return rows.withColumn("reduction_ratio", F.when(F.col("vocabulary_before") > 0, F.round(F.col("reduction") / F.col("vocabulary_before"), 6)).otherwise(0.0))


def term_stats(counts: DataFrame) -> DataFrame:
    """(condition, term, cf, df)."""
    return counts.groupBy("condition", "term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
