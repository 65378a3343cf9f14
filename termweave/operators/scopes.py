"""Segments of parsed documents: what is searched, and what statistics count. Rows are the parsers' (``sources.markup.ROW``) with a document_id.

Every part of a document becomes an array of (field, label, nlm_category, text, counted); the parts are joined in their order and numbered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Labels of sections that are no prose.
NO_PROSE = ["trial registration", "registration number", "clinical trial registration", "trial registration number", "registry number", "prospero"]


def document_id(*ids: str) -> Column:
    """The first of the ids that is neither null nor empty: pmcid, pmid, filename."""
    return F.coalesce(*[F.nullif(F.col(i), F.lit("")) for i in ids or ("pmcid", "pmid", "filename")])


def is_prose(label: Column, category: Column) -> Column:
    """Whether a section counts sentences: by its label, or its category if it has none."""
    shown = F.lower(F.coalesce(F.nullif(label, F.lit("")), F.nullif(category, F.lit("")), F.lit("")))
    return ~shown.rlike("|".join(NO_PROSE))


def _part(field: str, text: Column, counted: Column | bool = True, label: Column | str = "", category: Column | str = "") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(field).alias("field"), F.coalesce(as_column(label), F.lit("")).alias("label"), F.coalesce(as_column(category), F.lit("")).alias("nlm_category"), T.normal_statistics(text).alias("text"), as_column(counted).alias("counted"))


def _each(field: str, column: str, text=lambda x: x, counted: bool = True) -> Column:
    return F.transform(F.col(column), lambda x: _part(field, text(x), counted))


def _abstract(prose_only: bool) -> Column:
    return F.transform("abstract_sections", lambda s: _part("abstract", s["text"], is_prose(s["label"], s["nlm_category"]) if prose_only else True, s["label"], s["nlm_category"]))


def _defined(d: Column) -> Column:
    return F.concat_ws(" ", d["term"], d["definition"])


def _numbered(documents: DataFrame, parts: Column) -> DataFrame:
    kept = F.filter(parts, lambda p: p["text"] != "")
    return documents.select("document_id", F.posexplode(kept).alias("segment_id", "p")).select("document_id", "segment_id", "p.*")


def search_segments(documents: DataFrame) -> DataFrame:
    """(document_id, segment_id, field, label, nlm_category, text, counted): the abstract alone for the corpus of abstracts and for PubMed records
    (whose registration sections count no sentences), every part for whole documents. Empty parts have no number."""
    figures = F.flatten(F.transform("figures", lambda f: F.array(_part("figure_label", f["label"]), _part("figure_caption", f["caption"]))))
    tables = F.flatten(F.transform("tables", lambda t: F.array(_part("table_label", t["label"]), _part("table_caption", t["caption"]), _part("table_text", t["text"]))))
    whole = F.concat(
        F.array(_part("title", F.col("title"))), _each("author", "authors"), _each("affiliation", "affiliations"), _each("keyword", "keywords"), _each("abstract_section_title", "abstract_section_titles"),
        F.transform("abstract_sections", lambda s: _part("abstract", s["text"])), _each("definition", "definitions", _defined), _each("section_title", "section_titles"), _each("body", "body"), figures, tables,
        _each("acknowledgment", "acknowledgments"), _each("reference", "refs"),
    )
    scoped = F.when(F.col("search_scope") == "abstract_only", _abstract(False)).when(F.col("source_format") == "PubMed", _abstract(True)).otherwise(whole)
    return _numbered(documents, scoped)


def statistics_segments(documents: DataFrame) -> DataFrame:
    """The same for document statistics: titles, definitions and table texts count no sentences; authors, keywords and references are left out."""
    tables = F.flatten(F.transform("tables", lambda t: F.array(_part("table_caption", t["caption"]), _part("table_text", t["text"], False))))
    parts = F.concat(
        F.array(_part("title", F.col("title"), False)), _each("abstract_section_title", "abstract_section_titles", counted=False), F.transform("abstract_sections", lambda s: _part("abstract", s["text"])),
        _each("definition", "definitions", _defined, False), _each("section_title", "section_titles", counted=False), _each("body", "body"), _each("figure_caption", "figures", lambda f: f["caption"]), tables, _each("acknowledgment", "acknowledgments"),
    )
    return _numbered(documents, parts)


def section_sentences(documents: DataFrame) -> DataFrame:
    """(document_id, segment_id, sentence_index, text): sentences of the abstract's prose sections, each section by itself."""
    prose = _numbered(documents, _abstract(True)).where("counted")
    return prose.select("document_id", "segment_id", F.posexplode(T.sentence_list(F.col("text"))).alias("sentence_index", "text"))


def document_texts(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, pos, text): the texts of a document's segments, in order; for a document without segments its ``search_text``, if it has one."""
    rows = segments.where(F.trim("text") != "").select("document_id", F.col("segment_id").alias("pos"), F.trim("text").alias("text"))
    rest = documents.join(rows.select("document_id").distinct(), "document_id", "left_anti").where(F.trim("search_text") != "")
    return rows.unionByName(rest.select("document_id", F.lit(0).alias("pos"), F.trim("search_text").alias("text")))


def token_stream(tokens: DataFrame) -> DataFrame:
    """(document_id, tokens): the words of each document in order. As long as a document."""
    rows = tokens.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("global_word_index", "text"))).alias("t"))
    return rows.select("document_id", F.col("t.text").alias("tokens"))


def document_statistics(documents: DataFrame) -> DataFrame:
    """(document_id, characters, characters_without_spaces, words, reported_words, difference, sentences): over the text that statistics count, and sentences over
    the counted segments; the difference is to the count the document reports of itself, null where that is no number."""
    text = F.coalesce("statistics_text", F.lit(""))
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    reported = F.expr("try_cast(reported['word-count'] AS bigint)")
    sizes = documents.select("document_id", F.length(text).alias("characters"), F.length(F.regexp_replace(text, r"\s", "")).alias("characters_without_spaces"), words.cast("bigint").alias("words"), reported.alias("reported_words"))
    counted = statistics_segments(documents).where("counted").groupBy("document_id").agg(F.sum(F.size(T.sentence_list(F.col("text")))).alias("sentences"))
    rows = sizes.join(counted, "document_id", "left")
    return rows.select("document_id", "characters", "characters_without_spaces", "words", "reported_words", (F.col("words") - F.col("reported_words")).alias("difference"), F.coalesce("sentences", F.lit(0)).alias("sentences"))
