"""Search over the token table: words, phrases, sentences, proximity, literal text; results deduplicated, ranked, with context.

Each search first filters the token table by the query's few terms, as literals that reach the scan; only the occurrences left are grouped by sentence.
The table of an index lies sorted by base and surface, so a search reads the row groups of its terms.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .ranks import ranked

TYPES = ("auto", "word", "phrase", "sentence", "literal")
PLACE = ["document_id", "segment_id", "sentence_index"]
HIT = ["document_id", "segment_id", "match_type", "match_method", "similarity", "word_position", "char_start", "char_end"]
_TERM = re.compile(r"\d+(?:[.,]\d+)*(?:[‐‑‒–—-]\d+(?:[.,]\d+)*)?(?:%|[A-Za-z]+)?|[^\W_]+(?:[.'’/‐‑‒–—-][^\W_]+)*%?")


def folded(term: str) -> str:
    return term.lower().replace("ß", "ss")


def base_of(term: str) -> str:
    """The base of one surface form, for query terms on the driver."""
    t = term[:-2] if term.endswith("'s") else term
    if len(t) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if len(t) > 4 and t.endswith(("ches", "shes", "xes", "zes")):
        return t[:-2]
    return t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith(("ss", "us", "is")) else t


@dataclass(frozen=True)
class QueryPlan:
    query: str
    requested: str
    kind: str
    terms: tuple[str, ...] = field(default=())
    bases: tuple[str, ...] = field(default=())


def query_kind(query: str, n: int) -> str:
    """word up to one token; sentence if it ends as one or has eight tokens; else phrase."""
    return "word" if n <= 1 else "sentence" if query.rstrip().endswith((".", "!", "?")) or n >= 8 else "phrase"


def plan_query(query: str, kind: str = "auto") -> QueryPlan:
    if kind not in TYPES:
        raise ValueError(f"query type {kind!r} is none of {TYPES}")
    terms = tuple(folded(t).replace("’", "'").strip() for t in _TERM.findall(query))
    return QueryPlan(query, kind, query_kind(query, len(terms)) if kind == "auto" else kind, terms, tuple(map(base_of, terms)))


def detected_kinds(texts: DataFrame) -> DataFrame:
    """The kind of every text of a column ``text`` taken as a query."""
    from ..functions.text import term_list

    n = F.size(term_list(F.col("text")))
    ends = F.rtrim("text").rlike(r"[.!?]$")
    return texts.select("*", n.alias("n_tokens"), F.when(n <= 1, "word").when(ends | (n >= 8), "sentence").otherwise("phrase").alias("query_type"))


def _hits(rows: DataFrame, kind: str, method: Column, similarity: Column) -> DataFrame:
    return rows.select(
        "document_id", "segment_id", F.lit(kind).alias("match_type"), method.alias("match_method"), F.round(similarity, 4).alias("similarity"), F.col("word_position").cast("bigint"), F.col("char_start").cast("bigint"), F.col("char_end").cast("bigint")
    )


def _words(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("global_word_index").alias("word_position")).drop("char_start", "char_end").withColumnsRenamed({"g_start": "char_start", "g_end": "char_end"})


def exact_word(tokens: DataFrame, plan: QueryPlan) -> DataFrame:
    """Occurrences whose surface form is the first query term."""
    if not plan.terms:
        return _hits(_words(tokens.where(F.lit(False))), "exact", F.lit("exact_word"), F.lit(1.0))
    found = tokens.where((F.col("base") == plan.bases[0]) & (F.col("surface") == plan.terms[0]))
    return _hits(_words(found), "exact", F.lit("exact_word"), F.lit(1.0))


def related_word(tokens: DataFrame, plan: QueryPlan, least: int = 4) -> DataFrame:
    """Occurrences with the same base in another form (1.0), or one base a prefix of the other (ratio of lengths)."""
    q, b = (plan.terms[0], plan.bases[0]) if plan.terms else ("", "")
    other = F.col("surface") != q
    longer = F.col("base").startswith(b) if len(b) >= least else F.lit(False)
    shorter = F.col("base").isin([b[:k] for k in range(least, len(b) + 1)]) if len(b) >= least else F.lit(False)
    found = tokens.where(F.lit(bool(q)) & other & ((F.col("base") == b) | longer | shorter))
    same = F.col("base") == b
    ratio = F.least(F.length("base"), F.lit(len(b))) / F.greatest(F.length("base"), F.lit(len(b)))
    return _hits(_words(found), "related", F.when(same, "lexical_variant").otherwise("prefix_related"), F.when(same, 1.0).otherwise(ratio))


def _anchored(tokens: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Runs of tokens equal to the terms in order: every occurrence votes for the place where its run would start; one grouping instead of a join for each term."""
    spark = tokens.sparkSession
    query = spark.createDataFrame(list(enumerate(terms)), "j int, q string")
    # As many rows as the query has terms.
    met = tokens.where(F.col("base").isin(*{base_of(t) for t in terms}) & F.col("surface").isin(*set(terms))).join(F.broadcast(query), F.col("surface") == F.col("q"))
    runs = met.groupBy(*PLACE, (F.col("word_index") - F.col("j")).alias("anchor")).agg(F.count("*").alias("k"), F.min("global_word_index").alias("word_position"), F.min("g_start").alias("char_start"), F.max("g_end").alias("char_end"))
    return runs.where(F.col("k") == len(terms))


def exact_phrase(tokens: DataFrame, plan: QueryPlan) -> DataFrame:
    """Contiguous surface forms within one sentence; two terms at least."""
    found = _anchored(tokens, plan.terms) if len(plan.terms) > 1 else _anchored(tokens, ("", ""))
    return _hits(found, "exact", F.lit("exact_phrase"), F.lit(1.0))


def _occurrences(tokens: DataFrame, plan: QueryPlan) -> DataFrame:
    """For each sentence with a query term: its occurrences in order. As long as a sentence at most."""
    seen = tokens.where(F.col("base").isin(*(set(plan.bases) or {""})))
    one = F.struct(F.col("word_index").alias("p"), F.col("base").alias("b"), "g_start", "g_end", "global_word_index")
    return seen.groupBy(*PLACE).agg(F.array_sort(F.collect_list(one)).alias("occ"))


def _windows(rows: DataFrame, end, first: str | None, k: int, extra: int, method: str) -> DataFrame:
    """Hits from the start and end of a window for each occurrence; ``end`` gives the position of the last token, null if there is none."""
    starts = F.col("occ") if first is None else F.filter("occ", lambda o: o["b"] == first)
    spans = rows.select("document_id", "segment_id", "occ", F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), end(s).alias("e")))).alias("w"))
    spans = spans.where(F.col("w.e").isNotNull() & (F.col("w.e") - F.col("w.s.p") + 1 <= k + extra))
    last = F.filter("occ", lambda o: o["p"] == F.col("w.e"))[0]
    found = spans.select("document_id", "segment_id", F.col("w.s.global_word_index").alias("word_position"), F.col("w.s.g_start").alias("char_start"), last["g_end"].alias("char_end"), (F.col("w.e") - F.col("w.s.p") + 1).alias("span"))
    return _hits(found, "related", F.lit(method), F.lit(float(k)) / F.col("span"))


def related_phrase(tokens: DataFrame, plan: QueryPlan, extra: int = 2) -> DataFrame:
    """Shortest window from each query term that holds all of them in any order, with at most ``extra`` other words."""
    need = Counter(plan.bases)

    def end(s: Column) -> Column:
        out = s["p"]
        for term, n in sorted(need.items()):
            nth = F.get(F.filter("occ", behind(term, s)), F.lit(n - 1))["p"]
            out = F.when(out.isNotNull() & nth.isNotNull(), F.greatest(out, nth))
        return out

    def behind(term: str, s: Column):
        return lambda o: (o["b"] == term) & (o["p"] >= s["p"])

    k = len(plan.bases)
    return _windows(_occurrences(tokens, plan), end, None, k, extra if k > 1 else -9, f"proximity_N{extra}")


def exact_sentence(tokens: DataFrame, sentences: DataFrame, plan: QueryPlan) -> DataFrame:
    """Sentences whose surface forms are the query's, all and in order; the hit is the whole sentence."""
    from ..functions.text import term_list

    k = len(plan.terms)
    runs = _anchored(tokens, plan.terms) if k > 1 else _anchored(tokens, ("", ""))
    fit = sentences.where(F.size(term_list(F.col("text"))) == k).select(*PLACE, F.col("g_start").alias("s"), F.col("g_end").alias("e"))
    found = runs.join(fit, PLACE).select("document_id", "segment_id", "word_position", F.col("s").alias("char_start"), F.col("e").alias("char_end"))
    return _hits(found, "exact", F.lit("exact_sentence"), F.lit(1.0))


def approximate_sentence(tokens: DataFrame, plan: QueryPlan, ratio: float = 0.30) -> DataFrame:
    """From each occurrence of the first term the others in order, greedily, with at most max(2, 30 %) other words (half to even)."""
    k = len(plan.bases)
    extra = max(2, round(k * ratio))
    rest = F.array(*[F.lit(b) for b in plan.bases[1:]]) if k > 1 else F.array().cast("array<string>")

    def end(s: Column) -> Column:
        def step(at: Column, term: Column) -> Column:
            return F.array_min(F.transform(F.filter("occ", lambda o: (o["b"] == term) & (o["p"] > at)), lambda o: o["p"]))

        return F.aggregate(rest, s["p"], step)

    return _windows(_occurrences(tokens, plan), end, plan.bases[0] if plan.bases else "", k, extra if k > 1 else -99, "ordered_proximity")


def literal_pattern(query: str) -> str:
    """The query's words, quoted, with any white space between them; case does not count."""
    return "(?i)" + r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", part) for part in query.split())


def literal(segments: DataFrame, plan: QueryPlan, tokens: DataFrame | None = None) -> DataFrame:
    """Non-overlapping occurrences of the query's text within segments; tokens do not matter. With the token table, each hit has the position of
    the word that holds its start, else of the first word it overlaps."""
    pattern = literal_pattern(plan.query)
    rows = segments.where(F.col("text").rlike(pattern) & F.lit(bool(plan.query.strip())))
    found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    pieces = F.posexplode(F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(gaps[i]).alias("gap")))).alias("i", "p")
    rows = rows.select("document_id", "segment_id", "seg_start", pieces)
    order = Window.partitionBy("document_id", "segment_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("seg_start") + F.sum(F.col("p.gap") + F.length("p.m")).over(order)
    spans = rows.select("document_id", "segment_id", (end - F.length("p.m")).alias("char_start"), end.alias("char_end"))
    return _hits(with_word(spans, tokens), "exact", F.lit("literal"), F.lit(1.0))


def with_word(spans: DataFrame, tokens: DataFrame | None) -> DataFrame:
    """Spans (document_id, segment_id, char_start, char_end) with the position of their word, null if they meet none.

    Words do not overlap and come in order, so the first that overlaps the span is the one that holds its start, if one does.
    """
    if tokens is None:
        return spans.withColumn("word_position", F.lit(None).cast("bigint"))
    words = tokens.select("document_id", "segment_id", "g_start", "g_end", "global_word_index")
    met = (F.col("s.document_id") == F.col("w.document_id")) & (F.col("s.segment_id") == F.col("w.segment_id")) & (F.col("w.g_start") < F.col("s.char_end")) & (F.col("w.g_end") > F.col("s.char_start"))
    keys = [F.col(f"s.{c}").alias(c) for c in ("document_id", "segment_id", "char_start", "char_end")]
    return spans.alias("s").join(words.alias("w"), met, "left").groupBy(*keys).agg(F.min("global_word_index").alias("word_position"))


def search(segments: DataFrame, sentences: DataFrame, tokens: DataFrame, plan: QueryPlan, extra: int = 2) -> tuple[DataFrame, DataFrame]:
    """(exact, related) hits of a plan. An ``auto`` query that finds nothing is searched as literal text: one more job."""
    none = tokens.limit(0).select(*[F.lit(None).cast("string").alias(c) if c in ("document_id", "match_type", "match_method") else F.lit(None).cast("double" if c == "similarity" else "bigint").alias(c) for c in HIT])
    if plan.kind == "word":
        exact, related = exact_word(tokens, plan), related_word(tokens, plan)
    elif plan.kind == "phrase":
        exact, related = exact_phrase(tokens, plan), related_phrase(tokens, plan, extra)
    elif plan.kind == "sentence":
        exact, related = exact_sentence(tokens, sentences, plan), approximate_sentence(tokens, plan)
    else:
        exact, related = literal(segments, plan, tokens), none
    if plan.requested == "auto" and plan.kind != "literal" and exact.isEmpty() and related.isEmpty():
        exact, related = literal(segments, plan, tokens), none
    return exact, related


def unique_hits(hits: DataFrame) -> DataFrame:
    return hits.dropDuplicates(["document_id", "segment_id", "char_start", "char_end", "match_method"])


def without_overlaps(related: DataFrame, exact: DataFrame) -> DataFrame:
    """Related hits that overlap no exact hit of their segment."""
    r, e = related.alias("r"), exact.alias("e")
    same = (F.col("r.document_id") == F.col("e.document_id")) & (F.col("r.segment_id") == F.col("e.segment_id"))
    return r.join(e, same & (F.col("r.char_start") < F.col("e.char_end")) & (F.col("e.char_start") < F.col("r.char_end")), "left_anti")


def results(exact: DataFrame, related: DataFrame) -> DataFrame:
    """Both kinds of hits deduplicated, overlaps removed, ranked: exact first by place, then related by similarity and place. Ranks are made by ranges."""
    exact = unique_hits(exact)
    both = exact.unionByName(without_overlaps(unique_hits(related), exact))
    exactly = F.col("match_type") == "exact"
    order = [F.when(exactly, 0).otherwise(1).asc(), F.when(exactly, 0.0).otherwise(-F.col("similarity")).asc(), *(F.asc(c) for c in ("document_id", "char_start", "char_end", "match_method"))]
    return ranked(both, [], order, "result_rank")


def with_context(hits: DataFrame, sentences: DataFrame, segments: DataFrame, around: int = 120) -> DataFrame:
    """Hits with the sentence that holds their start, else the text around them, and the matched text."""
    s = sentences.select("document_id", "segment_id", F.col("g_start").alias("a"), F.col("g_end").alias("b"), F.col("text").alias("sentence"))
    key = ["document_id", "segment_id"]
    place = hits.join(segments.select(*key, "text", "seg_start"), key)
    met = place.join(s.withColumnsRenamed({"document_id": "d2", "segment_id": "s2"}), (place.document_id == F.col("d2")) & (place.segment_id == F.col("s2")) & (F.col("a") <= F.col("char_start")) & (F.col("char_start") < F.col("b")), "left")
    at = F.col("char_start") - F.col("seg_start")
    near = F.substring("text", F.greatest(at - around, F.lit(0)).cast("int") + 1, (F.col("char_end") - F.col("char_start") + 2 * around).cast("int"))
    matched = F.substring("text", at.cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    return met.select(*hits.columns, matched.alias("matched_text"), F.coalesce("sentence", near).alias("context"))


def document_results(hits: DataFrame) -> DataFrame:
    """Hits by document: counts, best similarity, rank by exact, all, id."""
    exact = F.count_if(F.col("match_type") == "exact")
    rows = hits.groupBy("document_id").agg(exact.alias("exact_count"), (F.count("*") - exact).alias("related_count"), F.count("*").alias("total_count"), F.max("similarity").alias("max_similarity"))
    return ranked(rows, [], [F.desc("exact_count"), F.desc("total_count"), F.asc("document_id")], "document_rank")


def summary(hits: DataFrame) -> DataFrame:
    exact = F.count_if(F.col("match_type") == "exact")
    return hits.agg(F.countDistinct("document_id").alias("documents_found"), exact.alias("exact_results"), (F.count("*") - exact).alias("related_results"), F.count("*").alias("total_results"))


def page(documents: DataFrame, number: int, size: int = 10) -> DataFrame:
    """One page of ranked documents; a number before the first or behind the last page gives that page."""
    size = max(1, size)
    last = -(-(documents.agg(F.max("document_rank")).first()[0] or 0) // size)
    first = (max(1, min(number, max(1, last))) - 1) * size
    return documents.where(F.col("document_rank").between(first + 1, first + size))


@dataclass(frozen=True)
class Found:
    """What a search gives: its plan, all hits with context and rank, documents by rank, one row of counts."""

    plan: QueryPlan
    hits: DataFrame
    documents: DataFrame
    summary: DataFrame


def run_search(index: Index, query: str, kind: str = "auto", extra: int = 2) -> Found:
    """A whole search over an index: plan, retrieval, deduplication, overlaps, ranks, context, documents. No query term gives empty results."""
    plan = plan_query(query, kind)
    exact, related = search(index.segments, index.sentences, index.tokens, plan, extra)
    hits = results(exact, related)
    return Found(plan, with_context(hits, index.sentences, index.segments), document_results(hits), summary(hits))


def with_metadata(rows: DataFrame, documents: DataFrame, *ids: str) -> DataFrame:
    """Rows with a document_id joined to the metadata of the document that bears it under any of its ids (pmcid, pmid, filename); empty ids bear nothing."""
    keys = F.array_distinct(F.filter(F.array(*[F.col(i).cast("string") for i in ids]), lambda k: k.isNotNull() & (k != "")))
    named = documents.withColumn("document_id", F.explode(keys))
    # Of several documents under one id the last by its own ids counts.
    last = named.groupBy("document_id").agg(F.max(F.struct(*ids, *[c for c in documents.columns if c not in ids])).alias("m"))
    return rows.join(last, "document_id", "left").select(*rows.columns, *[F.col(f"m.{c}").alias(c) for c in documents.columns if c not in rows.columns])


def highlighted(text: Column, matched: str) -> Column:
    """The first occurrence, whatever its case, between marks; the rest escaped for HTML."""

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    at = F.locate(matched.lower(), F.lower(text))
    hit = F.concat(safe(F.substring(text, F.lit(1), at - 1)), F.lit("<mark>"), safe(F.substring(text, at, F.lit(len(matched)))), F.lit("</mark>"), safe(F.substring(text, at + len(matched), F.length(text))))
    return F.when(at > 0, hit).otherwise(safe(text))
