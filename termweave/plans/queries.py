"""The core's queries by name, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stemmed
from ..operators import expansion as E
from ..operators import index as I
from ..operators import retrieval as R
from ..operators import scopes as P
from ..operators import statistics as S
from ..operators import tables as X
from ..operators.skipgram import trained
from ..sources import artifacts, audit, ids, markup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORD, PHRASE, SENTENCE, LITERAL = "adults", "shift workers", "Ethical approval was granted by the review board.", "kidney transplant"
APPROXIMATE = "The calculator was written in JavaScript."
OVERLAPPING = "at 6"  # stands as it is, and with words in between
AUTO = "ransplant recip"  # no tokens of the data: found as literal text
MISSPELT = "obesty treatmnt gastric"

EVERY = 20  # vectors whose id it divides are searched for
DOCUMENT = "25"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return X.documents(spark, d)


def _n(docs: DataFrame) -> float:
    return float(docs.count())


def _counts(spark, d):
    return I.counts_of_folder(spark, d)[0]


def _stats(spark, d):
    return I.counts_of_folder(spark, d)[1]


def _b(spark, d):
    """Term statistics of condition B: those of the index."""
    return I.of_folder(spark, d).terms.select(F.lit("B_no_punctuation").alias("condition"), "term", "cf", "df")


# --- text ---------------------------------------------------------------------------------------------------------


@query
def norm_text(spark, d):
    return _docs(spark, d).select("document_id", T.normal(F.col("text")).alias("norm"))


@query
def norm_stats_text(spark, d):
    return _docs(spark, d).select("document_id", T.normal_statistics(F.col("text")).alias("norm"))


@query
def tokenize_words(spark, d):
    return _docs(spark, d).select("document_id", F.posexplode(T.term_list(T.normal_statistics(F.col("text")))).alias("pos", "token"))


def _condition(letter):
    def run(spark, d):
        return X.condition_counts(_docs(spark, d), [letter]).select("document_id", "term", "n")

    return run


for _name, _key in (("tokens_a", "A_basic"), ("tokens_b", "B_no_punctuation"), ("tokens_c", "C_no_stopwords"), ("tokens_d", "D_porter")):
    QUERIES[_name] = _condition(_key)


@query
def lexical_base(spark, d):
    words = _b(spark, d).select(T.surface(F.col("term")).alias("surface")).distinct()
    return words.select("surface", F.expr(T.lexical_base("surface")).alias("base"))


@query
def porter_vocab(spark, d):
    return stemmed(_b(spark, d).where(F.col("term").rlike("^[a-z]+$")).select(F.col("term").alias("word")))


@query
def porter_demo_rows(spark, d):
    words = [(i, w) for i, w in enumerate("the patients were feeling hopeful about conditional treatments".split())]
    rows = spark.createDataFrame(words, "pos int, term string")
    return rows.join(X.stem_map(rows), "term").select("pos", "term", "stem")


@query
def segments(spark, d):
    return X.segments(_docs(spark, d))


@query
def segment_offsets(spark, d):
    rows = X.segments(_docs(spark, d))
    return rows.select("document_id", "segment_id", "seg_start", (F.col("seg_start") + F.length("text")).alias("seg_end"))


@query
def segment_stats(spark, d):
    t = F.col("text")
    return X.segments(_docs(spark, d)).select("document_id", "segment_id", F.length(t).alias("characters"), F.length(F.replace(t, F.lit(" "), F.lit(""))).alias("characters_without_spaces"), F.size(F.split(t, " ")).alias("words"), F.size(T.sentence_list(t)).alias("sentences"))


@query
def doc_stats(spark, d):
    return segment_stats(spark, d).groupBy("document_id").agg(F.count("*").alias("segments"), F.sum("characters").alias("characters"), F.sum("characters_without_spaces").alias("characters_without_spaces"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"))


@query
def sentences(spark, d):
    return X.sentences(X.segments(_docs(spark, d))).select("document_id", "segment_id", "sentence_index", "text")


@query
def sentence_positions(spark, d):
    return X.sentences(X.segments(_docs(spark, d))).drop("text")


@query
def prose_sections(spark, d):
    rows = spark.read.parquet(f"{d}/processed_document.parquet").distinct().where(F.col("text").isNotNull())
    # Labels of sections that are no prose. "clinical trial registration" and "trial registration number" hold one of them.
    markers = ["trial registration", "registration number", "registry number", "prospero"]
    label = F.lower(F.coalesce(F.nullif("label", F.lit("")), "nlm_category", F.lit("")))
    return rows.select("document_id", "segment_id", (~label.rlike("|".join(markers))).alias("counted"))


@query
def pattern_audit(spark, d):
    return audit.representations(_docs(spark, d))


@query
def pattern_coverage(spark, d):
    return audit.coverage(_docs(spark, d))


@query
def unmatched_preview(spark, d):
    return audit.unmatched_preview(_docs(spark, d))


@query
def highlight(spark, d):
    return _docs(spark, d).select("document_id", R.highlighted(F.col("text"), "adults").alias("marked"))


# --- positions and index --------------------------------------------------------------------------------------------


def _index(spark, d):
    return I.of_folder(spark, d)


def _tokens(spark, d):
    return _index(spark, d).tokens


@query
def word_positions(spark, d):
    return _tokens(spark, d).select("document_id", "segment_id", "word_index", "global_word_index", "text", "char_start", "char_end", "g_start", "g_end")


@query
def word_sentence(spark, d):
    return _tokens(spark, d).select("document_id", "segment_id", "word_index", "sentence_index")


@query
def postings(spark, d):
    return _tokens(spark, d).select("term", "document_id", "segment_id", "word_index", "g_start", "g_end")


@query
def inverted_index(spark, d):
    return _index(spark, d).terms.groupBy("term").agg(F.max("df").alias("document_frequency"), F.max("cf").alias("total_frequency"))


@query
def posting_lists(spark, d):
    rows = I.posting_lists(_index(spark, d))
    return rows.select("term", "document_id", "frequency", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query
def lookup_term(spark, d):
    return I.lookup(_index(spark, d), WORD).select("document_id", "segment_id", "word_index", "g_start")


@query
def validate_index(spark, d):
    index = _index(spark, d)
    words = index.segments.agg(F.sum(F.size(T.term_list(F.col("text")))).alias("words"))
    posts = index.terms.agg(F.sum("cf").alias("postings"))
    # Two rows of one number each.
    one = words.select("words", F.lit(None).cast("bigint").alias("postings")).unionByName(posts.select(F.lit(None).cast("bigint").alias("words"), "postings"))
    return one.agg(F.max("words").alias("words"), F.max("postings").alias("postings")).select("words", "postings", (F.col("words") == F.col("postings")).alias("equal"))


@query
def validate_positions(spark, d):
    """Words and sentences that are not found where their positions say, in the segment and in the whole text; none is right."""
    index = _index(spark, d)
    segs = index.segments.select("document_id", "segment_id", F.col("text").alias("segment"), "seg_start")
    words = index.tokens.select("document_id", "segment_id", F.col("text").alias("token"), "char_start", "char_end", "g_start", "g_end")
    sents = index.sentences.select("document_id", "segment_id", F.col("text").alias("token"), "char_start", "char_end", "g_start", "g_end")
    met = words.unionByName(sents).join(segs, ["document_id", "segment_id"])
    own = F.expr("substring(segment, cast(char_start AS int) + 1, cast(char_end - char_start AS int)) <> token")
    shifted = (F.col("g_start") != F.col("seg_start") + F.col("char_start")) | (F.col("g_end") != F.col("seg_start") + F.col("char_end"))
    return met.where(own | shifted).select("document_id", "segment_id", "token")


@query
def index_summary(spark, d):
    index = _index(spark, d)
    terms = index.terms.agg(F.countDistinct("term").alias("unique_terms"), F.sum("cf").alias("total_terms"))
    docs = index.tokens.agg(F.countDistinct("document_id").alias("documents")).first()["documents"]
    return terms.select(F.lit(docs).alias("documents"), "unique_terms", "total_terms", F.round(F.col("total_terms") / F.lit(docs), 6).alias("average_terms"))


@query
def corpus_hash(spark, d):
    return artifacts.corpus_hash(_docs(spark, d), "document_id", F.col("text"))


# --- statistics -------------------------------------------------------------------------------------------------------


@query
def zipf_table(spark, d):
    return S.zipf_table(_b(spark, d)).select("rank", "term", "frequency", F.round("probability", 12).alias("probability"), "rank_frequency", F.round("log_rank", 9).alias("log_rank"), F.round("log_frequency", 9).alias("log_frequency"))


@query
def zipf_regression(spark, d):
    return S.fitted(S.zipf_table(_b(spark, d)), "condition")


@query
def zipf_by_condition(spark, d):
    return S.fitted(S.zipf_table(_stats(spark, d)), "condition")


@query
def zipf_regions(spark, d):
    return S.fitted(S.regions(S.zipf_table(_b(spark, d))), "condition", "region")


@query
def region_compare(spark, d):
    return S.fitted(S.regions(S.zipf_table(_stats(spark, d))), "condition", "region").select("condition", "region", "rank_start", "rank_end", "zipf_exponent", "r_squared", "rmse")


@query
def best_region(spark, d):
    return S.best_region(S.fitted(S.regions(S.zipf_table(_stats(spark, d))), "condition", "region")).select("condition", "region")


@query
def freq_summary(spark, d):
    return S.frequency_summary(_stats(spark, d)).withColumn("singleton_ratio", F.round("singleton_ratio", 9))


@query
def freq_spectrum(spark, d):
    return _b(spark, d).groupBy(F.col("cf").alias("frequency")).agg(F.count("*").alias("terms"))


@query
def condition_summary(spark, d):
    counts = _counts(spark, d)
    terms = _stats(spark, d).groupBy("condition").agg(F.sum("cf").alias("total_tokens"), F.count("*").alias("vocabulary"))
    docs = counts.groupBy("condition").agg(F.countDistinct("document_id").alias("documents"))
    return terms.join(docs, "condition").select("condition", "total_tokens", "vocabulary", "documents", F.round(F.col("total_tokens") / F.col("documents"), 6).alias("average_tokens"))


@query
def cf_df(spark, d):
    return _stats(spark, d)


@query
def doc_token_counts(spark, d):
    return _counts(spark, d).groupBy("condition", "document_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query
def preprocess_compare(spark, d):
    rows = condition_summary(spark, d).select("condition", "total_tokens", "vocabulary")
    w = Window.partitionBy().orderBy("condition")  # over the four conditions
    first, last = F.first("total_tokens").over(w), F.lag("total_tokens").over(w)
    return rows.select("condition", "total_tokens", "vocabulary", (F.col("total_tokens") - first).alias("change_from_a"), (F.col("total_tokens") - last).alias("change_from_previous"))


@query
def porter_corpus(spark, d):
    terms = _b(spark, d).select("term")
    stems = X.stem_map(terms).where(F.col("stem") != "")
    return stems.agg(F.count("*").alias("vocabulary"), F.countDistinct("stem").alias("stemmed_vocabulary")).select("vocabulary", "stemmed_vocabulary", F.round(1 - F.col("stemmed_vocabulary") / F.col("vocabulary"), 6).alias("reduction_ratio"))


@query
def porter_zipf(spark, d):
    counts = X.counted(_docs(spark, d), "B")
    both = counts.withColumn("condition", F.lit("original")).unionByName(X.restemmed(counts).withColumn("condition", F.lit("stemmed")))
    return S.fitted(S.zipf_table(X.term_stats(both)), "condition")


@query
def porter_demo(spark, d):
    counts = _counts(spark, d).where(F.col("condition").isin("C_no_stopwords", "D_porter"))
    sizes = X.term_stats(counts).groupBy("condition").agg(F.sum("cf").alias("tokens"), F.count("*").alias("types"))
    one = sizes.groupBy().pivot("condition", ["C_no_stopwords", "D_porter"]).agg(F.first("tokens").alias("tokens"), F.first("types").alias("types"))
    return one.select(F.col("C_no_stopwords_tokens").alias("tokens_before"), F.col("D_porter_tokens").alias("tokens_after"), F.col("C_no_stopwords_types").alias("types_before"), F.col("D_porter_types").alias("types_after"))


@query
def porter_pairs(spark, d):
    return X.before_and_after_stems(_counts(spark, d).where(F.col("condition") != "D_porter"))


@query
def report_fit(spark, d):
    return S.reported(zipf_by_condition(spark, d)).select("condition", "n", "zipf_exponent", "r_squared", "rmse")


@query
def custom_stopwords(spark, d):
    return X.counted(_docs(spark, d), "C", stopwords=["The", "of", "adults"]).groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))


@query
def ad_summary(spark, d):
    fits = zipf_by_condition(spark, d).select("condition", "zipf_exponent", "r_squared", "rmse")
    return condition_summary(spark, d).join(fits, "condition").select("condition", "total_tokens", "vocabulary", "average_tokens", "zipf_exponent", "r_squared", "rmse")


@query
def top_terms(spark, d):
    order = Window.partitionBy("condition").orderBy(F.desc("cf"), "term")
    return _stats(spark, d).withColumn("rank", F.row_number().over(order)).where("rank <= 50").select("condition", "rank", "term", "cf")


@query
def cf_df_top(spark, d):
    return S.top_terms(_stats(spark, d), 20).select("condition", "rank", "term", "cf", "df")


@query
def idf_top(spark, d):
    n = _n(_docs(spark, d))
    return S.term_rows(S.top_terms(_stats(spark, d), 10), n).select("condition", "rank", "term", "idf")


@query
def idf(spark, d):
    n = _n(_docs(spark, d))
    return _b(spark, d).select("term", F.round(S.idf(F.lit(n), F.col("df")), 9).alias("idf10"), F.round(S.idf(F.lit(n), F.col("df"), 2.0), 9).alias("idf2"))


@query
def term_statistics(spark, d):
    return S.term_rows(_b(spark, d).drop("condition"), _n(_docs(spark, d)))


@query
def term_stats_all(spark, d):
    return S.term_rows(_stats(spark, d), _n(_docs(spark, d)))


@query
def term_lookup(spark, d):
    asked = spark.createDataFrame(list(enumerate(["adults", "obesity", "nosuchterm"])), "pos int, term string")
    rows = asked.join(_b(spark, d).select("term", "cf", "df"), "term", "left").select("pos", "term", F.coalesce("cf", F.lit(0)).alias("cf"), F.coalesce("df", F.lit(0)).alias("df"))
    return S.term_rows(rows, _n(_docs(spark, d)))


@query
def term_across_conditions(spark, d):
    keys = spark.createDataFrame([(c,) for c in X.CONDITIONS], "condition string")
    found = _stats(spark, d).where(F.col("term") == "patients").select("condition", "cf", "df")
    return keys.join(found, "condition", "left").select("condition", F.coalesce("cf", F.lit(0)).alias("cf"), F.coalesce("df", F.lit(0)).alias("df"))


def _tfidf(spark, d, normalised):
    counts = _counts(spark, d).where(F.col("condition") == "B_no_punctuation")
    return S.document_tfidf(counts, _b(spark, d), _n(_docs(spark, d)), normalised)


@query
def doc_tfidf(spark, d):
    return _tfidf(spark, d, False)


@query
def doc_tfidf_norm(spark, d):
    return _tfidf(spark, d, True)


@query
def tfidf_top(spark, d):
    order = Window.partitionBy("document_id").orderBy(F.desc(F.coalesce("tf_idf", F.lit(-1.0))), "term")
    return _tfidf(spark, d, False).withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("document_id", "rank", "term", "tf_idf")


@query
def significant_words(spark, d):
    return S.significant_words(_b(spark, d), _n(_docs(spark, d))).select("significance_rank", "frequency_rank", "term", "cf", "df", "score")


@query
def significant_all(spark, d):
    return S.significant_words(_stats(spark, d), _n(_docs(spark, d))).select("condition", "significance_rank", "frequency_rank", "term", "score")


@query
def significant_window(spark, d):
    n = _n(_docs(spark, d))
    ranked = S.zipf_table(_b(spark, d)).select("rank", "term", "frequency")
    low, high = sorted((300, 100))
    return ranked.where(F.col("rank").between(low, high)).join(_b(spark, d).select("term", "df"), "term").select("rank", "term", "frequency", F.round(S.idf(F.lit(n), F.col("df")), 4).alias("idf"))


@query
def resolving_curve(spark, d):
    return S.resolving_curve(S.zipf_table(_b(spark, d)).select("rank"), 50, 500)


@query
def top50_windows(spark, d):
    return S.zipf_table(_b(spark, d)).where("rank <= 50").select("rank", "term", "frequency", F.floor((F.col("rank") - 1) / 10).alias("window"))


ASKED = [("obesity", []), ("agonists", ["agonist"]), ("adults", []), ("studies", ["study"]), ("liver", []), ("randomised", ["randomized"]), ("weeks", []), ("zzz", ["zzzz", "diabetes"]), ("nosuchterm", [])]
OTHERS = ["obesity", "pressure", "neverseen", "body"]


@query
def representative_terms(spark, d):
    return S.representative_terms(_b(spark, d).select("term", "cf", "df"), ASKED, OTHERS, 12)


def _domains(spark, d):
    docs = _docs(spark, d).where(F.col("source").isin("pubmed_batch", "web_crawl"))
    counts = X.counted(docs, "C")
    return counts.join(docs.select("document_id", F.col("source").alias("domain")), "document_id")


@query
def domain_compare(spark, d):
    measures = ("documents", "tokens", "vocabulary", "average_tokens", "zipf_exponent", "r_squared", "rmse")
    sizes = S.domain_measures(_domains(spark, d))
    long = sizes.select("domain", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select("domain", "x.*")
    return long.groupBy("measure").pivot("domain", ["pubmed_batch", "web_crawl"]).agg(F.first("v"))


@query
def domain_top_terms(spark, d):
    terms = _domains(spark, d).groupBy("domain", "term").agg(F.sum("n").alias("cf"))
    order = Window.partitionBy("domain").orderBy(F.desc("cf"), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


# --- retrieval -----------------------------------------------------------------------------------------------------------


@query
def detect_query_type(spark, d):
    return R.detected_kinds(spark.read.parquet(f"{d}/eval_item.parquet").select("item_id", F.col("answer").alias("text"))).select("item_id", "n_tokens", "query_type")


@query
def search_exact_word(spark, d):
    return R.exact_word(_tokens(spark, d), R.plan_query(WORD))


@query
def search_related_word(spark, d):
    return R.related_word(_tokens(spark, d), R.plan_query(WORD))


@query
def search_exact_phrase(spark, d):
    return R.exact_phrase(_tokens(spark, d), R.plan_query(PHRASE))


@query
def search_related_phrase(spark, d):
    return R.related_phrase(_tokens(spark, d), R.plan_query("weeks of adults", "phrase"))


@query
def search_exact_sentence(spark, d):
    index = _index(spark, d)
    return R.exact_sentence(index.tokens, index.sentences, R.plan_query("Sampling began at 3 a.m.", "sentence"))


@query
def search_approx_sentence(spark, d):
    return R.approximate_sentence(_tokens(spark, d), R.plan_query(APPROXIMATE, "sentence"))


@query
def search_literal(spark, d):
    index = _index(spark, d)
    return R.literal(index.segments, R.plan_query(LITERAL, "literal"), index.tokens)


@query
def search_auto(spark, d):
    index = _index(spark, d)
    exact, _ = R.search(index.segments, index.sentences, index.tokens, R.plan_query(AUTO))
    return exact.select("document_id", "segment_id", "match_method", "word_position", "char_start", "char_end")


def _phrase_hits(spark, d, phrase=PHRASE):
    index = _index(spark, d)
    exact, related = R.search(index.segments, index.sentences, index.tokens, R.plan_query(phrase, "phrase"))
    return index.segments, index.sentences, exact, related


def _ranked(spark, d):
    _, _, exact, related = _phrase_hits(spark, d)
    return R.results(exact, related)


@query
def unique_hits(spark, d):
    _, _, exact, related = _phrase_hits(spark, d)
    return R.unique_hits(exact.unionByName(exact).unionByName(related)).select("document_id", "segment_id", "match_method", "char_start", "char_end")


@query
def anti_overlap(spark, d):
    _, _, exact, related = _phrase_hits(spark, d, OVERLAPPING)
    return R.without_overlaps(related, exact).select("document_id", "segment_id", "match_method", "similarity", "char_start", "char_end")


@query
def ranked_hits(spark, d):
    return _ranked(spark, d).select("result_rank", "document_id", "match_type", "char_start", "char_end")


@query
def hit_context(spark, d):
    segs, sents, exact, _ = _phrase_hits(spark, d)
    return R.with_context(exact, sents, segs).select("document_id", "char_start", "matched_text", "context")


@query
def search_results(spark, d):
    found = R.run_search(_index(spark, d), PHRASE, "phrase")
    return found.hits.select("result_rank", "document_id", "match_type", "similarity", "char_start", "char_end", "context")


@query
def hit_metadata(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("filename"), "title", "journal", "doc_type")
    _, _, exact, _ = _phrase_hits(spark, d)
    return R.with_metadata(exact.select("document_id", "char_start"), docs, "filename").select("document_id", "char_start", "title", "journal", "doc_type")


@query
def last_page(spark, d):
    """A page number behind the last gives the last page."""
    return R.page(R.document_results(_ranked(spark, d)), 10_000).select("document_rank", "document_id", "total_count")


@query
def doc_results(spark, d):
    return R.document_results(_ranked(spark, d))


@query
def search_summary(spark, d):
    return R.summary(_ranked(spark, d))


@query
def results_page(spark, d):
    return R.page(R.document_results(_ranked(spark, d)), 2).select("document_rank", "document_id", "total_count")


# --- expansion -----------------------------------------------------------------------------------------------------------


def _vocabulary(spark, d):
    return E.vocabulary(_b(spark, d).select("term", "cf"))


def _asked(spark):
    return spark.createDataFrame(list(enumerate(MISSPELT.split())), "pos int, token string")


@query
def spell_vocab(spark, d):
    return _vocabulary(spark, d)


@query
def edit_distance(spark, d):
    return _vocabulary(spark, d).select("surface", F.levenshtein("surface", F.lit("patient")).alias("distance"))


@query
def edit_matrix(spark, d):
    return spark.createDataFrame([("cancer", "caner", E.edit_matrix("cancer", "caner"))], "source string, target string, matrix array<array<int>>")


@query
def spell_candidates(spark, d):
    return E.spelling_candidates(_asked(spark), _vocabulary(spark, d))


@query
def spell_correct(spark, d):
    return E.corrected(_asked(spark), _vocabulary(spark, d)).select("pos", "token", "known", "corrected")


@query
def spell_rows(spark, d):
    return E.corrected(_asked(spark), _vocabulary(spark, d)).select("token", F.col("corrected").alias("suggestion"), F.coalesce("distance", F.lit(0)).alias("distance"))


@query
def spell_query(spark, d):
    return E.joined_query(E.corrected(_asked(spark), _vocabulary(spark, d)))


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _vector_queries(spark, d):
    return _vectors(spark, d).where(F.col("id") % EVERY == 0)


@query
def vec_most_similar(spark, d):
    return E.neighbours(_vectors(spark, d), _vector_queries(spark, d), 10)


@query
def vec_similarity(spark, d):
    return E.similarities(_vectors(spark, d), _vector_queries(spark, d))


@query
def expand_word(spark, d):
    return E.neighbours(_vectors(spark, d), _vector_queries(spark, d), 5, 0.3)


@query
def expand_query(spark, d):
    q = _vector_queries(spark, d)
    return E.expanded(E.neighbours(_vectors(spark, d), q, 3, 0.1), q)


@query
def pca_neighbors(spark, d):
    return E.pca_maps(_vectors(spark, d), _vector_queries(spark, d), 11)


@query
def w2v_sentences(spark, d):
    return E.sentence_words(_tokens(spark, d)).select("document_id", "segment_id", "sentence_index", F.array_join("words", " ").alias("words"))


@query
def w2v_train(spark, d):
    vectors = trained(E.words_by_sentence(_docs(spark, d)), size=100, window=5, least=2, epochs=20, partitions=8)
    return vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))


# --- sources -----------------------------------------------------------------------------------------------------------------


def _records(spark, d):
    rows = spark.read.parquet(f"{d}/structured_document.parquet").distinct()
    return rows.select(F.concat_ws("#", "filename", F.lpad(F.col("record_id").cast("string"), 12, "0")).alias("name"), "pmid", F.array_join("abstract_paragraphs_clean", "\n").alias("abstract"), "language")


@query
def corpus_audit(spark, d):
    return audit.audit(audit.decided(_records(spark, d)))


@query
def corpus_accept(spark, d):
    return audit.accepted(audit.decided(_records(spark, d)), 100).select("name", "pmid")


@query
def extract_ids(spark, d):
    """Ids out of texts as lists of records hold them."""
    rows = spark.read.parquet(f"{d}/structured_document.parquet").select("record_id", "pmid", "title").distinct()
    text = F.concat_ws("\n", F.concat(F.lit("PMID= "), F.col("pmid")), F.col("title"), F.concat(F.lit(" "), F.col("pmid"), F.lit(",")))
    return ids.ids_in_text(rows.select("record_id", text.alias("text")), "record_id", "text")


@query
def batch_ids(spark, d):
    rows = spark.read.parquet(f"{d}/structured_document.parquet").select("pmid", "record_id").where(F.col("pmid").isNotNull())
    return ids.batches(ids.normalised(rows, "pmid", "record_id"), 100)


@query
def missing_ids(spark, d):
    asked = spark.read.parquet(f"{d}/structured_document.parquet").select(F.regexp_replace("pmid", "[^0-9]", "").alias("id")).where("id <> ''").distinct()
    got = spark.read.parquet(f"{d}/processed_document.parquet").select(F.regexp_replace("document_id", "[^0-9]", "").alias("id")).distinct()
    return ids.missing(asked, got)


def _files(spark, d):
    """Each record of the structured table written as a file in its source format; articles whose scope is not known as markup of no format."""
    rows = spark.read.parquet(f"{d}/structured_document.parquet").distinct().where(F.size("abstract_paragraphs_clean") > 0)

    def safe(c):
        return F.replace(F.replace(F.replace(F.regexp_replace(c, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def each(before: str, after: str):
        kept = F.filter("abstract_paragraphs_clean", lambda p: p.isNotNull())
        return F.array_join(F.transform(kept, lambda p: F.concat(F.lit(before), safe(p), F.lit(after))), "")

    def joined(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    pmid, title = safe(F.coalesce("pmid", F.lit(""))), safe(F.coalesce("title", F.lit("")))
    jats = joined("<article><front><article-meta><article-id pub-id-type='pmid'>", pmid, "</article-id><title-group><article-title>", title, "</article-title></title-group><abstract>", each("<p>", "</p>"), "</abstract></article-meta></front></article>")
    pubmed = joined("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>", pmid, "</PMID><Article><ArticleTitle>", title, "</ArticleTitle><Abstract>", each("<AbstractText>", "</AbstractText>"), "</Abstract></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>")
    bioc = joined("<collection><document><passage><infon key='type'>title</infon><text>", title, "</text></passage>", each("<passage><infon key='section_type'>ABSTRACT</infon><text>", "</text></passage>"), "</document></collection>")
    plain = joined("<record><title>", title, "</title>", each("<p>", "</p>"), "</record>")
    unknown = (F.col("source_format") == "JATS") & F.col("search_scope").isNull()
    xml = F.when(unknown, plain).when(F.col("source_format") == "PubMed", pubmed).when(F.col("source_format") == "BioC", bioc).otherwise(jats)
    return rows.select(F.concat(F.col("record_id").cast("string"), F.lit(".xml")).alias("path"), F.encode(xml, "UTF-8").alias("content"))


def _parsed(spark, d):
    return markup.documents_of(_files(spark, d))


@query
def parse_detect(spark, d):
    return _parsed(spark, d).groupBy("source_format").agg(F.count("*").alias("files"))


@query
def parse_sections(spark, d):
    return _parsed(spark, d).where("error IS NULL").groupBy("source_format", F.size("abstract_sections").alias("sections")).agg(F.count("*").alias("files"))


@query
def parse_pages(spark, d):
    return _parsed(spark, d).select("filename", "source_format", "title", F.size("abstract_sections").alias("sections"), "error")


def _scoped(spark, d):
    return _parsed(spark, d).where("error IS NULL").withColumn("document_id", P.document_id())


@query
def search_segments(spark, d):
    return P.search_segments(_scoped(spark, d)).groupBy("field").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("characters"))


@query
def statistics_segments(spark, d):
    return P.statistics_segments(_scoped(spark, d)).groupBy("field", "counted").agg(F.count("*").alias("segments"))


@query
def document_statistics(spark, d):
    return P.document_statistics(_scoped(spark, d))
