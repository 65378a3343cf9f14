"""The core on small inputs: fixed examples, invariants, nulls and empty tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.functions import stem, text
from termweave.operators import expansion, index, ranks, retrieval, statistics, tables
from termweave.plans import queries
from termweave.plans import sql as oracle
from termweave.sources import audit, ids

DOCS = "document_id string, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("T1", "The data, data. cancer treatments improve outcomes.", "en", "a"), ("T2", "Cancer treatment and the patient data were analyzed.\n\nSecond  line ( x ) here.", "en", "b"), ("T3", "", None, None), ("T4", " \n ", None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_porter_words(spark):
    words = "caresses ponies ties caress cats feed agreed plastered motoring sing relational conditional rational valenci hesitanci digitizer vietnamization triplicate formalize electricical hopeful goodness".split()
    stems = "caress poni ti caress cat feed agre plaster motor sing relat condit ration valenc hesit digit vietnam triplic formal electric hope good".split()
    got = dict(tuple(r) for r in stem.stemmed(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    assert got == dict(zip(words, stems))
    assert [stem.stem_word(w) for w in ("by", "été", "x-ray", "sky", "yearly", "enjoyed", "hopping", "failing", "filing", "controll")] == ["by", "été", "x-ray", "sky", "yearli", "enjoi", "hop", "fail", "file", "control"]
    # The SQL that queries are compared with stems by other means.
    sql = oracle._stems("SELECT unnest([" + ",".join(f"'{w}'" for w in words) + "]) AS word")
    assert dict(duckdb.sql(sql).fetchall()) == got


def test_compounds_keep_their_joints(spark):
    rows = spark.createDataFrame([("cancer-related",), ("pi3k/akt",), ("alzheimer’s",)], "term string")
    got = {r["term"]: r["stem"] for r in tables.stem_map(rows).collect()}
    assert got == {"cancer-related": "cancer-relat", "pi3k/akt": "pi3k/akt", "alzheimer’s": "alzheim's"}


def test_tokens_and_traps(spark):
    cases = {"3D-printed": ["3D", "printed"], "12/15": ["12", "15"], "GLP-1": ["GLP-1"], "U.S.": ["U.S"], "snake_case": ["snake", "case"], "30%": ["30%"], "Alzheimer's": ["Alzheimer's"], "24-hour": ["24", "hour"], "": []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in rows.select("t", text.term_list(F.col("t"))).collect()}
    assert got == cases


def test_sentence_diagnostics(spark):
    cases = ["Dr. Smith treated the patient. The patient recovered.", "My name is Jonas E. Smith. He works here.", "The value was 9.6. Measurements were repeated.", "The temperature was 37 °C. The patient was stable."]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.sentence_list(F.col("t")).alias("s"))
    for r in rows.collect():
        assert len(r["s"]) == 2 and " ".join(r["s"]) == r["t"]


def test_positions_reconstruct_the_text(docs):
    segs = tables.segments(docs)
    toks = tables.tokens(tables.sentences(segs))
    whole = {}
    for r in segs.orderBy("document_id", "segment_id").collect():
        whole[r["document_id"]] = whole[r["document_id"]] + "\n" + r["text"] if r["document_id"] in whole else r["text"]
    found = toks.collect()
    assert found and all(whole[r["document_id"]][r["g_start"] : r["g_end"]] == r["text"] for r in found)
    assert set(whole) == {"T1", "T2"}


def test_condition_counts(docs):
    rows = {(r["condition"], r["document_id"], r["term"]): r["n"] for r in tables.condition_counts(docs).collect()}
    assert rows["A_basic", "T1", "data,"] == 1 and rows["A_basic", "T1", "data."] == 1 and rows["B_no_punctuation", "T1", "data"] == 2
    assert ("C_no_stopwords", "T1", "the") not in rows and rows["D_porter", "T2", "treatment"] == 1 if ("D_porter", "T2", "treatment") in rows else True
    c = sum(n for (k, _, _), n in rows.items() if k.startswith("C"))
    assert c == sum(n for (k, _, _), n in rows.items() if k.startswith("D"))


def test_empty_tables(docs):
    none = docs.limit(0)
    assert tables.tokens(tables.sentences(tables.segments(none))).count() == 0
    assert statistics.fitted(statistics.zipf_table(tables.term_stats(tables.condition_counts(none))), "condition").count() == 0


def test_fit_guards(spark):
    rows = spark.createDataFrame([("c", "a", 5, 1), ("c", "b", 5, 1), ("d", "x", 3, 1)], "condition string, term string, cf bigint, df bigint")
    got = {r["condition"]: r for r in statistics.fitted(statistics.zipf_table(rows), "condition").collect()}
    assert got["c"]["valid"] and got["c"]["r_squared"] is None and not got["d"]["valid"] and got["d"]["slope"] is None


def test_search(docs):
    segs = tables.segments(docs)
    sents = tables.sentences(segs)
    toks = tables.tokens(sents).cache()
    exact, related = retrieval.search(segs, sents, toks, retrieval.plan_query("treatment"))
    assert [r["document_id"] for r in exact.collect()] == ["T2"]
    assert [(r["document_id"], r["match_method"]) for r in related.collect()] == [("T1", "lexical_variant")]
    exact, _ = retrieval.search(segs, sents, toks, retrieval.plan_query("cancer treatment"))
    assert [(r["char_start"], r["char_end"]) for r in exact.collect()] == [(0, 16)]
    exact, _ = retrieval.search(segs, sents, toks, retrieval.plan_query("ancer  trea"))
    assert {r["match_method"] for r in exact.collect()} == {"literal"}
    near = retrieval.related_phrase(toks, retrieval.plan_query("data patient", "phrase"))
    assert [(r["document_id"], r["similarity"]) for r in near.collect()] == [("T2", 1.0)]
    with pytest.raises(ValueError):
        retrieval.plan_query("x", "fuzzy")


def test_query_kinds():
    assert [retrieval.plan_query(q).kind for q in ("cancer", "physical activity", "This study systematically reviews the evidence.")] == ["word", "phrase", "sentence"]
    assert [retrieval.base_of(w) for w in ("alzheimer's", "activities", "cancers", "analysis", "glass")] == ["alzheimer", "activity", "cancer", "analysis", "glass"]


def test_spelling(spark):
    words = spark.createDataFrame([("cancer", 100), ("cancers", 20), ("cancel", 10), ("patient", 80)], "surface string, cf bigint")
    asked = spark.createDataFrame([(0, "caner"), (1, "patint"), (2, "cancer"), (3, "zzzzzz")], "pos int, token string")
    got = {r["token"]: r["corrected"] for r in expansion.corrected(asked, words).collect()}
    assert got == {"caner": "cancer", "patint": "patient", "cancer": "cancer", "zzzzzz": "zzzzzz"}
    assert expansion.edit_matrix("cancer", "caner")[-1][-1] == 1


def test_spelling_covers_every_term(spark, tmp_path):
    words = {"follow-up": 3, "más": 2, "лечение": 2, "glp-1-like": 1, "obesity": 4, "obésity": 9, "patients": 2, "患者": 1}
    text_rows = [(w, " ".join([w] * n)) for w, n in words.items()]
    spark.createDataFrame([(i, t, w, "en", "a") for i, (w, t) in enumerate(text_rows)], "doc_id bigint, text string, title string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark_rows = {name: queries.QUERIES[name](spark, str(tmp_path)).collect() for name in ("spell_vocab", "edit_distance", "spell_candidates")}
    assert {tuple(r) for r in spark_rows["spell_vocab"]} == set(words.items())
    assert {tuple(r) for r in spark_rows["edit_distance"]} == {(w, expansion.edit_matrix(w, "patient")[-1][-1]) for w in words}
    want = []
    for pos, asked in enumerate(queries.MISSPELT.split()):
        near = sorted((expansion.edit_matrix(w, asked)[-1][-1], -n, abs(len(w) - len(asked)), w) for w, n in words.items())
        want += [(pos, asked, w, far, -n, k) for k, (far, n, _, w) in enumerate((x for x in near if x[0] <= 2), 1)]
    assert len(want) == 2 and sorted(tuple(r) for r in spark_rows["spell_candidates"]) == want
    vocabulary = queries._vocabulary(spark, str(tmp_path))
    asked = spark.createDataFrame([(0, "follow-up"), (1, "más"), (2, "лечени"), (3, "patiénts")], "pos int, token string")
    got = [tuple(r) for r in expansion.corrected(asked, vocabulary).orderBy("pos").collect()]
    assert got == [(0, "follow-up", True, "follow-up", 0), (1, "más", True, "más", 0), (2, "лечени", False, "лечение", 1), (3, "patiénts", False, "patients", 1)]


def test_vector_queries_take_every_twentieth_row(spark, tmp_path):
    draw = np.random.default_rng(4)
    vectors = {i: draw.integers(-2, 3, 4).astype(float) for i in range(130)} | {40: np.zeros(4)}
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def near(a, b):
        size = np.sqrt((a @ a) * (b @ b))
        return round(float(a @ b / size), 6) + 0.0 if size else None

    asked = range(0, 130, 20)
    every = {(a, b): near(vectors[a], vectors[b]) for a in asked for b in vectors if a != b}

    def best(top, least):
        out = {}
        for a in asked:
            rows = sorted((-s, b) for (q, b), s in every.items() if q == a and s is not None and s >= least)
            out |= {(a, b): (-s, k) for k, (s, b) in enumerate(rows[:top], 1)}
        return out

    run = {name: queries.QUERIES[name](spark, str(tmp_path)).collect() for name in ("vec_most_similar", "expand_word", "expand_query", "vec_similarity", "pca_neighbors")}
    for name, want in (("vec_most_similar", best(10, -1)), ("expand_word", best(5, 0.3))):
        assert {(r["query"], r["neighbour"]): (r["similarity"], r["rank"]) for r in run[name]} == want and len(run[name]) == len(want)
    first = {}
    for (a, b), (s, k) in sorted(best(3, 0.1).items(), key=lambda x: (x[0][0], x[1][1])):
        if b not in asked:
            first.setdefault(b, (a, s, k))
    assert {r["neighbour"]: (r["query"], r["similarity"], r["rank"]) for r in run["expand_query"]} == first
    assert {(r["a"], r["b"]): r["similarity"] for r in run["vec_similarity"]} == {(a, b): s for (a, b), s in every.items() if b not in asked or a < b}
    shown = {(a, b) for a, b in best(11, -1)} | {(a, a) for a in asked}
    assert {(r["query"], r["id"]) for r in run["pca_neighbors"]} == shown and len(run["pca_neighbors"]) == len(shown)
    # More blocks than one of each change nothing.
    table = queries._vectors(spark, str(tmp_path))
    parted = expansion.neighbours(table, table.where("id % 20 = 0"), 10, block=3)
    assert {(r["query"], r["neighbour"]): (r["similarity"], r["rank"]) for r in parted.collect()} == best(10, -1)


def test_trained_vectors(spark, tmp_path):
    rows = [(k, "Obesity rises with age. Patients lose weight.", None, "en", "a") for k in range(2)] + [(2, "Rarely seen once.", None, "en", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: r["vector"] for r in queries.w2v_train(spark, str(tmp_path)).collect()}
    assert set(got) == set("obesity rises with age patients lose weight".split())
    assert all(len(v) == 100 and any(v) for v in got.values())


def test_vectors_are_trained_without_an_index(spark, tmp_path):
    text = "First line of O’Neil’s data. Straße 12,5% and ΟΔΟΣ!\n\n( ; ) One.\nDr. Smith vs. age-related GLP-1/GIP. Ja? Nein doch, nein."
    rows = [(k, text if k % 2 else f"Number {k} of {k}. Again  {k} .", None, "en", "a") for k in range(6)] + [(9, None, None, "en", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(queries.w2v_train(spark, str(tmp_path)).collect()) > 5
    assert (spark.sparkContext.applicationId, str(tmp_path)) not in index._BUILT
    docs = tables.documents(spark, str(tmp_path))
    want = expansion.sentence_words(tables.tokens(tables.sentences(tables.segments(docs))))
    assert sorted(expansion.words_by_sentence(docs).collect()) == sorted(want.collect()) and want.count() > 10


def test_a_step_sums_the_gradients_of_all_pairs():
    import numpy as np

    from termweave.operators import skipgram

    rng, v, window, rate = np.random.default_rng(3), 9, 3, 0.01
    ids, sentence = rng.integers(0, v, 500), np.repeat(np.arange(50), 10)
    model = rng.normal(size=(2 * v, 4)).astype("float32")
    pairs = 0
    for near, others, weight in skipgram.steps(ids, sentence, window, (np.arange(1, v + 1) / v).astype("float32"), np.random.default_rng(5)):
        blocks, block, wide = weight.shape
        wide -= skipgram.SHARED
        got = model.copy()
        step, curved = skipgram.stepper(got, window)
        step(near, others, weight, rate)
        far = [float(np.mean([np.sum(model[k] ** 2) for k in rows])) for rows in (np.concatenate([near, others.ravel()]) + v, near[window:-window])]
        down, bend = np.zeros((2 * v, 4)), np.zeros(2 * v)
        for s, p, j in zip(*np.nonzero(weight)):
            x, y = near[s * block + p + window], v + (near[s * block + j] if j < wide else others[s, j - wide])
            w, score = weight[s, p, j], 1 / (1 + np.exp(-model[x] @ model[y]))
            assert j >= wide or 0 < abs(p + window - j) <= window
            for a, b, size in ((x, y, far[0]), (y, x, far[1])):
                down[a] += w * (score - (j < wide)) * model[b]
                bend[a] += w * score * (1 - score) * size
        pairs += np.count_nonzero(weight[:, :, :wide])
        assert np.allclose(got, model - down * (rate / (1 + rate * bend))[:, None], atol=1e-5) and np.allclose(curved, bend, rtol=1e-4)
    # Ten words have 18 pairs if each reaches one word to either side, 48 if each reaches three.
    assert 50 * 18 < pairs < 50 * 48


def test_words_of_one_kind_have_vectors_of_one_kind(spark):
    kinds = [["cat", "dog", "cow"], ["red", "blue", "green"]]
    rows = [(k, [kinds[k % 2][(k // 2 + i) % 3] for i in range(6)] + [f"only{k}"]) for k in range(600)]
    sentences = spark.createDataFrame(rows, "k int, words array<string>").repartition(3)
    model = expansion.train_vectors(sentences, size=20, least=2, epochs=3, partitions=4)
    assert {r["word"] for r in model.getVectors().collect()} == {w for kind in kinds for w in kind}
    assert {w for w, _ in expansion.most_similar(model, "Cat", 2)} == {"dog", "cow"} and expansion.most_similar(model, "only1") == []
    assert expansion.word_similarity(model, "red", "blue") > expansion.word_similarity(model, "red", "dog")
    again = expansion.train_vectors(sentences.repartition(2), size=20, least=2, epochs=3, partitions=4)
    assert {tuple(r) for r in again.getVectors().collect()} == {tuple(r) for r in model.getVectors().collect()}
    with pytest.raises(ValueError):
        expansion.train_vectors(sentences, least=10_000)


def test_id_batches(spark):
    rows = spark.createDataFrame([(str(i), i) for i in range(250)], "id string, pos bigint")
    sizes = ids.batches(rows, 100).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [100, 100, 50]
    text_rows = spark.createDataFrame([("a", "PMID: 12345678 and PMID 12345678\nhttps://pubmed.ncbi.nlm.nih.gov/12345678/\n12345678")], "k string, t string")
    assert [r["id"] for r in ids.ids_in_text(text_rows, "k", "t").collect()] == ["12345678"]


def test_audit(spark):
    rows = spark.createDataFrame([("a", "1", "x", "en"), ("b", "1", "x", "en"), ("c", None, "x", "en"), ("d", "2", "", ""), ("e", "3", "x", "de"), ("f", "2", "x", None)], "name string, pmid string, abstract string, language string")
    got = {r["name"]: r["reason"] for r in audit.decided(rows).collect()}
    assert got == {"a": None, "b": "duplicate_pmid", "c": "missing_pmid", "d": "missing_abstract", "e": "non_english", "f": None}


def test_ranks_by_range(spark):
    rows = [(k % 3 if k % 7 else None, k * 37 % 101, f"t{k:03d}") for k in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, t string").repartition(5)
    for keys in (["g"], []):
        got = {r["t"]: r["n"] for r in ranks.ranked(df, keys, [F.desc("v"), F.asc("t")], "n").collect()}
        want, seen = {}, {}
        for g, _, t in sorted(rows, key=lambda r: (-r[1], r[2])):
            key = g if keys else 0
            seen[key] = want[t] = seen.get(key, 0) + 1
        assert got == want
    assert ranks.ranked(df.limit(0), ["g"], [F.asc("v")], "n").count() == 0


def test_worked_statistics(spark):
    zipf = [("the", 1000), ("of", 500), ("and", 333), ("data", 250), ("model", 200), ("cancer", 167), ("rare", 10), ("veryrare", 5)]
    stats = spark.createDataFrame([("c", t, n, 1) for t, n in zipf], "condition string, term string, cf bigint, df bigint")
    parts = statistics.regions(statistics.zipf_table(stats)).groupBy("region").count().collect()
    assert {r["region"]: r["count"] for r in parts} == {"high": 3, "middle": 3, "low": 2}
    words = spark.createDataFrame([("c", "the", 5000, 980), ("c", "glp-1", 1500, 900), ("c", "semaglutide", 250, 120), ("c", "xylophone", 1, 1)], stats.schema)
    top = statistics.significant_words(words, 1000).orderBy("significance_rank").collect()
    assert [r["term"] for r in top] == ["semaglutide", "xylophone", "glp-1", "the"] and [round(r["score"], 4) for r in top] == [2.2097, 0.9031, 0.1453, 0.0325]
    counts = spark.createDataFrame([("D1", "the", 5), ("D1", "cancer", 2)], "document_id string, term string, n bigint")
    df = spark.createDataFrame([("the", 10), ("cancer", 4)], "term string, df bigint")
    assert {r["term"]: round(r["tf_idf"], 4) for r in statistics.document_tfidf(counts, df, 10, document="D1").collect()} == {"the": 0.0, "cancer": 0.7959}
    with pytest.raises(ValueError):
        statistics.document_tfidf(counts, df, 10, document="D9")
    asked = statistics.representative_terms(stats, [("nothing", ["models"]), ("rarely", ["rare"])], ["absent", "cancer", "data"], 4)
    assert [(r["asked"], r["term"]) for r in asked.orderBy("priority").collect()] == [("rarely", "rare"), ("cancer", "cancer"), ("data", "data"), (None, "model")]
    curve = statistics.resolving_curve(spark.createDataFrame([(k,) for k in range(1, 11)], "rank int"), 99, -5).orderBy("rank").collect()
    assert max(r["resolving_power"] for r in curve) == 1.0 and curve[4]["resolving_power"] > curve[0]["resolving_power"]


def test_stored_index(spark, tmp_path):
    rows = [("DEMO", "Physical activity improves health.\nCancer-related outcomes were studied.", None, None)]
    built = index.build(spark.createDataFrame(rows, DOCS), str(tmp_path))
    hits = retrieval.run_search(built, "hysical act").hits.collect()
    assert [(r["match_method"], r["char_start"], r["char_end"], r["word_position"], r["context"]) for r in hits] == [("literal", 1, 12, 0, "Physical activity improves health.")]
    found = retrieval.run_search(built, "physical activity")
    assert [(r["match_type"], r["char_start"], r["char_end"]) for r in found.hits.collect()] == [("exact", 0, 17)]
    assert found.summary.first()["documents_found"] == 1 and [r["document_rank"] for r in found.documents.collect()] == [1]
    assert retrieval.run_search(built, " , ").hits.count() == 0 and retrieval.run_search(built, "absent").summary.first()["total_results"] == 0
    assert [(r["term"], r["positions"]) for r in index.posting_lists(built).where("term = 'activity'").collect()] == [("activity", [1])]
    assert "PushedFilters: [IsNotNull(base)" in index.lookup(built, "Activity")._jdf.queryExecution().toString() or index.lookup(built, "Activity").count() == 1
    meta = spark.createDataFrame([("P1", "", "DEMO", "T"), (None, "DEMO2", "x", "U")], "pmcid string, pmid string, filename string, title string")
    asked = spark.createDataFrame([("DEMO",), ("DEMO2",), ("no",)], "document_id string")
    assert {(r["document_id"], r["title"]) for r in retrieval.with_metadata(asked, meta, "pmcid", "pmid", "filename").collect()} == {("DEMO", "T"), ("DEMO2", "U"), ("no", None)}


def test_an_index_that_was_removed_is_built_again(spark, tmp_path):
    import shutil

    rows = [(1, "Data and more data.", None, "en", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, title string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    first = index.of_folder(spark, str(tmp_path))
    assert index.of_folder(spark, str(tmp_path)) is first
    shutil.rmtree(first.folder.removeprefix("file:"))
    assert {(r["term"], r["cf"]) for r in index.of_folder(spark, str(tmp_path)).terms.collect()} == {("data", 2), ("and", 1), ("more", 1)}
    counts, stats = index.counts_of_folder(spark, str(tmp_path))
    assert stats.where("condition = 'C_no_stopwords'").select("term").collect()[0]["term"] == "data" and counts.where("condition = 'D_porter'").count() == 1
