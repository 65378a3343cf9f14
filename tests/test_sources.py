"""Parsers, ids, fetching, uploads, artifacts, the stream: each on small inputs with a worked-out result."""

import xml.etree.ElementTree as ET

import pytest

from termweave.operators import scopes
from termweave.sources import artifacts, efetch, ids, markup
from termweave.streaming import append


@pytest.mark.parametrize(
    ("xml", "kind"),
    [
        ("<PubmedArticleSet/>", "PubMed"),
        ("<PubmedArticle><MedlineCitation/></PubmedArticle>", "PubMed"),
        ("<PubmedArticle><Other/></PubmedArticle>", "GenericXML"),
        ("<article><front><article-meta/></front></article>", "JATS"),
        ("<x:article xmlns:x='u'><x:front><x:article-meta/></x:front></x:article>", "JATS"),
        ("<set><article><front><article-meta/></front></article></set>", "JATS"),
        ("<article><p>plain</p></article>", "GenericXML"),
        ("<collection><document><passage/></document></collection>", "BioC"),
        ("<document><passage/></document>", "BioC"),
        ("<collection><item/></collection>", "GenericXML"),
    ],
)
def test_format(xml, kind):
    assert markup.detected_format(ET.fromstring(xml)) == kind


@pytest.mark.parametrize(
    ("kind", "section", "titled", "want"),
    [
        ("title", "", False, "title"), ("front", "TITLE", False, "title"), ("title", "", True, "section_title"), ("abstract_title_1", "ABSTRACT", True, "abstract_section_title"), ("abstract", "", True, "abstract"),
        ("author", "", True, "author"), ("author", "reference", True, "reference"), ("aff", "", True, "affiliation"), ("kwd", "", True, "keyword"), ("ref", "REF", True, "reference"), ("refined", "", True, "body"), ("ack", "", True, "acknowledgment"),
        ("fig_caption", "FIG", True, "figure_caption"), ("fig_label", "", True, "figure_label"), ("table", "TABLE", True, "table_text"), ("table_caption", "", True, "table_caption"), ("table_title", "", True, "table_caption"),
        ("title_2", "INTRO", True, "section_title"), ("subtitle", "", False, "section_title"), ("def", "", True, "definition"), ("front", "", True, "front"), ("paragraph", "INTRO", True, "body"), ("odd", "odd", True, "body"),
    ],
)
def test_passages(kind, section, titled, want):
    assert markup.passage_kind(kind, section, titled) == want


def test_which_abstract():
    def meta(*kinds):
        return ET.fromstring("<m>" + "".join(f"<abstract abstract-type='{k}'>{i}</abstract>" if k else f"<abstract>{i}</abstract>" for i, k in enumerate(kinds)) + "</m>")

    main, primary = (lambda *k: getattr(markup.main_abstract(meta(*k)), "text", None)), (lambda *k: getattr(markup.primary_abstract(meta(*k)), "text", None))
    assert main("graphical", "", "web") == "1" and main("plain language summary", "web") == "1" and main("teaser") is None and main("short", "") == "1" and main("toc") == "0"
    assert primary("graphical", "", "web") == "1" and primary("teaser", "") == "0" and primary("short", "toc") == "0" and primary() is None


ARTICLE = """<article article-type='review' xml:lang='en'><front><journal-meta><journal-title-group><journal-title>J</journal-title></journal-title-group></journal-meta><article-meta>
<article-id pub-id-type='pmid'>7</article-id><article-id pub-id-type='pmc'>PMC7</article-id><title-group><article-title>A <i>b</i> c</article-title></title-group>
<contrib-group><contrib><name><surname>Doe</surname><given-names>Jo</given-names></name></contrib></contrib-group><aff><label>1</label>Place</aff><aff>Place</aff><kwd-group><kwd>k</kwd></kwd-group>
<abstract><sec><title>Aim</title><p>One <xref ref-type='bibr'>9</xref>two.</p><sec><title>Deep</title><p>Three.</p></sec></sec></abstract><counts><word-count count='12'/><fig-count count='x'/></counts></article-meta></front>
<body><sec><title>Start</title><p>Body text.<fig><label>F1</label><caption><p>Cap</p></caption></fig></p></sec><def-list><def-item><term>T</term><def><p>D</p></def></def-item></def-list>
<table-wrap><label>T1</label><caption><p>Tc</p></caption><table><tr><td>1</td><th>h</th></tr></table></table-wrap></body><back><ack><title>Thanks</title><p>All.</p></ack><ref-list><ref>R <xref ref-type='bibr'>3</xref></ref></ref-list></back></article>"""
BIOC = """<collection><document><id>123</id><infon key='Journal'>J</infon><passage><infon key='section_type'>TITLE</infon><infon key='type'>front</infon><infon key='name_0'>surname:Doe;given-names:Jo</infon><text>T</text></passage>
<passage><infon key='type'>abstract_title_1</infon><infon key='section_type'>ABSTRACT</infon><text>Aim</text></passage><passage><infon key='section_type'>ABSTRACT</infon><sentence><text>One.</text></sentence><sentence><text>Two.</text></sentence></passage>
<passage><infon key='type'>table</infon><text>&lt;td&gt;1&lt;/td&gt; x</text></passage><passage><infon key='type'>paragraph</infon><text>Body.</text></passage></document></collection>"""
PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='METHODS' NlmCategory='METHODS'>M one. M two.</AbstractText>
<AbstractText Label='TRIAL_REGISTRATION'>N1.</AbstractText><AbstractText Label='UNASSIGNED'>U.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author></AuthorList><ELocationID EIdType='doi'>10.1/x</ELocationID></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID/></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
FILES = [("f/a.xml", ARTICLE), ("b.xml", BIOC), ("c.xml", PUBMED), ("d.xml", "<html><title>H</title><p>x <b>y</b> z</p><script>s</script></html>"), ("e.xml", "<broken"), ("g.xml", "")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(n, bytearray(c.encode())) for n, c in FILES], "path string, content binary")


def test_readers(files):
    rows = {r["filename"]: r for r in markup.documents_of(files).collect()}
    a, b, c = rows["a.xml"], rows["b.xml"], rows["PMID_5.xml"]
    assert (a["title"], a["journal"], a["pmcid"], a["authors"], a["affiliations"], a["language"], a["article_type"]) == ("A b c", "J", "PMC7", ["Jo Doe"], ["Place"], "en", "review")
    assert [(s["label"], s["text"]) for s in a["abstract_sections"]] == [("Aim", "One two."), ("Deep", "Three.")] and a["abstract_section_titles"] == ["Aim", "Deep"]
    assert a["body"] == ["Body text."] and a["section_titles"] == ["Start"] and a["tables"][0]["text"] == "h 1" and a["acknowledgments"] == ["All."] and a["refs"] == ["R 3"] and a["reported"] == {"word-count": "12", "fig-count": "x"}
    assert (b["pmid"], b["journal"], b["authors"], b["title"]) == ("123", "J", ["Jo Doe"], "T") and [tuple(s) for s in b["abstract_sections"]] == [("Aim", "", "One. Two.")] and b["tables"][0]["text"] == "1 x" and b["body"] == ["Body."]
    assert c["doi"] == "10.1/x" and c["authors"] == ["J Doe"] and [s["label"] for s in c["abstract_sections"]] == ["Methods", "Trial Registration", ""] and c["statistics_text"].startswith("Methods: M one.")
    assert rows["c.xml#1"]["error"] and rows["d.xml"]["title"] == "H" and rows["d.xml"]["body"] == ["x y z"] and rows["e.xml"]["error"] and rows["g.xml"]["error"]
    only = {r["filename"]: r for r in markup.documents_of(files, abstracts=True).collect()}["a.xml"]
    assert only["search_scope"] == "abstract_only" and only["body"] == [] and [(s["label"], s["text"]) for s in only["abstract_sections"]] == [("Aim", "One two."), ("Aim", "Three.")] and only["statistics_text"] == "One two. Three."
    assert markup.parsed(b"<article><front/></article>", "x.xml", True)[0]["source_format"] == "GenericXML"


def test_scopes(files):
    docs = markup.documents_of(files).where("error IS NULL").withColumn("document_id", scopes.document_id()).cache()
    found = {}
    for r in scopes.search_segments(docs).orderBy("document_id", "segment_id").collect():
        found.setdefault(r["document_id"], []).append((r["segment_id"], r["field"], r["text"], r["counted"]))
    fields = "title author affiliation keyword abstract_section_title abstract_section_title abstract abstract definition section_title body figure_label figure_caption table_label table_caption table_text acknowledgment reference".split()
    assert [x[1] for x in found["PMC7"]] == fields and [x[0] for x in found["PMC7"]] == list(range(len(fields)))
    assert [(x[2], x[3]) for x in found["5"]] == [("M one. M two.", True), ("N1.", False), ("U.", True)]
    counted = {(r["document_id"], r["field"]): r["counted"] for r in scopes.statistics_segments(docs).collect()}
    assert ("PMC7", "author") not in counted and counted["PMC7", "title"] is False and counted["PMC7", "body"] is True and counted["PMC7", "table_text"] is False
    assert sorted(r["text"] for r in scopes.section_sentences(docs.where("pmid = '5'")).collect()) == ["M one.", "M two.", "U."]
    stats = {r["document_id"]: r for r in scopes.document_statistics(docs).collect()}
    assert stats["PMC7"]["reported_words"] == 12 and stats["PMC7"]["difference"] == stats["PMC7"]["words"] - 12 and stats["5"]["reported_words"] is None and stats["5"]["words"] == 9
    segments = docs.sparkSession.createDataFrame([("a", 0, " x ")], "document_id string, segment_id int, text string")
    whole = docs.sparkSession.createDataFrame([("a", "no"), ("b", "yes"), ("c", None)], "document_id string, search_text string")
    assert {(r["document_id"], r["text"]) for r in scopes.document_texts(segments, whole).collect()} == {("a", "x"), ("b", "yes")}


def test_ids(spark):
    cases = {"PMID= 12345678901": ["12345678901"], "pmid#5\nhttps://pubmed.ncbi.nlm.nih.gov/77/": ["5", "77"], " 44, \n,45;\nx 46": ["44", "45"], "123456, 99999 and 1234": ["123456", "99999"], "": [], "none": []}
    rows = ids.ids_in_text(spark.createDataFrame(list(enumerate(cases)), "k int, t string"), "k", "t").orderBy("k", "pos").collect()
    assert [[r["id"] for r in rows if r["k"] == k] for k in range(len(cases))] == list(cases.values())
    files = spark.createDataFrame([(f"d/{n}.xml",) for n in "abc"], "path string")
    manifest = spark.createDataFrame([(0, "x/c.xml", None), (1, None, "a"), (2, "gone.xml", None), (3, " ", "")], "pos int, file string, pmcid string")
    assert [r["path"] for r in ids.in_manifest_order(files, manifest).orderBy("pos").collect()] == ["d/c.xml", "d/a.xml"]
    assert [r["path"] for r in ids.in_manifest_order(files, manifest.limit(0)).orderBy("pos").collect()] == ["d/a.xml", "d/b.xml", "d/c.xml"]


def test_fetching(spark, tmp_path):
    record = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>t</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    for name, got in (("9", "59"), ("3", "3")):
        (tmp_path / f"{name}.xml").write_text("<PubmedArticleSet>" + "".join(record.format(i) for i in got) + "</PubmedArticleSet>")
    documents, missing, report = efetch.fetch_documents(spark, ["9", "x", "5", "PMID 3", "4", "9"], batch_size="2", pause="0", answers=str(tmp_path))
    assert [r["pmid"] for r in documents.orderBy("pos").collect()] == ["9", "5", "3"] and [r["id"] for r in missing.collect()] == ["4"]
    assert [(r["batch"], r["requested"], r["returned"], r["missing"], r["attempts"]) for r in report.orderBy("batch").collect()] == [(0, 2, 2, 0, 1), (1, 2, 1, 1, 1)]
    assert [r["pmid"] for r in efetch.fetch_from_text(spark, "PMID: 3", pause="0", answers=str(tmp_path))[0].collect()] == ["3"]
    with pytest.raises(ValueError):
        efetch.fetch_from_text(spark, "nothing")
    waits, answers = [], iter([OSError("a"), OSError("b"), b"ok"])

    def opener(url, timeout):
        if isinstance(answer := next(answers), OSError):
            raise answer
        return answer

    assert efetch.fetched(["1"], opener, sleep=waits.append) == (b"ok", 3) and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        efetch.fetched(["1"], lambda u, t: (_ for _ in ()).throw(OSError("c")), attempts=2, sleep=waits.append)


def test_uploads(spark):
    rows = [("a.xml", b"\xef\xbb\xbf <article><p>x</p></article>"), ("list.txt", b"\xef\xbb\xbfPMID: 12\n13\n")]
    documents, found = efetch.sorted_uploads(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "path string, content binary"))
    assert [r["source_format"] for r in documents.collect()] == ["GenericXML"] and [r["id"] for r in found.orderBy("pos").collect()] == ["12", "13"]


def test_artifacts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "document_id string, text string")
    artifacts.write_tables({"t": docs}, f"{tmp_path}/w", {"note": "é"})
    assert artifacts.read_tables(spark, f"{tmp_path}/w")["t"].count() == 2 and artifacts.read_manifest(spark, f"{tmp_path}/w")["note"] == "é"
    artifacts.write_corpus(docs, "document_id", "text", f"{tmp_path}/c", {"accepted": 2})
    assert artifacts.read_corpus(spark, f"{tmp_path}/c").count() == 2
    docs.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/c/documents")
    with pytest.raises(ValueError):
        artifacts.read_corpus(spark, f"{tmp_path}/c")


def test_stream_appends(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string"
    for k, rows in enumerate(([(1, "data data", None, None), (2, None, None, None)], [(3, "data new", None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        append.append_counts(append.new_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r["term"], r["cf"], r["df"]) for r in append.merged_counts(spark, f"{tmp_path}/out").collect()} == {("data", 3, 2), ("new", 1, 1)}
