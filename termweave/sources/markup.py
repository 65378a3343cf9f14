"""Documents out of XML: the format told from the root, then one reader for each format into one row type.

Files are read as binary rows and parsed in Arrow batches; a file that cannot be parsed gives a row with its error. Names of elements are compared without
their namespace.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROW = (
    "filename string, source_format string, search_scope string, article_type string, pmcid string, pmid string, doi string, title string, journal string, language string, authors array<string>, affiliations array<string>, keywords array<string>, "
    "abstract_section_titles array<string>, abstract_sections array<struct<label string, nlm_category string, text string>>, section_titles array<string>, body array<string>, definitions array<struct<term string, definition string>>, figures array<struct<label string, caption string>>, "
    "tables array<struct<label string, caption string, text string>>, acknowledgments array<string>, refs array<string>, statistics_text string, reported map<string, string>, error string"
)
COLUMNS = [c.strip().split(" ")[0] for c in re.split(r",\s(?![^<]*>)", ROW)]
_LISTS = ("authors", "affiliations", "keywords", "abstract_section_titles", "abstract_sections", "section_titles", "body", "definitions", "figures", "tables", "acknowledgments", "refs")

# What marks an abstract as another than the main one in the corpus of abstracts; the same for whole articles.
SIDE_MARKERS = ["author-highlights", "highlight", "highlights", "precis", "graphical", "teaser", "plain-language", "plain language", "key-points", "key points", "publisher", "summary-for", "supplement"]
SIDE_TYPES = ["short", "toc", "graphical"]
# Parts of a body that are kept apart from its prose; counts an article reports of itself.
NO_PROSE = {"fig", "table-wrap", "supplementary-material", "def-list"}
COUNTS = ["word-count", "fig-count", "table-count", "ref-count", "page-count"]
# Labels that stand for no label.
NO_LABEL = {"UNASSIGNED", "UNLABELLED", "UNLABELED"}
LANGUAGE = "{http://www.w3.org/XML/1998/namespace}lang"


# --- trees ------------------------------------------------------------------------------------------------------------


def local(tag: object) -> str:
    return str(tag).rpartition("}")[2] if isinstance(tag, str) else ""


def children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [x for x in node if local(x.tag) == name] if node is not None else []


def child(node: ET.Element | None, *path: str) -> ET.Element | None:
    """The first element down a path of names."""
    for name in path:
        node = next(iter(children(node, name)), None)
    return node


def every(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if local(x.tag) == name] if node is not None else []


def first(node: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(every(node, name)), None)


def collapsed(text: str | None) -> str:
    """White space collapsed and nothing else: texts that statistics count."""
    return " ".join((text or "").split())


def squeezed(text: str | None) -> str:
    """White space collapsed; none before closing and behind opening signs; no empty brackets."""
    t = " ".join((text or "").split())
    t = re.sub(r"[(\[]\s*[,;:\-–—]*\s*[)\]]", "", t)
    t = re.sub(r"\s+([,.;:!?%)\]])", r"\1", t)
    return " ".join(re.sub(r"([(\[])\s+", r"\1", t).split())


def inner_text(node: ET.Element | None, without: set[str] = frozenset(), citations: bool = False) -> str:
    """Text of a subtree in document order. Excluded subtrees drop out, what follows them stays."""
    if node is None:
        return ""
    parts: list[str] = []

    def walk(n: ET.Element) -> None:
        skip = local(n.tag) in without or (not citations and local(n.tag) == "xref" and n.get("ref-type") == "bibr") or not isinstance(n.tag, str)
        if not skip:
            parts.append(n.text or "")
            for below in n:
                walk(below)
                parts.append(below.tail or "")

    walk(node)
    return squeezed("".join(parts))


def distinct(texts: Iterator[str] | list[str]) -> list[str]:
    return list(dict.fromkeys(t for t in texts if t))


def detected_format(root: ET.Element) -> str:
    """PubMed, JATS, BioC, else GenericXML. A name alone does not make a format: what each must hold below has to be there."""
    name = local(root.tag)
    if name == "PubmedArticleSet" or (name == "PubmedArticle" and child(root, "MedlineCitation") is not None):
        return "PubMed"
    if any(child(a, "front", "article-meta") is not None for a in every(root, "article")):
        return "JATS"
    holders = children(root, "document") if name == "collection" else [root] if name == "document" else []
    return "BioC" if any(child(d, "passage") is not None for d in holders) else "GenericXML"


def _blank(name: str, kind: str) -> dict:
    return {c: None for c in COLUMNS} | {"filename": name, "source_format": kind, "search_scope": ""} | {c: [] for c in _LISTS} | {"reported": {}}


# --- JATS ---------------------------------------------------------------------------------------------------------------


def main_abstract(meta: ET.Element | None) -> ET.Element | None:
    """Of the corpus of abstracts: the first abstract without a type, else the first whose type marks no side form, else none."""
    kinds = [(a, (a.get("abstract-type") or a.get("content-type") or "").strip().casefold()) for a in children(meta, "abstract")]
    fit = [(a, k) for a, k in kinds if not any(m in k for m in SIDE_MARKERS)]
    return next((a for a, k in fit if not k), fit[0][0] if fit else None)


def primary_abstract(meta: ET.Element | None) -> ET.Element | None:
    """Of whole articles: the first abstract of no side type, else the first."""
    found = children(meta, "abstract")
    return next((a for a in found if a.get("abstract-type", "").lower() not in SIDE_TYPES), found[0] if found else None)


def _paragraphs(node: ET.Element, label: str = "") -> Iterator[dict]:
    """Paragraphs with the title of the section that holds them; none is read again within another."""
    for below in node:
        if local(below.tag) == "p":
            if text := inner_text(below):
                yield {"label": label, "nlm_category": "", "text": text}
        else:
            yield from _paragraphs(below, inner_text(child(below, "title")) if local(below.tag) == "sec" else label)


def _article(root: ET.Element) -> ET.Element | None:
    return root if local(root.tag) == "article" else first(root, "article")


def _ids(meta: ET.Element | None) -> dict:
    ids = {x.get("pub-id-type"): inner_text(x) for x in reversed(children(meta, "article-id"))}
    return {"pmcid": ids.get("pmcid") or ids.get("pmc"), "pmid": ids.get("pmid"), "doi": ids.get("doi")}


def _jats_head(article: ET.Element, name: str) -> tuple[dict, ET.Element | None]:
    """What both readers of articles share, and the element with the metadata."""
    front = child(article, "front")
    meta = child(front, "article-meta")
    row = _blank(name, "JATS") | _ids(meta)
    names = [squeezed(" ".join(inner_text(first(c, n)) for n in ("given-names", "surname"))) or inner_text(first(c, "collab")) for c in every(meta, "contrib") if c.get("contrib-type", "author") == "author"]
    return row | {
        "article_type": article.get("article-type", ""),
        "language": (article.get(LANGUAGE) or article.get("xml:lang") or "").strip(),
        "title": inner_text(child(meta, "title-group", "article-title")),
        "journal": inner_text(first(front, "journal-title")),
        "authors": [t for t in names if t],
        "affiliations": distinct(inner_text(a, {"label"}) for a in every(meta, "aff")),
        "keywords": [t for k in every(meta, "kwd") if (t := inner_text(k))],
    }, meta


def read_jats(root: ET.Element, name: str) -> dict:
    """A whole article."""
    article = _article(root)
    row, meta = _jats_head(article, name)
    front, body, back = (child(article, n) for n in ("front", "body", "back"))
    abstract = primary_abstract(meta)
    if abstract is not None:
        row["abstract_section_titles"] = [t for s in every(abstract, "sec") if (t := inner_text(child(s, "title")))]
        row["abstract_sections"] = list(_paragraphs(abstract))

    def prose(node: ET.Element | None, within: str = "") -> None:
        for below in node if node is not None else ():
            kind = local(below.tag)
            if kind in NO_PROSE:
                continue
            if kind == "title" and within == "sec":
                row["section_titles"] += [t for t in [inner_text(below)] if t]
            elif kind == "p":
                row["body"] += [t for t in [inner_text(below, NO_PROSE)] if t]
            else:
                prose(below, kind)

    prose(body, "body")
    cells = lambda t: squeezed(" ".join([*(inner_text(x) for x in every(t, "th")), *(inner_text(x) for x in every(t, "td"))]))
    row["definitions"] = [{"term": inner_text(first(d, "term")), "definition": inner_text(first(d, "def"))} for d in every(article, "def-item")]
    row["figures"] = [{"label": inner_text(first(f, "label")), "caption": inner_text(first(f, "caption"))} for f in every(article, "fig")]
    row["tables"] = [{"label": inner_text(first(t, "label")), "caption": inner_text(first(t, "caption")), "text": cells(t)} for t in every(article, "table-wrap")]
    row["acknowledgments"] = [t for a in every(back, "ack") if (t := inner_text(a, {"title"}))]
    row["refs"] = [t for r in every(back, "ref") if (t := inner_text(r, citations=True))]
    row["statistics_text"] = collapsed(" ".join([inner_text(front, {"permissions"}, True), inner_text(body, citations=True), inner_text(back, citations=True)]))
    row["reported"] = {n: c.get("count") for n in COUNTS if (c := first(meta, n)) is not None and c.get("count") is not None}
    return row


def read_abstract_only(root: ET.Element, name: str) -> dict:
    """An article of the corpus of abstracts: its metadata and its main abstract; all else stays empty, and statistics count the abstract alone."""
    article = _article(root)
    if article is None or child(article, "front") is None or child(article, "front", "article-meta") is None:
        raise ValueError("no article with front and article-meta")
    row, meta = _jats_head(article, name)
    row["search_scope"] = "abstract_only"
    abstract = main_abstract(meta)
    if abstract is not None:
        for part in children(abstract, "sec") or [abstract]:
            label = inner_text(child(part, "title")) if part is not abstract else ""
            texts = [t for p in every(part, "p") if (t := inner_text(p))] or [t for t in [inner_text(part).removeprefix(label).strip()] if t]
            row["abstract_section_titles"] += [label] if label else []
            row["abstract_sections"] += [{"label": label, "nlm_category": "", "text": t} for t in texts]
    row["statistics_text"] = " ".join(s["text"] for s in row["abstract_sections"])
    return row


# --- BioC ----------------------------------------------------------------------------------------------------------------

Rule = Callable[[str, str], bool]
# The kinds of a passage by its two descriptions, type and section, in the order in which they are tried.
PASSAGES: list[tuple[str, Rule]] = [
    ("title", lambda t, s: t in ("title", "article-title", "article_title") or s == "title"),
    ("abstract", lambda t, s: "abstract" in f"{t} {s}"),
    ("author", lambda t, s: "author" in f"{t} {s}" and "reference" not in f"{t} {s}"),
    ("affiliation", lambda t, s: "affiliation" in f"{t} {s}" or t == "aff"),
    ("keyword", lambda t, s: "keyword" in f"{t} {s}" or t == "kwd"),
    ("reference", lambda t, s: bool({t, s} & {"ref", "reference", "references"})),
    ("acknowledgment", lambda t, s: bool({t, s} & {"ack", "acknowledgment", "acknowledgement"}) or t in ("acknowledgments", "acknowledgements")),
    ("figure", lambda t, s: "fig" in t or s == "fig" or "figure" in s),
    ("table", lambda t, s: "table" in t or s == "table"),
    ("section_title", lambda t, s: t in ("section_title", "section-title", "sectitle", "subtitle")),
    ("definition", lambda t, s: "definition" in f"{t} {s}" or t == "def"),
    ("front", lambda t, s: "front" in (t, s)),
]


def passage_kind(kind: str, section: str, title_found: bool) -> str:
    """What a passage is, from its two descriptions; anything unknown is body."""
    t, s = (kind or "").strip().lower(), (section or "").strip().lower()
    for name, fits in PASSAGES:
        if name == "section_title" and "title" in t and title_found:
            return name
        if not fits(t, s):
            continue
        if name == "title":
            return "section_title" if title_found else name
        if name == "abstract":
            return "abstract_section_title" if "title" in t or "title" in s else name
        if name == "figure":
            return "figure_label" if "label" in t else "figure_caption"
        if name == "table":
            return "table_label" if "label" in t else "table_caption" if "caption" in t or "title" in t else "table_text"
        return name
    return "body"


def _infons(node: ET.Element) -> dict[str, str]:
    return {k: squeezed(i.text) for i in children(node, "infon") if (k := i.get("key", "").strip().lower())}


def _passage_text(passage: ET.Element) -> str:
    own = child(passage, "text")
    if own is not None and own.text:
        return squeezed(own.text)
    return " ".join(t for s in children(passage, "sentence") if (t := squeezed(getattr(child(s, "text"), "text", ""))))


def _person(value: str) -> str:
    """"surname:A;given-names:B" as "B A"."""
    fields = dict(x.partition(":")[::2] for x in value.split(";"))
    return f"{fields.get('given-names', '').strip()} {fields.get('surname', '').strip()}".strip()


def read_bioc(root: ET.Element, name: str) -> dict:
    documents = [root] if local(root.tag) == "document" else children(root, "document")
    if len(documents) != 1:
        raise ValueError(f"{len(documents)} documents in one file")
    document = documents[0]
    passages = [(p, _infons(p)) for p in children(document, "passage")]
    about: dict[str, str] = {}
    for infons in (_infons(document), *(i for _, i in passages)):
        about |= {k: v for k, v in infons.items() if v and k not in about}

    def known(*keys: str) -> str:
        return next((about[k] for k in keys if about.get(k)), "")

    row = _blank(name, "BioC")
    own = (getattr(child(document, "id"), "text", "") or "").strip()
    pmcid = known("pmcid", "pmc", "article-id_pmc", "article_id_pmc")
    if pmcid.isdigit():
        pmcid = f"PMC{pmcid}"
    elif pmcid and not pmcid.upper().startswith("PMC"):
        inside = re.search(r"PMC\d+", pmcid, re.IGNORECASE)
        pmcid = inside.group().upper() if inside else pmcid
    pmid = known("pmid", "article-id_pmid", "article_id_pmid")
    if not pmcid and own.upper().startswith("PMC"):
        pmcid = own.upper()
    if not pmcid and not pmid and own.isdigit():
        pmid = own
    row |= {
        "pmcid": pmcid, "pmid": pmid, "doi": known("doi", "article_doi", "article-id_doi", "article_id_doi"), "journal": known("journal", "journal-title", "journal_title"), "article_type": known("article-type", "article_type") or "bioc",
    }
    heads = [i for _, i in passages if (i.get("section_type") or i.get("section-type") or "").upper() == "TITLE" or i.get("type", "").lower() == "front"]
    row["authors"] = distinct(_person(v) for i in heads for k, v in sorted(i.items()) if re.fullmatch(r"name_\d+", k))
    told, label = [], ""
    for passage, infons in passages:
        text = _passage_text(passage)
        if not text:
            continue
        kind = passage_kind(infons.get("type", ""), infons.get("section_type") or infons.get("section-type") or "", bool(row["title"]))
        if kind == "table_text":
            text = squeezed(re.sub(r"</?[A-Za-z][A-Za-z0-9:_-]*(?:\s[^>]*)?>", " ", text))
        told.append(text)
        if kind == "title":
            row["title"] = text
        elif kind == "abstract_section_title":
            label = text
            row["abstract_section_titles"].append(text)
        elif kind == "abstract":
            row["abstract_sections"].append({"label": label, "nlm_category": "", "text": text})
        elif kind in ("author", "affiliation", "keyword"):
            held = row[{"author": "authors", "affiliation": "affiliations", "keyword": "keywords"}[kind]]
            held += [text] if text not in held else []
        elif kind == "definition":
            row["definitions"].append({"term": "", "definition": text})
        elif kind.startswith("figure"):
            row["figures"].append({"label": "", "caption": ""} | {kind.partition("_")[2]: text})
        elif kind.startswith("table"):
            row["tables"].append({"label": "", "caption": "", "text": ""} | {kind.partition("_")[2]: text})
        elif kind != "front":
            row[{"section_title": "section_titles", "acknowledgment": "acknowledgments", "reference": "refs"}.get(kind, "body")].append(text)
    infons = _infons(document)
    row["title"] = row["title"] or infons.get("title") or own or name.rpartition(".")[0] or name
    for held, keys in (("authors", ("author", "authors")), ("keywords", ("keyword", "keywords"))):
        extra = next((infons[k] for k in keys if infons.get(k)), None)
        row[held] += [extra] if extra and extra not in row[held] else []
    row["statistics_text"] = collapsed(" ".join(told))
    return row


# --- PubMed --------------------------------------------------------------------------------------------------------------


def shown_label(raw: str) -> str:
    """The label of a section as it is shown: no placeholders, capitals as a title."""
    label = squeezed(raw.replace("_", " "))
    return "" if label.upper() in NO_LABEL else label.title() if label.isupper() else label


def read_pubmed_article(record: ET.Element) -> dict:
    citation = child(record, "MedlineCitation")
    article, pmid = child(citation, "Article"), inner_text(child(citation, "PMID"))
    if citation is None or article is None or not pmid:
        raise ValueError("a record without citation, article or PMID")
    row = _blank(f"PMID_{pmid}.xml", "PubMed")
    ids = {x.get("IdType", "").lower(): inner_text(x) for x in every(child(record, "PubmedData", "ArticleIdList"), "ArticleId")}
    located = next((inner_text(x) for x in children(article, "ELocationID") if x.get("EIdType", "").strip().lower() == "doi"), "")
    row |= {
        "pmid": pmid, "pmcid": ids.get("pmc", ""), "doi": ids.get("doi") or located, "title": inner_text(child(article, "ArticleTitle")), "journal": inner_text(child(article, "Journal", "Title")),
        "language": inner_text(child(article, "Language")), "article_type": "; ".join(t for x in every(child(article, "PublicationTypeList"), "PublicationType") if (t := inner_text(x))) or "pubmed",
    }
    for part in children(child(article, "Abstract"), "AbstractText"):
        category = (part.get("NlmCategory") or "").strip()
        label = shown_label((part.get("Label") or "").strip() or category)
        if text := inner_text(part):
            row["abstract_section_titles"] += [label] if label else []
            row["abstract_sections"].append({"label": label, "nlm_category": category, "text": text})
    people = every(child(article, "AuthorList"), "Author")
    row["authors"] = [t for x in people if (t := inner_text(child(x, "CollectiveName")) or squeezed(f"{inner_text(child(x, 'ForeName')) or inner_text(child(x, 'Initials'))} {inner_text(child(x, 'LastName'))}"))]
    row["affiliations"] = distinct(inner_text(x) for x in every(child(article, "AuthorList"), "Affiliation"))
    row["keywords"] = distinct(inner_text(x) for x in every(citation, "Keyword"))
    # What a reader sees: labels with a colon, and texts.
    row["statistics_text"] = collapsed(" ".join(f"{s['label']}: {s['text']}" if s["label"] else s["text"] for s in row["abstract_sections"]))
    return row


def read_pubmed(root: ET.Element, name: str) -> list[dict]:
    """One row for each record of a set; a record that cannot be read gives a row with its error, and the others stay."""
    rows = []
    for k, record in enumerate([root] if local(root.tag) == "PubmedArticle" else children(root, "PubmedArticle")):
        try:
            rows.append(read_pubmed_article(record))
        except ValueError as error:
            rows.append(_blank(f"{name}#{k}", "unreadable") | {"error": f"ValueError: {error}"})
    return rows


# --- anything else ---------------------------------------------------------------------------------------------------------


def read_generic(root: ET.Element, name: str) -> dict:
    """The first title-like element, and all other text in order."""
    title = next((x for x in root.iter() if local(x.tag).lower() in ("title", "article-title", "headline", "h1") and inner_text(x)), None)
    parts: list[str] = []

    def walk(n: ET.Element) -> None:
        if n is title or local(n.tag).lower() in ("script", "style") or not isinstance(n.tag, str):
            return
        parts.append(n.text or "")
        for below in n:
            walk(below)
            parts.append(" " + (below.tail or ""))

    walk(root)
    text = squeezed(" ".join(parts))
    shown = inner_text(title) or name.rpartition(".")[0] or name
    return _blank(name, "GenericXML") | {"title": shown, "body": [text] if text else [], "statistics_text": collapsed(f"{inner_text(title)} {text}")}


def parsed(content: bytes, name: str, abstracts: bool = False) -> list[dict]:
    """The rows of one file; a row with the error if it cannot be read. abstracts: articles are read as the corpus of abstracts."""
    try:
        root = ET.fromstring(content)
        kind = detected_format(root)
        if kind == "PubMed":
            return read_pubmed(root, name)
        return [{"JATS": read_abstract_only if abstracts else read_jats, "BioC": read_bioc, "GenericXML": read_generic}[kind](root, name)]
    except (ET.ParseError, ValueError, TypeError) as error:
        return [_blank(name, "unreadable") | {"error": f"{type(error).__name__}: {error}"}]


def documents_of(files: DataFrame, abstracts: bool = False) -> DataFrame:
    """Rows of ``ROW`` from files (path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for name, content in zip(batch["path"], batch["content"]) for r in parsed(bytes(content or b""), str(name).rpartition("/")[2], abstracts)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "content").mapInPandas(parse, ROW)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.{xml,nxml}", abstracts: bool = False) -> DataFrame:
    return documents_of(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), abstracts)
