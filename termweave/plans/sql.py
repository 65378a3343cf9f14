"""The core's queries in DuckDB's SQL, for comparison. Written as relations that build on each other.

Nothing here is taken from the code under test: patterns, word lists, stemming rules and what queries ask for are written down again, stems and bases in
another form (regular expressions over whole words instead of masks and suffix cases).
"""

from __future__ import annotations

# What a term is.
_P = (
    r"\p{Nd}+(?:[.,]\p{Nd}+)*(?:[‐‑‒–—-]\p{Nd}+(?:[.,]\p{Nd}+)*)?(?:%|[A-Za-z]+)?"
    r"|[\p{L}\p{N}]+(?:[.''’/‐‑‒–—-][\p{L}\p{N}]+)*%?"
)
# White space; rules that normalise a text, that clean it for statistics, that mark the ends of sentences.
_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NORMAL = [(f"[{_SPACE}]+", " "), ("^ +", ""), (" +$", ""), (r" +([,.;:!?%)\]])", r"\1"), (r"([(\[]) +", r"\1")]
_CLEAN = [*_NORMAL, (r"(?: *, *){2,}", ", "), (r"(?: *; *){2,}", "; "), (r"\( *[,;:\-–—]* *\)", ""), (r"\[ *[,;:\-–—]* *\]", ""), *_NORMAL]
_ABBREVIATED = r"(^| |\()((?:Dr|Mr|Mrs|Ms|Prof|St|vs|etc|Fig|al|e\.g|i\.e|[A-Z]))\. "
_ENDS = r"([.!?]+[\x{22}\x{27})\]]*) +"
# Fixed value: the stop words of condition C.
_STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "can't", "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down",
    "during", "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her",
    "here", "here's", "hers", "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is", "isn't", "it",
    "it's", "its", "itself", "let's", "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other",
    "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such",
    "than", "that", "that's", "the", "their", "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd", "they'll", "they're",
    "they've", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were", "weren't",
    "what", "what's", "when", "when's", "where", "where's", "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't",
    "you", "you'd", "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves",
]
# The forms counted in a corpus.
_FORMS = [
    ("glp-1_ascii_exact", r"glp\-1"), ("glp‐1_u2010_exact", "glp‐1"), ("glp‑1_u2011_exact", "glp‑1"), ("glp–1_u2013_exact", "glp–1"), ("glp_1_space_exact", r"glp\s+1"),
    ("glp-1r_ascii_exact", r"glp\-1r"), ("glucagon-like_peptide-1_ascii", r"glucagon\-like\s+peptide\-1"), ("glucagon-like_peptide_1_ascii", r"glucagon\-like\s+peptide\s+1"),
    ("glp−1_u2212_exact", "glp−1"), ("glp—1_u2014_exact", "glp—1"), ("glp‐1r_u2010_exact", "glp‐1r"), ("glp1_exact", "glp1"), ("glp1r_exact", "glp1r"),
    ("glucagon_like_peptide_1_spaces", r"glucagon\s+like\s+peptide\s+1"),
]
# What the queries ask for.
WORD, WORD_BASE = "adults", "adult"
PHRASE, PHRASE_BASES = ("shift", "workers"), ("shift", "worker")
WEEKS = ("week", "of", "adult")
OVERLAPPING = ("at", "6")
WHOLE = ("sampling", "began", "at", "3", "a.m")
APPROXIMATE = ("the", "calculator", "was", "written", "in", "javascript")
LITERAL, AUTO = r"(?i)kidney\s+transplant", r"(?i)ransplant\s+recip"
MISSPELT = ("obesty", "treatmnt", "gastric")


def _rules(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _sentences(x: str) -> str:
    """Sentences as a list: blanks behind abbreviations are held, blanks behind the ends of sentences cut."""
    held = x
    for _ in range(2):
        held = f"regexp_replace({held}, '{_ABBREVIATED}', '\\1\\2.' || chr(2), 'g')"
    cut = f"regexp_replace({held}, '{_ENDS}', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split(replace({cut}, chr(2), ' '), chr(1)), lambda x: x <> '')"


def _fold(x: str) -> str:
    return f"replace(lower(replace({x}, 'İ', 'i̇')), 'ß', 'ss')"


def _surface(x: str) -> str:
    return f"trim(replace({_fold(x)}, '’', ''''))"


def _base(x: str) -> str:
    """Without possessive, then without plural, by patterns over the whole word."""
    t = f"regexp_replace({x}, '''s$', '')"
    return (
        f"(CASE WHEN regexp_matches({t}, '^.{{2,}}ies$') THEN regexp_replace({t}, 'ies$', 'y') "
        f"WHEN regexp_matches({t}, '^(.+[cs]hes|.{{2,}}[xz]es)$') AND length({t}) > 4 THEN regexp_replace({t}, 'es$', '') "
        f"WHEN regexp_matches({t}, '^.{{3,}}s$') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN regexp_replace({t}, 's$', '') ELSE {t} END)"
    )


# Stems by regular expressions: C, V are runs of consonants and vowels; the measure is how often V C follows.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}"
_ONE, _VOWEL, _CVC = f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxyY]$"
# Suffixes and replacements.
_TWO = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_THREE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOUR = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _stems(source: str) -> str:
    """(word, stem) of the distinct words of a relation with a column ``word``."""

    def without(n: int) -> str:
        return f"left(w, greatest(length(w) - {n}, 0))"

    def like(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def swapped(rules: list[tuple[str, str]], least: str) -> str:
        return "CASE " + " ".join(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {like(without(len(a)), least)} THEN {without(len(a))} || '{b}' ELSE w END" for a, b in rules) + " ELSE w END"

    x = "substr(w, 2)"
    steps = [
        "CASE WHEN starts_with(w, 'y') THEN 'Y' || substr(w, 2) ELSE w END",
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {without(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {without(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {like(without(3), _M0)} THEN {without(1)} ELSE w END WHEN ends_with(w, 'ed') THEN CASE WHEN {like(without(2), _VOWEL)} THEN '>' || {without(2)} ELSE w END WHEN ends_with(w, 'ing') AND {like(without(3), _VOWEL)} THEN '>' || {without(3)} ELSE w END",
        f"CASE WHEN NOT starts_with(w, '>') THEN w WHEN {like(x, '(at|bl|iz)$')} THEN {x} || 'e' WHEN right(w, 1) = left(right(w, 2), 1) AND {like(x, '[^aeioulsz]$')} AND length(w) > 2 THEN left({x}, length(w) - 2) WHEN {like(x, _CVC)} THEN {x} || 'e' ELSE {x} END",
        f"CASE WHEN ends_with(w, 'y') AND {like(without(1), _VOWEL)} THEN {without(1)} || 'i' ELSE w END",
        swapped(_TWO, _M0),
        swapped(_THREE, _M0),
        f"CASE WHEN ends_with(w, 'ion') THEN CASE WHEN {like(without(3), _M1)} AND {like(without(3), '[st]$')} THEN {without(3)} ELSE w END " + swapped([(a, "") for a in _FOUR], _M1).removeprefix("CASE "),
        f"CASE WHEN ends_with(w, 'e') AND ({like(without(1), _M1)} OR {like(without(1), _ONE)} AND NOT {like(without(1), _CVC)}) THEN {without(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {like('w', _M1)} THEN {without(1)} ELSE w END",
    ]
    sql = f"SELECT DISTINCT word, word AS w FROM ({source})"
    for step in steps:
        sql = f"SELECT word, {step} AS w FROM ({sql})"
    return f"SELECT word, CASE WHEN regexp_full_match(word, '[a-z]{{3,}}') THEN lower(w) ELSE word END AS stem FROM ({sql})"


def _list(*values: str) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_REL = {
    "docs": "SELECT doc_id::VARCHAR AS document_id, text, lang, source FROM documents WHERE text IS NOT NULL",
    "lines": f"SELECT document_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_rules('x', _CLEAN)}), lambda x: x <> '') AS l FROM docs",
    "seg0": "SELECT document_id, generate_subscripts(l, 1) - 1 AS segment_id, unnest(l) AS text FROM lines",
    "seg": "SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start FROM seg0",
    "cut": f"SELECT document_id, segment_id, seg_start, {_sentences('text')} AS l FROM seg",
    "sen0": "SELECT document_id, segment_id, seg_start, generate_subscripts(l, 1) - 1 AS sentence_index, unnest(l) AS text FROM cut",
    "sen1": "SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id, segment_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, row_number() OVER (PARTITION BY document_id ORDER BY segment_id, sentence_index) - 1 AS global_sentence_index FROM sen0",
    "sen": "SELECT document_id, segment_id, sentence_index, global_sentence_index, text, char_start, char_start + length(text) AS char_end, seg_start + char_start AS g_start, seg_start + char_start + length(text) AS g_end, seg_start FROM sen1",
    "tok0": f"SELECT document_id, segment_id, sentence_index, char_start AS s, seg_start, regexp_extract_all(text, '{_P}') AS t, string_split_regex(text, '{_P}') AS g FROM sen",
    "tok1": "SELECT document_id, segment_id, sentence_index, s, seg_start, generate_subscripts(t, 1) AS i, unnest(t) AS text, length(unnest(g[:len(t)])) AS gap FROM tok0",
    "tok2": "SELECT *, s + sum(gap + length(text)) OVER (PARTITION BY document_id, segment_id, sentence_index ORDER BY i) AS char_end, row_number() OVER (PARTITION BY document_id, segment_id ORDER BY sentence_index, i) - 1 AS word_index, row_number() OVER (PARTITION BY document_id ORDER BY segment_id, sentence_index, i) - 1 AS global_word_index FROM tok1",
    "tok3": f"SELECT document_id, segment_id, sentence_index, word_index, global_word_index, text, {_fold('text')} AS term, {_surface('text')} AS surface, (char_end - length(text))::BIGINT AS char_start, char_end::BIGINT AS char_end, (seg_start + char_end - length(text))::BIGINT AS g_start, (seg_start + char_end)::BIGINT AS g_end FROM tok2",
    "tok": f"SELECT *, {_base('surface')} AS base FROM tok3",
    "whole": "SELECT document_id, source, array_to_string(l, chr(10)) AS text FROM lines",
    "ta": f"SELECT document_id, source, unnest(list_transform(regexp_extract_all(text, '[^{_SPACE}]+'), lambda x: {_fold('x')})) AS term FROM whole",
    "tb": f"SELECT document_id, source, {_fold('x')} AS term FROM (SELECT document_id, source, unnest(regexp_extract_all(text, '{_P}')) AS x FROM whole)",
    "tc": f"SELECT * FROM tb WHERE term NOT IN {_list(*_STOPWORDS)}",
    "ca": "SELECT document_id, term, count(*) AS n FROM ta GROUP BY 1, 2",
    "cb": "SELECT document_id, term, count(*) AS n FROM tb GROUP BY 1, 2",
    "cc": "SELECT document_id, term, count(*) AS n FROM tc GROUP BY 1, 2",
    "part0": "SELECT term, regexp_extract_all(term, '[^/''’‐‑‒–—-]+|[/''’‐‑‒–—-]+') AS p FROM (SELECT DISTINCT term FROM cb)",
    "part": "SELECT term, generate_subscripts(p, 1) AS i, unnest(p) AS word FROM part0",
    "stems": _stems("SELECT word FROM part"),
    "stem_of": "SELECT term, replace(string_agg(stem, '' ORDER BY i), '’', '''') AS stem FROM part JOIN stems USING (word) GROUP BY term",
    "cd": "SELECT document_id, stem AS term, sum(n)::BIGINT AS n FROM cc JOIN stem_of USING (term) WHERE stem <> '' GROUP BY 1, 2",
    "cbs": "SELECT document_id, stem AS term, sum(n)::BIGINT AS n FROM cb JOIN stem_of USING (term) WHERE stem <> '' GROUP BY 1, 2",
    "counts": "SELECT 'A_basic' AS condition, * FROM ca UNION ALL SELECT 'B_no_punctuation', * FROM cb UNION ALL SELECT 'C_no_stopwords', * FROM cc UNION ALL SELECT 'D_porter', * FROM cd",
    "stats": "SELECT condition, term, sum(n)::BIGINT AS cf, count(*) AS df FROM counts GROUP BY 1, 2",
    "b": "SELECT 'B_no_punctuation' AS condition, term, sum(n)::BIGINT AS cf, count(*) AS df FROM cb GROUP BY 2",
    "nd": "SELECT count(*)::DOUBLE AS nd FROM docs",
    "vocab": f"SELECT {_surface('term')} AS surface, sum(cf)::BIGINT AS cf FROM b GROUP BY 1",
    "vec": "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings",
    "asked": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(MISSPELT)) + ") t(pos, token)",
}
_NEEDS = {
    "docs": "", "lines": "docs", "seg0": "lines", "seg": "seg0", "cut": "seg", "sen0": "cut", "sen1": "sen0", "sen": "sen1", "tok0": "sen", "tok1": "tok0", "tok2": "tok1", "tok3": "tok2", "tok": "tok3", "whole": "lines",
    "ta": "whole", "tb": "whole", "tc": "tb", "ca": "ta", "cb": "tb", "cc": "tc", "part0": "cb", "part": "part0", "stems": "part", "stem_of": "part stems", "cd": "cc stem_of", "cbs": "cb stem_of",
    "counts": "ca cb cc cd", "stats": "counts", "b": "cb", "nd": "docs", "vocab": "b", "vec": "", "asked": "",
}


def _with(names: str, extra: dict[str, str], last: str) -> str:
    """A statement with the relations that ``names`` need, in order, then ``extra``, then the last select."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS[name].split():
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({_REL[n]})" if n in ("tok", "counts", "stats", "b", "cb", "tb", "stem_of") else f"{n} AS ({_REL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {last}" if parts else last


def _zipf(source: str, keep: str = "condition") -> str:
    return f"SELECT {keep}, term, row_number() OVER (PARTITION BY condition ORDER BY cf DESC, term) AS rank, cf AS frequency, cf / sum(cf) OVER (PARTITION BY condition) AS probability FROM {source}"


def _fit(source: str, keys: str) -> str:
    """Fit of log10(frequency) on log10(rank)."""
    return f"""SELECT {keys}, (n >= 2 AND sxx > 1e-15) AS valid, n, CASE WHEN n >= 2 AND sxx > 1e-15 THEN round(b, 6) END AS slope, CASE WHEN n >= 2 AND sxx > 1e-15 THEN round(a, 6) END AS intercept,
CASE WHEN n >= 2 AND sxx > 1e-15 THEN round(0 - b, 6) END AS zipf_exponent, CASE WHEN n >= 2 AND sxx > 1e-15 AND syy > 1e-15 THEN round(r2, 6) END AS r_squared,
CASE WHEN n >= 2 AND sxx > 1e-15 THEN round(sqrt(greatest(syy - b * b * sxx, 0) / n), 6) END AS rmse, rank_start, rank_end
FROM (SELECT {keys}, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_r2(y, x) AS r2, min(rank) AS rank_start, max(rank) AS rank_end
FROM (SELECT *, log10(rank) AS x, log10(frequency) AS y FROM {source}) GROUP BY {keys})"""


def _regions(source: str) -> str:
    return f"SELECT *, CASE WHEN rank <= ceil(n / 3) THEN 'high' WHEN rank <= ceil(2 * n / 3) THEN 'middle' ELSE 'low' END AS region FROM (SELECT *, count(*) OVER (PARTITION BY condition) AS n FROM {source})"


def _rows(keys: str, source: str) -> str:
    return f"SELECT {keys} cf AS collection_frequency, df AS document_frequency, df / nd AS document_coverage, CASE WHEN df > 0 THEN cf / df END AS cf_per_containing_document, CASE WHEN df > 0 THEN round(log10(nd / df), 9) END AS idf FROM {source}, nd"


def _significant(source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY condition ORDER BY score DESC, frequency_rank, term) AS significance_rank FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY cf DESC, df DESC, term) AS frequency_rank, round(log10(1 + cf) * log10(nd / df), 9) AS score FROM {source}, nd) QUALIFY significance_rank <= 20"


_PLACE = "document_id, segment_id, sentence_index"


def _run(terms: tuple[str, ...]) -> str:
    values = ", ".join(f"({j}, '{t}')" for j, t in enumerate(terms))
    return f"SELECT {_PLACE}, word_index - j AS anchor, min(global_word_index) AS word_position, min(g_start) AS char_start, max(g_end) AS char_end FROM tok JOIN (VALUES {values}) q(j, t) ON surface = t GROUP BY ALL HAVING count(*) = {len(terms)}".replace("GROUP BY ALL", f"GROUP BY {_PLACE}, word_index - j")


def _near(bases: tuple[str, ...], extra: int) -> str:
    """Shortest windows: for each start and term the position where the term has occurred often enough."""
    need: dict[str, int] = {}
    for b in bases:
        need[b] = need.get(b, 0) + 1
    values = ", ".join(f"('{b}', {n})" for b, n in need.items())
    k = len(bases)
    return f"""SELECT document_id, segment_id, 'related' AS match_type, 'proximity_N{extra}' AS match_method, round({k}.0::DOUBLE / (e - p + 1), 4) AS similarity, word_position, char_start, (SELECT max(o.g_end) FROM occ o WHERE o.document_id = w.document_id AND o.segment_id = w.segment_id AND o.sentence_index = w.sentence_index AND o.word_index = e) AS char_end
FROM (SELECT {_PLACE}, p, word_position, char_start, max(pos) AS e, count(*) AS met FROM (
 SELECT s.document_id, s.segment_id, s.sentence_index, s.word_index AS p, s.global_word_index AS word_position, s.g_start AS char_start, o.word_index AS pos, need, row_number() OVER (PARTITION BY s.document_id, s.segment_id, s.sentence_index, s.word_index, o.base ORDER BY o.word_index) AS k
 FROM occ s JOIN occ o ON s.document_id = o.document_id AND s.segment_id = o.segment_id AND s.sentence_index = o.sentence_index AND o.word_index >= s.word_index JOIN (VALUES {values}) q(t, need) ON o.base = t) WHERE k = need GROUP BY ALL) w WHERE met = {len(need)} AND e - p + 1 <= {k + extra}""".replace("WHERE k = need GROUP BY ALL", f"WHERE k = need GROUP BY {_PLACE}, p, word_position, char_start")


def _occ(bases: tuple[str, ...]) -> str:
    return f"SELECT * FROM tok WHERE base IN {_list(*set(bases))}"


def _ordered(bases: tuple[str, ...], extra: int) -> str:
    sql = "SELECT document_id, segment_id, sentence_index, word_index AS p, word_index AS last, global_word_index AS word_position, g_start AS char_start, g_end AS char_end FROM occ WHERE base = '" + bases[0] + "'"
    for b in bases[1:]:
        sql = f"SELECT s.document_id, s.segment_id, s.sentence_index, s.p, min(o.word_index) AS last, s.word_position, s.char_start, min_by(o.g_end, o.word_index) AS char_end FROM ({sql}) s JOIN occ o ON s.document_id = o.document_id AND s.segment_id = o.segment_id AND s.sentence_index = o.sentence_index AND o.base = '{b}' AND o.word_index > s.last GROUP BY s.document_id, s.segment_id, s.sentence_index, s.p, s.word_position, s.char_start"
    k = len(bases)
    return f"SELECT document_id, segment_id, 'related' AS match_type, 'ordered_proximity' AS match_method, round({k}.0::DOUBLE / (last - p + 1), 4) AS similarity, word_position, char_start, char_end FROM ({sql}) WHERE last - p + 1 <= {k + extra}"


def _literal(pattern: str) -> str:
    return f"""SELECT document_id, segment_id, 'exact' AS match_type, 'literal' AS match_method, 1.0::DOUBLE AS similarity, (SELECT min(t.global_word_index) FROM tok t WHERE t.document_id = h.document_id AND t.segment_id = h.segment_id AND t.g_start < h.char_end AND t.g_end > h.char_start) AS word_position, char_start, char_end FROM (
SELECT document_id, segment_id, (seg_start + e - length(m))::BIGINT AS char_start, (seg_start + e)::BIGINT AS char_end FROM (
SELECT *, sum(gap + length(m)) OVER (PARTITION BY document_id, segment_id ORDER BY i) AS e FROM (SELECT document_id, segment_id, seg_start, generate_subscripts(f, 1) AS i, unnest(f) AS m, length(unnest(g[:len(f)])) AS gap FROM (
SELECT document_id, segment_id, seg_start, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g FROM seg WHERE regexp_matches(text, '{pattern}'))))) h"""


_HITS = {
    "occ": _occ(PHRASE_BASES),
    "exact": f"SELECT document_id, segment_id, 'exact' AS match_type, 'exact_phrase' AS match_method, 1.0::DOUBLE AS similarity, word_position, char_start, char_end FROM ({_run(PHRASE)})",
    "related": _near(PHRASE_BASES, 2),
    "apart": "SELECT * FROM related r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.document_id = r.document_id AND e.segment_id = r.segment_id AND r.char_start < e.char_end AND e.char_start < r.char_end)",
    "hits": "SELECT *, row_number() OVER (ORDER BY CASE WHEN match_type = 'exact' THEN 0 ELSE 1 END, CASE WHEN match_type = 'exact' THEN 0.0 ELSE -similarity END, document_id, char_start, char_end, match_method) AS result_rank FROM (SELECT * FROM exact UNION ALL SELECT * FROM apart)",
    "by_doc": "SELECT *, row_number() OVER (ORDER BY exact_count DESC, total_count DESC, document_id) AS document_rank FROM (SELECT document_id, count(*) FILTER (match_type = 'exact') AS exact_count, count(*) FILTER (match_type <> 'exact') AS related_count, count(*) AS total_count, max(similarity) AS max_similarity FROM hits GROUP BY 1)",
}
_CONTEXT = "LEFT JOIN sen s ON s.document_id = h.document_id AND s.segment_id = h.segment_id AND s.g_start <= h.char_start AND h.char_start < s.g_end"
_COUNT4 = "SELECT condition, total_tokens, vocabulary, documents, round(total_tokens / documents, 6) AS average_tokens FROM (SELECT condition, sum(cf)::BIGINT AS total_tokens, count(*) AS vocabulary FROM stats GROUP BY 1) JOIN (SELECT condition, count(DISTINCT document_id) AS documents FROM counts GROUP BY 1) USING (condition)"
# The distance counts bytes. Against a token of one-byte letters it counts signs, if every other sign is made one byte that no token has.
_LEV = "levenshtein(regexp_replace(surface, '[^\\x00-\\x7F]', '~', 'g'), token)"
_CANDIDATES = f"SELECT pos, token, surface AS candidate, {_LEV} AS distance, cf AS frequency, row_number() OVER (PARTITION BY pos ORDER BY {_LEV}, cf DESC, abs(length(surface) - length(token)), surface) AS rank FROM vocab, asked WHERE abs(length(surface) - length(token)) <= 2 AND {_LEV} <= 2"
_FIXED = "SELECT pos, token, surface IS NOT NULL AS known, CASE WHEN surface IS NOT NULL THEN token ELSE coalesce(candidate, token) END AS corrected, CASE WHEN surface IS NOT NULL THEN 0 ELSE distance END AS distance FROM asked LEFT JOIN vocab ON token = surface LEFT JOIN (SELECT pos, candidate, distance FROM cand WHERE rank = 1) USING (pos)"


def _similar(least: float) -> str:
    return f"SELECT q.id AS query, v.id AS neighbour, round(list_cosine_similarity(v.v, q.v), 6) AS similarity FROM vec v JOIN vec q ON v.id <> q.id WHERE q.id % 20 = 0 AND round(list_cosine_similarity(v.v, q.v), 6) >= {least}"


_RANKED = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM sim"
_q0, _b0 = WORD, WORD_BASE

ORACLE = {
    "norm_text": _with("docs", {}, f"SELECT document_id, {_rules('text', _NORMAL)} AS norm FROM docs"),
    "norm_stats_text": _with("docs", {}, f"SELECT document_id, {_rules('text', _CLEAN)} AS norm FROM docs"),
    "tokenize_words": _with("docs", {}, f"SELECT document_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM (SELECT document_id, regexp_extract_all({_rules('text', _CLEAN)}, '{_P}') AS t FROM docs)"),
    **{f"tokens_{x}": _with(f"c{x}", {}, f"SELECT document_id, term, n FROM c{x}") for x in "abcd"},
    "lexical_base": _with("b", {}, f"SELECT surface, {_base('surface')} AS base FROM (SELECT DISTINCT {_surface('term')} AS surface FROM b)"),
    "porter_vocab": _with("b", {}, _stems("SELECT term AS word FROM b WHERE regexp_full_match(term, '[a-z]+')")),
    "porter_demo_rows": f"WITH w AS (SELECT * FROM (VALUES {', '.join(f'({i}, {w!r})' for i, w in enumerate('the patients were feeling hopeful about conditional treatments'.split()))}) t(pos, term)) SELECT pos, term, stem FROM w JOIN ({_stems('SELECT term AS word FROM w')}) s ON s.word = w.term",
    "segments": _with("seg", {}, "SELECT document_id, segment_id, 'body' AS field, text, seg_start FROM seg"),
    "segment_offsets": _with("seg", {}, "SELECT document_id, segment_id, seg_start, seg_start + length(text) AS seg_end FROM seg"),
    "segment_stats": _with("cut", {}, "SELECT document_id, segment_id, length(text) AS characters, length(replace(text, ' ', '')) AS characters_without_spaces, len(string_split(text, ' ')) AS words, len(l) AS sentences FROM cut JOIN seg USING (document_id, segment_id)"),
    "doc_stats": _with("cut", {}, "SELECT document_id, count(*) AS segments, sum(length(text))::BIGINT AS characters, sum(length(replace(text, ' ', '')))::BIGINT AS characters_without_spaces, sum(len(string_split(text, ' ')))::BIGINT AS words, sum(len(l))::BIGINT AS sentences FROM cut JOIN seg USING (document_id, segment_id) GROUP BY 1"),
    "sentences": _with("sen", {}, "SELECT document_id, segment_id, sentence_index, text FROM sen"),
    "sentence_positions": _with("sen", {}, "SELECT document_id, segment_id, sentence_index, global_sentence_index, char_start, char_end, g_start, g_end FROM sen"),
    "prose_sections": "SELECT document_id, segment_id, NOT regexp_matches(lower(coalesce(nullif(label, ''), nlm_category, '')), 'trial registration|registration number|registry number|prospero') AS counted FROM (SELECT DISTINCT * FROM processed_document WHERE text IS NOT NULL)",
    "pattern_audit": _with("docs", {}, " UNION ALL ".join([f"SELECT '{n}' AS pattern, count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z0-9]){p}([^a-z0-9]|$)')) AS documents FROM docs" for n, p in _FORMS] + [f"SELECT 'any_form', count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(p for _, p in _FORMS)})([^a-z0-9]|$)')) FROM docs"])),
    "highlight": _with("docs", {"e": "SELECT document_id, text, strpos(lower(text), 'adults') AS k FROM docs"}, "SELECT document_id, CASE WHEN k > 0 THEN {0} || '<mark>' || {1} || '</mark>' || {2} ELSE {3} END AS marked FROM e".format(*[f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')" for x in ("substr(text, 1, k - 1)", "substr(text, k, 6)", "substr(text, k + 6)", "text")])),
    "word_positions": _with("tok", {}, "SELECT document_id, segment_id, word_index, global_word_index, text, char_start, char_end, g_start, g_end FROM tok"),
    "word_sentence": _with("tok", {}, "SELECT document_id, segment_id, word_index, sentence_index FROM tok"),
    "postings": _with("tok", {}, "SELECT term, document_id, segment_id, word_index, g_start, g_end FROM tok"),
    "inverted_index": _with("tok", {}, "SELECT term, count(DISTINCT document_id) AS document_frequency, count(*) AS total_frequency FROM tok GROUP BY 1"),
    "posting_lists": _with("tok", {}, "SELECT term, document_id, count(*) AS frequency, string_agg(global_word_index::VARCHAR, ' ' ORDER BY global_word_index) AS positions FROM tok GROUP BY 1, 2"),
    "hit_metadata": _with("tok", {"exact": _HITS["exact"]}, "SELECT document_id, char_start, title, journal, doc_type FROM exact JOIN documents ON doc_id::VARCHAR = document_id"),
    "last_page": _with("tok", _HITS, "SELECT document_rank, document_id, total_count FROM by_doc WHERE (document_rank - 1) // 10 = (SELECT (max(document_rank) - 1) // 10 FROM by_doc)"),
    "lookup_term": _with("tok", {}, f"SELECT document_id, segment_id, word_index, g_start FROM tok WHERE term = '{WORD}'"),
    "validate_index": _with("tok", {}, f"SELECT words, postings, words = postings AS equal FROM (SELECT sum(len(regexp_extract_all(text, '{_P}')))::BIGINT AS words FROM seg), (SELECT count(*) AS postings FROM tok)"),
    "validate_positions": _with("tok", {"p": "SELECT document_id, segment_id, text, char_start, char_end FROM tok UNION ALL SELECT document_id, segment_id, text, char_start, char_end FROM sen"}, "SELECT p.document_id, p.segment_id, p.text AS token FROM p JOIN seg s ON s.document_id = p.document_id AND s.segment_id = p.segment_id WHERE substr(s.text, p.char_start + 1, p.char_end - p.char_start) <> p.text"),
    "index_summary": _with("cb", {}, "SELECT documents, unique_terms, total_terms, round(total_terms / documents, 6) AS average_terms FROM (SELECT count(DISTINCT document_id) AS documents, count(DISTINCT term) AS unique_terms, sum(n)::BIGINT AS total_terms FROM cb)"),
    "corpus_hash": _with("docs", {"h": "SELECT sha256(concat_ws(chr(31), document_id, text)) AS h FROM docs"}, "SELECT sha256(count(*) || '-' || " + " || '-' || ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT)::VARCHAR" for k in range(4)) + ") AS corpus_hash FROM h"),
    "zipf_table": _with("b", {}, f"SELECT rank, term, frequency, round(probability, 12) AS probability, rank * frequency AS rank_frequency, round(log10(rank), 9) AS log_rank, round(log10(frequency), 9) AS log_frequency FROM ({_zipf('b')})"),
    "zipf_regression": _with("b", {"z": _zipf("b")}, _fit("z", "condition")),
    "zipf_by_condition": _with("stats", {"z": _zipf("stats")}, _fit("z", "condition")),
    "zipf_regions": _with("b", {"z0": _zipf("b"), "z": _regions("z0")}, _fit("z", "condition, region")),
    "region_compare": _with("stats", {"z0": _zipf("stats"), "z": _regions("z0")}, f"SELECT condition, region, rank_start, rank_end, zipf_exponent, r_squared, rmse FROM ({_fit('z', 'condition, region')})"),
    "best_region": _with("stats", {"z0": _zipf("stats"), "z": _regions("z0")}, f"SELECT condition, region FROM ({_fit('z', 'condition, region')}) WHERE r_squared IS NOT NULL QUALIFY row_number() OVER (PARTITION BY condition ORDER BY r_squared DESC, rmse, rank_start) = 1"),
    "freq_summary": _with("stats", {}, "SELECT condition, sum(cf)::BIGINT AS total_tokens, count(*) AS vocabulary, count(*) FILTER (cf = 1) AS singletons, round(count(*) FILTER (cf = 1) / count(*), 9) AS singleton_ratio, first(term ORDER BY cf DESC, term) AS most_common, max(cf) AS most_common_frequency FROM stats GROUP BY 1"),
    "freq_spectrum": _with("b", {}, "SELECT cf AS frequency, count(*) AS terms FROM b GROUP BY 1"),
    "condition_summary": _with("stats", {}, _COUNT4),
    "cf_df": _with("stats", {}, "SELECT condition, term, cf, df FROM stats"),
    "doc_token_counts": _with("counts", {}, "SELECT condition, document_id, sum(n)::BIGINT AS tokens, count(*) AS types FROM counts GROUP BY 1, 2"),
    "preprocess_compare": _with("stats", {"s": _COUNT4}, "SELECT condition, total_tokens, vocabulary, total_tokens - first_value(total_tokens) OVER (ORDER BY condition) AS change_from_a, total_tokens - lag(total_tokens) OVER (ORDER BY condition) AS change_from_previous FROM s"),
    "porter_corpus": _with("cbs", {}, "SELECT vocabulary, stemmed_vocabulary, round(1 - stemmed_vocabulary / vocabulary, 6) AS reduction_ratio FROM (SELECT count(DISTINCT term) AS vocabulary FROM cb), (SELECT count(DISTINCT term) AS stemmed_vocabulary FROM cbs)"),
    "porter_zipf": _with("cbs", {"st": "SELECT 'original' AS condition, term, sum(n)::BIGINT AS cf FROM cb GROUP BY 2 UNION ALL SELECT 'stemmed', term, sum(n)::BIGINT FROM cbs GROUP BY 2", "z": _zipf("st")}, _fit("z", "condition")),
    "porter_demo": _with("cd", {}, "SELECT * FROM (SELECT sum(n)::BIGINT AS tokens_before, count(DISTINCT term) AS types_before FROM cc), (SELECT sum(n)::BIGINT AS tokens_after, count(DISTINCT term) AS types_after FROM cd)"),
    "ad_summary": _with("stats", {"s": _COUNT4, "z": _zipf("stats")}, f"SELECT condition, total_tokens, vocabulary, average_tokens, zipf_exponent, r_squared, rmse FROM s JOIN ({_fit('z', 'condition')}) USING (condition)"),
    "top_terms": _with("stats", {}, "SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY cf DESC, term) AS rank, term, cf FROM stats QUALIFY rank <= 50"),
    "cf_df_top": _with("stats", {}, "SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY cf DESC, df DESC, term) AS rank, term, cf, df FROM stats QUALIFY rank <= 20"),
    "idf_top": _with("stats nd", {}, "SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY cf DESC, df DESC, term) AS rank, term, round(log10(nd / df), 9) AS idf FROM stats, nd QUALIFY rank <= 10"),
    "idf": _with("b nd", {}, "SELECT term, round(log10(nd / df), 9) AS idf10, round(ln(nd / df) / ln(2.0), 9) AS idf2 FROM b, nd"),
    "term_statistics": _with("b nd", {}, _rows("term,", "b")),
    "term_stats_all": _with("stats nd", {}, _rows("condition, term,", "stats")),
    "term_lookup": _with("b nd", {"a": "SELECT pos, t.term, coalesce(cf, 0) AS cf, coalesce(df, 0) AS df FROM (VALUES (0, 'adults'), (1, 'obesity'), (2, 'nosuchterm')) t(pos, term) LEFT JOIN b USING (term)"}, _rows("pos, term,", "a")),
    "term_across_conditions": _with("stats", {}, "SELECT k.condition, coalesce(cf, 0) AS cf, coalesce(df, 0) AS df FROM (VALUES ('A_basic'), ('B_no_punctuation'), ('C_no_stopwords'), ('D_porter')) k(condition) LEFT JOIN (SELECT * FROM stats WHERE term = 'patients') s ON s.condition = k.condition"),
    "doc_tfidf": _with("b nd", {}, "SELECT document_id, term, n::DOUBLE AS tf, round(log10(nd / df), 9) AS idf, round(n * log10(nd / df), 9) AS tf_idf FROM cb JOIN b USING (term), nd"),
    "doc_tfidf_norm": _with("b nd", {"f": "SELECT *, n / sum(n) OVER (PARTITION BY document_id) AS tf FROM cb"}, "SELECT document_id, term, round(tf, 9) AS tf, round(log10(nd / df), 9) AS idf, round(tf * log10(nd / df), 9) AS tf_idf FROM f JOIN b USING (term), nd"),
    "tfidf_top": _with("b nd", {"f": "SELECT document_id, term, round(n * log10(nd / df), 9) AS tf_idf FROM cb JOIN b USING (term), nd"}, "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY tf_idf DESC, term) AS rank, term, tf_idf FROM f QUALIFY rank <= 10"),
    "significant_words": _with("b nd", {}, f"SELECT significance_rank, frequency_rank, term, cf, df, score FROM ({_significant('b')})"),
    "significant_all": _with("stats nd", {}, f"SELECT condition, significance_rank, frequency_rank, term, score FROM ({_significant('stats')})"),
    "significant_window": _with("b nd", {"z": _zipf("b")}, "SELECT rank, term, frequency, round(log10(nd / df), 4) AS idf FROM z JOIN b USING (term), nd WHERE rank BETWEEN 100 AND 300"),
    "resolving_curve": _with("b", {"z": _zipf("b"), "v": "SELECT rank, CASE WHEN rank <= 275 THEN 1 / (1 + pow((275 - rank) / (225 / 1.35::DOUBLE), 2.2)) ELSE 1 / (1 + pow((rank - 275) / (225 / 0.90::DOUBLE), 1.8)) END AS v FROM z"}, "SELECT rank, round(v / max(v) OVER (), 9) AS resolving_power FROM v"),
    "top50_windows": _with("b", {"z": _zipf("b")}, 'SELECT rank, term, frequency, (rank - 1) // 10 AS "window" FROM z WHERE rank <= 50'),
    "representative_terms": _with("b", {
        "a": "SELECT * FROM (VALUES (0, 'obesity', 0, 'obesity'), (1, 'agonists', 0, 'agonists'), (1, 'agonists', 1, 'agonist'), (2, 'adults', 0, 'adults'), (3, 'studies', 0, 'studies'), (3, 'studies', 1, 'study'), (4, 'liver', 0, 'liver'), (5, 'randomised', 0, 'randomised'), (5, 'randomised', 1, 'randomized'), (6, 'weeks', 0, 'weeks'), (7, 'zzz', 0, 'zzz'), (7, 'zzz', 1, 'zzzz'), (7, 'zzz', 2, 'diabetes'), (10, 'pressure', 0, 'pressure'), (11, 'neverseen', 0, 'neverseen'), (12, 'body', 0, 'body')) t(k, asked, choice, term)",
        "c": "SELECT k, asked, term, cf, df FROM a JOIN b USING (term) QUALIFY row_number() OVER (PARTITION BY k ORDER BY choice) = 1",
        "r": "SELECT 1000 AS k, NULL AS asked, term, cf, df FROM b WHERE term NOT IN (SELECT term FROM c) AND term NOT IN ('and', 'the', 'of', 'in', 'to', 'a', 'with', 'for', 'that', 'is', 'were', 'was', 'are', 'as', 'by', 'on', 'or', 'from', 'at', 'be', 'their', 'not', 'an', 'have', 'has', 'this', 'these')",
    }, "SELECT row_number() OVER (ORDER BY k, cf DESC, term) - 1 AS priority, asked, term, cf, df FROM (SELECT * FROM c UNION ALL SELECT * FROM r) QUALIFY priority < 12"),
    "domain_compare": _with("tc", {"t": "SELECT source AS condition, term, count(*) AS cf FROM tc WHERE source IN ('pubmed_batch', 'web_crawl') GROUP BY 1, 2", "z": _zipf("t"), "f": _fit("z", "condition"), "s": "SELECT condition, sum(cf)::DOUBLE AS tokens, count(*)::DOUBLE AS vocabulary FROM t GROUP BY 1", "n": "SELECT source AS condition, count(DISTINCT document_id)::DOUBLE AS documents FROM tc GROUP BY 1", "m": "SELECT condition, unnest([{'m': 'documents', 'v': documents}, {'m': 'tokens', 'v': tokens}, {'m': 'vocabulary', 'v': vocabulary}, {'m': 'average_tokens', 'v': round(tokens / documents, 6)}, {'m': 'zipf_exponent', 'v': zipf_exponent}, {'m': 'r_squared', 'v': r_squared}, {'m': 'rmse', 'v': rmse}]) AS x FROM s JOIN n USING (condition) JOIN f USING (condition)"}, "SELECT x.m AS measure, max(x.v) FILTER (condition = 'pubmed_batch') AS pubmed_batch, max(x.v) FILTER (condition = 'web_crawl') AS web_crawl FROM m GROUP BY 1"),
    "domain_top_terms": _with("tc", {"t": "SELECT source AS domain, term, count(*) AS cf FROM tc WHERE source IN ('pubmed_batch', 'web_crawl') GROUP BY 1, 2"}, "SELECT domain, term, cf, row_number() OVER (PARTITION BY domain ORDER BY cf DESC, term) AS rank FROM t QUALIFY rank <= 10"),
    "detect_query_type": f"SELECT item_id, n AS n_tokens, CASE WHEN n <= 1 THEN 'word' WHEN regexp_matches(rtrim(answer), '[.!?]$') OR n >= 8 THEN 'sentence' ELSE 'phrase' END AS query_type FROM (SELECT item_id, answer, len(regexp_extract_all(answer, '{_P}')) AS n FROM eval_item)",
    "search_exact_word": _with("tok", {}, f"SELECT document_id, segment_id, 'exact' AS match_type, 'exact_word' AS match_method, 1.0::DOUBLE AS similarity, global_word_index AS word_position, g_start AS char_start, g_end AS char_end FROM tok WHERE surface = '{_q0}'"),
    "search_related_word": _with("tok", {}, f"SELECT document_id, segment_id, 'related' AS match_type, CASE WHEN base = '{_b0}' THEN 'lexical_variant' ELSE 'prefix_related' END AS match_method, CASE WHEN base = '{_b0}' THEN 1.0::DOUBLE ELSE round(least(length(base), {len(_b0)})::DOUBLE / greatest(length(base), {len(_b0)}), 4) END AS similarity, global_word_index AS word_position, g_start AS char_start, g_end AS char_end FROM tok WHERE surface <> '{_q0}' AND (base = '{_b0}' OR starts_with(base, '{_b0}') OR (length(base) >= 4 AND starts_with('{_b0}', base)))"),
    "search_exact_phrase": _with("tok", {}, f"SELECT document_id, segment_id, 'exact' AS match_type, 'exact_phrase' AS match_method, 1.0::DOUBLE AS similarity, word_position, char_start, char_end FROM ({_run(PHRASE)})"),
    "search_related_phrase": _with("tok", {"occ": _occ(WEEKS)}, _near(WEEKS, 2)),
    "search_exact_sentence": _with("tok", {}, f"SELECT document_id, segment_id, 'exact' AS match_type, 'exact_sentence' AS match_method, 1.0::DOUBLE AS similarity, word_position, s.g_start AS char_start, s.g_end AS char_end FROM ({_run(WHOLE)}) r JOIN sen s USING (document_id, segment_id, sentence_index) WHERE len(regexp_extract_all(s.text, '{_P}')) = {len(WHOLE)}"),
    "search_approx_sentence": _with("tok", {"occ": _occ(APPROXIMATE)}, _ordered(APPROXIMATE, 2)),
    "search_literal": _with("tok", {}, _literal(LITERAL)),
    "search_auto": _with("tok", {}, f"SELECT document_id, segment_id, match_method, word_position, char_start, char_end FROM ({_literal(AUTO)})"),
    "unique_hits": _with("tok", {k: _HITS[k] for k in ("occ", "exact", "related")}, "SELECT document_id, segment_id, match_method, char_start, char_end FROM exact UNION ALL SELECT document_id, segment_id, match_method, char_start, char_end FROM related"),
    "anti_overlap": _with("tok", {"occ": _occ(OVERLAPPING), "exact": _HITS["exact"].replace(_run(PHRASE), _run(OVERLAPPING)), "related": _near(OVERLAPPING, 2), "apart": _HITS["apart"]}, "SELECT document_id, segment_id, match_method, similarity, char_start, char_end FROM apart"),
    "ranked_hits": _with("tok", {k: v for k, v in _HITS.items() if k != "by_doc"}, "SELECT result_rank, document_id, match_type, char_start, char_end FROM hits"),
    "hit_context": _with("tok", {k: _HITS[k] for k in ("occ", "exact")}, f"SELECT h.document_id, h.char_start, h.char_end, substr(g.text, (h.char_start - g.seg_start + 1)::BIGINT, (h.char_end - h.char_start)::BIGINT) AS matched_text, s.text AS context FROM exact h JOIN seg g ON g.document_id = h.document_id AND g.segment_id = h.segment_id {_CONTEXT}").replace("h.char_start, h.char_end, substr", "h.char_start, substr"),
    "search_results": _with("tok", {k: v for k, v in _HITS.items() if k != "by_doc"}, f"SELECT result_rank, h.document_id, match_type, similarity, h.char_start, h.char_end, s.text AS context FROM hits h {_CONTEXT}"),
    "doc_results": _with("tok", _HITS, "SELECT * FROM by_doc"),
    "search_summary": _with("tok", {k: v for k, v in _HITS.items() if k != "by_doc"}, "SELECT count(DISTINCT document_id) AS documents_found, count(*) FILTER (match_type = 'exact') AS exact_results, count(*) FILTER (match_type <> 'exact') AS related_results, count(*) AS total_results FROM hits"),
    "results_page": _with("tok", _HITS, "SELECT document_rank, document_id, total_count FROM by_doc WHERE document_rank BETWEEN 11 AND 20"),
    "spell_vocab": _with("vocab", {}, "SELECT surface, cf FROM vocab"),
    "edit_distance": _with("vocab", {}, "SELECT surface, levenshtein(regexp_replace(surface, '[^\\x00-\\x7F]', '~', 'g'), 'patient') AS distance FROM vocab"),
    "spell_candidates": _with("vocab asked", {}, f"SELECT * FROM ({_CANDIDATES}) WHERE rank <= 5"),
    "spell_correct": _with("vocab asked", {"cand": _CANDIDATES}, f"SELECT pos, token, known, corrected FROM ({_FIXED})"),
    "spell_rows": _with("vocab asked", {"cand": _CANDIDATES}, f"SELECT token, corrected AS suggestion, coalesce(distance, 0) AS distance FROM ({_FIXED})"),
    "spell_query": _with("vocab asked", {"cand": _CANDIDATES}, f"SELECT string_agg(corrected, ' ' ORDER BY pos) AS corrected_query FROM ({_FIXED})"),
    "vec_most_similar": _with("vec", {"sim": _similar(-1)}, f"SELECT * FROM ({_RANKED}) WHERE rank <= 10"),
    "vec_similarity": _with("vec", {}, f"SELECT p.id AS a, q.id AS b, round(list_cosine_similarity(p.v, q.v), 6) AS similarity FROM vec p JOIN vec q ON p.id <> q.id WHERE p.id % 20 = 0 AND (q.id % 20 <> 0 OR p.id < q.id)"),
    "expand_word": _with("vec", {"sim": _similar(0.3)}, f"SELECT * FROM ({_RANKED}) WHERE rank <= 5"),
    "expand_query": _with("vec", {"sim": _similar(0.1)}, f"SELECT query, neighbour, similarity, rank FROM ({_RANKED}) WHERE rank <= 3 AND neighbour % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY neighbour ORDER BY query, rank) = 1"),
    "w2v_sentences": _with("tok", {}, f"SELECT {_PLACE}, string_agg(surface, ' ' ORDER BY word_index) AS words FROM tok GROUP BY {_PLACE} HAVING count(*) >= 2"),
    "batch_ids": "WITH i AS (SELECT regexp_replace(pmid, '[^0-9]', '', 'g') AS id, min(record_id) AS pos FROM structured_document WHERE pmid IS NOT NULL GROUP BY 1) SELECT id, (row_number() OVER (ORDER BY pos, id) - 1) // 100 AS batch FROM i WHERE id <> ''",
    "missing_ids": "SELECT DISTINCT regexp_replace(pmid, '[^0-9]', '', 'g') AS id FROM structured_document WHERE regexp_replace(pmid, '[^0-9]', '', 'g') <> '' AND regexp_replace(pmid, '[^0-9]', '', 'g') NOT IN (SELECT regexp_replace(document_id, '[^0-9]', '', 'g') FROM processed_document)",
}
_RECORDS = "SELECT DISTINCT filename || '#' || lpad(record_id::VARCHAR, 12, '0') AS name, trim(coalesce(pmid, '')) AS p, pmid, trim(array_to_string(coalesce(abstract_paragraphs_clean, []), chr(10))) AS a, lower(trim(coalesce(language, ''))) AS l FROM structured_document"
_DECIDED = "SELECT *, CASE WHEN p = '' THEN 'missing_pmid' WHEN coalesce(sum(CASE WHEN a <> '' AND (l = '' OR starts_with(l, 'en')) THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'duplicate_pmid' WHEN a = '' THEN 'missing_abstract' WHEN l <> '' AND NOT starts_with(l, 'en') THEN 'non_english' END AS reason FROM r"
ORACLE["corpus_audit"] = f"WITH r AS ({_RECORDS}), d AS ({_DECIDED}) SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS records FROM d GROUP BY 1"
ORACLE["corpus_accept"] = f"WITH r AS ({_RECORDS}), d AS ({_DECIDED}) SELECT name, pmid FROM d WHERE reason IS NULL ORDER BY name LIMIT 100"
_IDS_IN = (
    "t AS (SELECT record_id, concat_ws(chr(10), 'PMID= ' || pmid, title, ' ' || pmid || ',') AS x FROM (SELECT DISTINCT record_id, pmid, title FROM structured_document)), "
    "f AS (SELECT record_id, x, list_concat(list_concat(regexp_extract_all(x, '(?i)\\bPMID\\s*[:#=]?\\s*([0-9]+)\\b', 1), regexp_extract_all(x, '(?i)pubmed\\.ncbi\\.nlm\\.nih\\.gov/([0-9]+)', 1)), regexp_extract_all(x, '(?m)^[ \\t\\r\\f]*[,;]*([0-9]+)[,;]*[ \\t\\r\\f]*$', 1)) AS found FROM t), "
    "g AS (SELECT record_id, CASE WHEN len(found) > 0 THEN found ELSE regexp_extract_all(x, '\\b([0-9]{5,10})\\b', 1) END AS found FROM f), "
    "h AS (SELECT record_id, unnest(found) AS id, generate_subscripts(found, 1) AS k FROM g)"
)
ORACLE["extract_ids"] = f"WITH {_IDS_IN} SELECT record_id, id, row_number() OVER (PARTITION BY record_id ORDER BY min(k)) - 1 AS pos FROM h GROUP BY record_id, id"
_WRITTEN = (
    "w AS (SELECT CASE WHEN source_format = 'JATS' AND search_scope IS NULL THEN 'GenericXML' ELSE source_format END AS kind, trim(coalesce(pmid, '')) AS p, "
    f"list_filter(abstract_paragraphs_clean, lambda x: x IS NOT NULL AND trim(regexp_replace(x, '[{_SPACE}]+', ' ', 'g')) <> '') AS l FROM (SELECT DISTINCT * FROM structured_document) WHERE len(abstract_paragraphs_clean) > 0)"
)
ORACLE["parse_detect"] = f"WITH {_WRITTEN} SELECT CASE WHEN kind = 'PubMed' AND p = '' THEN 'unreadable' ELSE kind END AS source_format, count(*) AS files FROM w GROUP BY 1"
ORACLE["parse_sections"] = f"WITH {_WRITTEN} SELECT kind AS source_format, CASE WHEN kind = 'GenericXML' THEN 0 ELSE len(l) END AS sections, count(*) AS files FROM w WHERE NOT (kind = 'PubMed' AND p = '') GROUP BY 1, 2"
_ANY = "regexp_matches(lower(text), '(^|[^a-z0-9])(" + "|".join(p for _, p in _FORMS) + ")([^a-z0-9]|$)')"
ORACLE["pattern_coverage"] = _with("docs", {}, f"SELECT count(*) AS documents, count(*) FILTER ({_ANY}) AS matched, round(count(*) FILTER ({_ANY}) / count(*), 6) AS share, count(*) FILTER (NOT {_ANY}) AS unmatched FROM docs")
ORACLE["unmatched_preview"] = _with("docs", {}, f"SELECT document_id, substr(text, 1, 500) AS preview FROM docs WHERE NOT {_ANY} ORDER BY document_id LIMIT 10")
ORACLE["custom_stopwords"] = _with("tb", {}, "SELECT term, count(*) AS cf, count(DISTINCT document_id) AS df FROM tb WHERE term NOT IN ('the', 'of', 'adults') GROUP BY 1")
ORACLE["report_fit"] = _with("b", {"z": _zipf("b")}, f"SELECT condition, n, zipf_exponent, r_squared, rmse FROM ({_fit('z', 'condition')})")
ORACLE["porter_pairs"] = _with(
    "ca cb cc stem_of",
    {
        "pa0": "SELECT term, regexp_extract_all(term, '[^/''’‐‑‒–—-]+|[/''’‐‑‒–—-]+') AS p FROM (SELECT DISTINCT term FROM ca)",
        "pa": "SELECT term, generate_subscripts(p, 1) AS i, unnest(p) AS word FROM pa0",
        "sa": _stems("SELECT word FROM pa"),
        "soa": "SELECT term, replace(string_agg(stem, '' ORDER BY i), '’', chr(39)) AS stem FROM pa JOIN sa USING (word) GROUP BY term",
        "x": "SELECT 'A_basic' AS condition, document_id, term, n, stem FROM ca LEFT JOIN soa USING (term) UNION ALL SELECT 'B_no_punctuation', document_id, term, n, stem FROM cb LEFT JOIN stem_of USING (term) UNION ALL SELECT 'C_no_stopwords', document_id, term, n, stem FROM cc LEFT JOIN stem_of USING (term)",
        "y": "SELECT condition, count(DISTINCT document_id) AS documents, sum(n)::BIGINT AS tokens_before, sum(n) FILTER (stem <> '')::BIGINT AS tokens_after, count(DISTINCT term) AS vocabulary_before, count(DISTINCT stem) FILTER (stem <> '') AS vocabulary_after FROM x GROUP BY 1",
    },
    "SELECT *, vocabulary_before - vocabulary_after AS reduction, round((vocabulary_before - vocabulary_after) / vocabulary_before, 6) AS reduction_ratio FROM y",
)
