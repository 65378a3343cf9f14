"""Pure Column functions on text. Everything here stays inside the JVM.

Null in, null out unless a function says otherwise; offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dash class and the search-token pattern define what a term is.
DASHES = "‐‑‒–—-"
TERM_PATTERN = (
    r"\p{Nd}+(?:[.,]\p{Nd}+)*(?:[" + DASHES + r"]\p{Nd}+(?:[.,]\p{Nd}+)*)?(?:%|[A-Za-z]+)?"
    r"|[\p{L}\p{N}]+(?:[.'’/" + DASHES + r"][\p{L}\p{N}]+)*%?"
)


def term_list(text: Column) -> Column:
    """Search tokens of a text, in order, as written."""
    return F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0))


def fold(text: Column) -> Column:
    """Index key of a term: lower case, ``ß`` as ``ss``."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold_list(terms: Column) -> Column:
    """Fold every string of an array in one pass; no term holds the control character used as a seam."""
    seam = "\x01"
    joined = F.split(fold(F.array_join(terms, seam)), seam)
    return F.when(F.size(terms) > 0, joined).otherwise(F.array().cast("array<string>"))


def folded_terms(text: Column) -> Column:
    """Search tokens of a text, folded; an empty list for a null text."""
    return fold_list(term_list(F.coalesce(text, F.lit(""))))


# --- text rules kept as data, so that each engine's SQL can be made from the same list -------------------------

# What counts as white space, and the rules that normalise a text. Pattern, replacement.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NORMAL = [(SPACE + "+", " "), ("^ +| +$", ""), (r" +([,.;:!?%)\]])", "$1"), (r"([(\[]) +", "$1")]
STATISTICS = [*NORMAL, (r"(?: *, *){2,}", ", "), (r"(?: *; *){2,}", "; "), (r"\( *[,;:\-–—]* *\)", ""), (r"\[ *[,;:\-–—]* *\]", ""), *NORMAL]
# Abbreviations behind which no sentence ends.
ABBREVIATIONS = r"(?:Dr|Mr|Mrs|Ms|Prof|St|vs|etc|Fig|al|e\.g|i\.e|[A-Z])"
HELD, CUT = "\x02", "\x01"
_HOLD = (rf"(^| |\()({ABBREVIATIONS})\. ", "$1$2." + HELD)
SENTENCE_MARKS = [_HOLD, _HOLD, (r"([.!?]+[\x{22}\x{27})\]]*) +", "$1" + CUT), (HELD, " ")]

# Fixed value: the stop words of condition C.
STOPWORDS = [
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


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules applied in order."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def normal(text: Column) -> Column:
    """White space collapsed, none before closing and behind opening signs; null as empty."""
    return replaced(F.coalesce(text, F.lit("")), NORMAL)


def normal_statistics(text: Column) -> Column:
    """`normal`, with repeated separators and empty brackets gone."""
    return replaced(F.coalesce(text, F.lit("")), STATISTICS)


def sentence_list(text: Column) -> Column:
    """Sentences of a normalised text, in order; joined by one blank they are the text again."""
    return F.filter(F.split(replaced(text, SENTENCE_MARKS), CUT), lambda s: s != "")


def surface(text: Column) -> Column:
    """Query form of a term: folded, straight apostrophes, trimmed."""
    return F.trim(F.replace(fold(text), F.lit("’"), F.lit("'")))


def lexical_base(term: str) -> str:
    """SQL for the base of a surface form: no possessive, no plural. Reads the same in every engine."""
    t = f"(CASE WHEN right({term}, 2) = '''s' THEN left({term}, length({term}) - 2) ELSE {term} END)"
    return (
        f"(CASE WHEN length({t}) > 4 AND right({t}, 3) = 'ies' THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 4 AND (right({t}, 4) IN ('ches', 'shes') OR right({t}, 3) IN ('xes', 'zes')) THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 3 AND right({t}, 1) = 's' AND right({t}, 2) NOT IN ('ss', 'us', 'is') THEN left({t}, length({t}) - 1) ELSE {t} END)"
    )
