"""String rules of codelist curation, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenospark.functions.stem import porter_stem

# ---------------------------------------------------------------------------
# Fixed values that must equal the table model's, in their natural order.
# ---------------------------------------------------------------------------
PRIMARY_CODE_KEYS = ["readcode", "snomedconceptid", "readv2code", "snomedcode", "snomedctconceptid", "conceptcode",
                     "conceptcd", "snomedctcode", "conceptid", "readorsnomedterm"]
SECONDARY_CODE_KEYS = ["icdcode", "icd10code", "icd11code", "opcs4code", "icdcodeuncat", "keyword"]
DESCRIPTION_KEYS = ["description", "conceptname", "proceduredescr", "icd10term", "icd11term", "snomedterm",
                    "icd10codedescr", "icdterm", "readterm", "readcodedescr", "term", "snomedctterm", "name"]
PRIMARY_SYSTEMS = ["read", "snomed", "snomedct"]
SECONDARY_SYSTEMS = ["icd9", "icd10", "cpt", "icd10cm", "icd9cm", "icd9diagnosis", "icd10diagnosis"]
OTHER_SYSTEMS = ["UK Biobank", "TADDS", "HES"]
CONDITION_SYNONYMS = ["syndrome", "infection", "infections", "disease", "diseases", "disorder", "disorders",
                      "malignancy", "status", "diagnosis", "dysfunction", "accident", "difficulty", "symptom",
                      "symptoms"]
IGNORE_WORDS = ["not", "use", "type", "using", "anything", "enjoying"]
SPLIT_PATTERN = r"\s?/\s?|\s?\+\s?|\s?_\s?|\s"
# A three-token description whose middle token is "of" ("A of B" -> "B A").
_SEP = r"(?:\s?/\s?|\s?\+\s?|\s?_\s?|\s)"
A_OF_B = r"^([^\s/+_]*)" + _SEP + "of" + _SEP + r"([^\s/+_]*)$"
NOT_DIFFERENTIATING_CUTOFF = 0.15
SIMILARITY_MATCH = 0.8
MIN_TERM_LENGTH = 5

# Our own stand-in for a part-of-speech tagger (not a table-model value):
# common English conjunctions and prepositions are ignored in names.
FUNCTION_WORDS = ["and", "or", "but", "nor", "yet", "so", "for", "with", "without", "within", "into", "onto", "from",
                  "of", "in", "on", "at", "by", "to", "as", "than", "after", "before", "during", "over", "under",
                  "above", "below", "between", "among", "about", "against", "through", "via", "per", "due", "other",
                  "unspecified", "specified"]
# Our own rule for "looks like an adjective" (a two-word label keeps an
# adjective first and otherwise puts the condition name first).
ADJECTIVE_SUFFIX = r"(ic|al|ous|ive|ful|less|able|ible|ary|ant|ent|ed|ing)$"


def full_clean(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def clean_word(c: Column) -> Column:
    """Step-name cleaner on a column (no '/', no parenthesised tail, no
    commas, '&amp;' -> 'and', spaces -> '-')."""
    c = F.regexp_replace(c, "/", "")
    c = F.regexp_replace(c, r"(\s)?\(.*\)", "")
    c = F.regexp_replace(F.regexp_replace(c, ",", ""), "&amp;", "and")
    return F.regexp_replace(c, " ", "-")


def singular(c: Column) -> Column:
    """Plain plural rule: -ies -> -y (two letters before); -ches/-shes/-xes/
    -sses drop -es; a final -s goes after three letters unless the word ends
    in -ss, -us or -is.  A chain of single-reference replacements, so the
    expression stays linear when the optimizer inlines it."""
    c = F.regexp_replace(c, "([a-z]{2})ies$", "$1y")
    c = F.regexp_replace(c, "(ch|sh|x|ss)es$", "$1")
    return F.regexp_replace(c, "([a-z]{2}[a-hj-rtv-z])s$", "$1")


def ignored(c: Column) -> Column:
    """Words left out of names: short words, condition synonyms, filler."""
    lw = F.lower(c)
    return (F.length(c) <= 2) | lw.isin(CONDITION_SYNONYMS + IGNORE_WORDS + FUNCTION_WORDS)


def split_terms(c: Column) -> Column:
    return F.split(c, SPLIT_PATTERN)


def replace_first(c: Column, literal: str) -> Column:
    esc = "".join("\\" + ch if not ch.isalnum() else ch for ch in literal)
    return F.regexp_replace(c, "^(.*?)" + esc, "$1")


def name_words(name: Column) -> Column:
    """Lower-cased, cleaned words of a phenotype name (empty ones dropped)."""
    return F.filter(F.transform(F.split(F.lower(name), " "), lambda w: F.regexp_replace(clean_word(w), "-", "")),
                    lambda w: w != "")


def related_to_name(term: Column, words: Column) -> Column:
    """A term belongs to the name when it contains, or is contained in, a
    word of the name, or when its stem lies in the stem of one ("diabetic"
    belongs to "diabetes").  Terms have gone through the plural rule, so the
    word they contain may have too ("prediabete" holds "diabete")."""
    # one-element arrays hold the stem, which every word meets
    return F.exists(words, lambda w: F.contains(w, term) | F.contains(term, w) | F.contains(term, singular(w))) | F.exists(
        F.array(porter_stem(term)), lambda st: F.exists(words, lambda w: F.contains(porter_stem(w), st)))


def numbered_bigrams(c: Column) -> Column:
    """Bigrams of a string, each tagged with its occurrence number, so that
    ``array_intersect`` counts a multiset intersection."""
    n = F.length(c) - 1
    bgs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, 2))
    bgs = F.when(n >= 1, bgs).otherwise(F.array().cast("array<string>"))
    return F.transform(bgs, lambda b, i: F.concat(b, F.lit("#"), F.size(F.filter(F.slice(bgs, 1, i + 1), lambda x: x == b)).cast("string")))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram multisets (whitespace ignored): equal
    strings give 1, strings under two characters give 0."""
    a2, b2 = F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", "")
    inter = F.size(F.array_intersect(numbered_bigrams(a2), numbered_bigrams(b2)))
    denom = F.length(a2) + F.length(b2) - 2
    return (F.when(a2 == b2, F.lit(1.0))
            .when((F.length(a2) < 2) | (F.length(b2) < 2), F.lit(0.0))
            .otherwise(2.0 * inter / denom))
