"""Porter's stems (M. F. Porter 1980) as a column expression.

The measure of a stem, its number of vowel-consonant groups, is part of each rule's
pattern, so a rule is one anchored replacement.  In a step the longest suffix that
matches decides, whether its condition holds or not.  A step's word is bound by a
one-element array, so the expression grows with the rules and not with their product.

Defined cases: words of one or two letters stay, upper case is lowered, null stays null;
characters beyond a-z count as consonants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes and replacements of the published steps 2 to 4.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize"]

# A y is a consonant at the word's start (written Y below) and behind a vowel.
_CONSONANTS = "[^aeiou][^aeiouy]*"
_VOWELS = "[aeiouy][aeiou]*"
HAS_VOWEL = f"(?:{_CONSONANTS})?[aeiouy]"
ABOVE_0 = f"(?:{_CONSONANTS})?{_VOWELS}{_CONSONANTS}"
ABOVE_1 = ABOVE_0 + _VOWELS + _CONSONANTS
#: One group, ending consonant, vowel, consonant (not w, x, y).
SHORT = f"{_CONSONANTS}[aeiouy][^aeiouwxy]"


def _bound(word: Column, step) -> Column:
    return F.element_at(F.transform(F.array(word), step), 1)


def _longest(word: Column, rules, condition: str, before=lambda suffix: "") -> Column:
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        hit, changed = word.rlike(before(suffix) + suffix + "$"), F.regexp_replace(word, f"^({condition}.*){suffix}$", "$1" + new)
        out = F.when(hit, changed) if out is None else out.when(hit, changed)
    return out.otherwise(word)


def _plurals(w: Column) -> Column:
    return F.when(w.rlike("(ss|i)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)


def _mended(s: Column) -> Column:
    return (F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e")))
            .when(s.rlike(r"([^aeiouylsz])\1$"), F.regexp_replace(s, ".$", ""))
            .when(s.rlike(f"^{SHORT}$"), F.concat(s, F.lit("e"))).otherwise(s))


def _past(w: Column) -> Column:
    return (F.when(w.rlike("eed$"), F.regexp_replace(w, f"^({ABOVE_0}.*)eed$", "$1ee"))
            .when(w.rlike(f"^{HAS_VOWEL}.*(ed|ing)$"), _bound(F.regexp_replace(w, "(ed|ing)$", ""), _mended)).otherwise(w))


def _final_e(w: Column) -> Column:
    return F.when(w.rlike(f"^{ABOVE_0}.*e$") & ~w.rlike(f"^{SHORT}e$"), F.regexp_replace(w, "e$", "")).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.rlike(f"^{ABOVE_1}") & w.rlike("ll$"), F.regexp_replace(w, "l$", "")).otherwise(w)


def porter_stem(word: Column) -> Column:
    word = F.lower(word)
    out = F.regexp_replace(word, "^y", "Y")
    for step in (_plurals, _past, lambda w: F.regexp_replace(w, f"^({HAS_VOWEL}.*)y$", "$1i"),
                 lambda w: _longest(w, STEP_2, ABOVE_0), lambda w: _longest(w, STEP_3, ABOVE_0),
                 lambda w: _longest(w, [(s, "") for s in STEP_4], ABOVE_1, lambda s: "[st]" if s == "ion" else ""),
                 _final_e, _final_l):
        out = _bound(out, step)
    return F.when(F.length(word) < 3, word).otherwise(F.lower(out))
