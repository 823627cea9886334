"""Stems of all words of the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.functions.stem import porter_stem
from phenospark.plans import records as R


def q_k5p_word_stems(spark, sf):
    """Each distinct word of ``documents`` with its number and stem: words are counted
    first, so a word is stemmed once."""
    words = R.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", porter_stem(F.col("word")).alias("stem"))


# the measure m of a stem: its letters written as consonants (c) and vowels (v), and the vc counted
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"(?:{_C})?{_V}{_C}"
_M1 = _M0 + _V + _C
_SHORT = f"{_C}[aeiouy][^aeiouwxy]"


def _rules(pairs: str, condition: str) -> str:
    """CASE over ``suffix:new`` pairs, given longest first."""
    whens = []
    for pair in pairs.split():
        suffix, new = pair.split(":")
        ends = "[st]ion$" if suffix == "ion" else suffix + "$"
        whens.append(f"WHEN regexp_matches(w, '{ends}') THEN regexp_replace(w, '^({condition}.*){suffix}$', '\\1{new}')")
    return "CASE " + " ".join(whens) + " ELSE w END"


_TWO = _rules("ational:ate ization:ize iveness:ive fulness:ful ousness:ous tional:tion biliti:ble entli:ent ousli:ous ation:ate alism:al "
              "aliti:al iviti:ive enci:ence anci:ance izer:ize abli:able alli:al ator:ate eli:e", _M0)
_THREE = _rules("icate:ic ative: alize:al iciti:ic ical:ic ness: ful:", _M0)
_FOUR = _rules("ement: ance: ence: able: ible: ment: ant: ent: ion: ism: ate: iti: ous: ive: ize: al: er: ic: ou:", _M1)

SQL_K5P = f"""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
     d AS MATERIALIZED (SELECT word, count(*) AS n FROM t GROUP BY word),
     s0 AS (SELECT word, n, regexp_replace(word, '^y', 'Y') AS w FROM d),
     s1 AS (SELECT word, n, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%ss' THEN w
                                 WHEN w LIKE '%s' THEN left(w, -1) ELSE w END AS w FROM s0),
     s2 AS (SELECT word, n, w, NOT w LIKE '%eed' AND regexp_matches(w, '^(?:{_C})?[aeiouy].*(ed|ing)$') AS cut FROM s1),
     s3 AS (SELECT word, n, cut, CASE WHEN cut THEN regexp_replace(w, '(ed|ing)$', '')
                                      ELSE regexp_replace(w, '^({_M0}.*)eed$', '\\1ee') END AS w FROM s2),
     s4 AS (SELECT word, n, CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
                                 WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND regexp_matches(w, '[^aeiouylsz]$') THEN left(w, -1)
                                 WHEN regexp_matches(w, '^{_SHORT}$') THEN w || 'e' ELSE w END AS w FROM s3),
     s5 AS (SELECT word, n, regexp_replace(w, '^((?:{_C})?[aeiouy].*)y$', '\\1i') AS w FROM s4),
     s6 AS (SELECT word, n, {_TWO} AS w FROM s5),
     s7 AS (SELECT word, n, {_THREE} AS w FROM s6),
     s8 AS (SELECT word, n, {_FOUR} AS w FROM s7),
     s9 AS (SELECT word, n, CASE WHEN regexp_matches(w, '^{_M0}.*e$') AND NOT regexp_matches(w, '^{_SHORT}e$') THEN left(w, -1) ELSE w END AS w FROM s8)
SELECT word, n::BIGINT AS n, CASE WHEN length(word) < 3 THEN word
                                  WHEN w LIKE '%ll' AND regexp_matches(w, '^{_M1}') THEN lower(left(w, -1)) ELSE lower(w) END AS stem
FROM s9
"""

QUERIES = {"k5p_word_stems": q_k5p_word_stems}
ORACLES = {"k5p_word_stems": SQL_K5P}
