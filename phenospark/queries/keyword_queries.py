"""Registered queries of keyword lists of any length: patterns out of the texts
themselves, matched through the index of their literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import keyword_index as I
from phenospark.plans import records as R

#: Of so many patterns one has a class and one a group between its words; the others are literal, in either case.
FORMS = 16
#: A document gives its first words, so many pairs.
PAIRS = 24
CATEGORIES = 200


def documents(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", "text")


def word_pair_patterns(spark, sf):
    """``(category, pattern)``: pairs of neighbouring plain words of every document
    (about 20,000 at sf0.01), as regular expressions of three forms."""
    words = F.split(F.coalesce("text", F.lit("")), " ", PAIRS + 2)  # the rest stays one: a word of a pair is not among it
    pairs = F.zip_with(F.slice(words, 1, PAIRS), F.slice(words, 2, PAIRS), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    plain = lambda c: F.col(c).rlike("^[A-Za-z]{2,}$")
    found = (documents(spark, sf).select(F.explode(pairs).alias("p")).select("p.*").where(plain("a") & plain("b"))
             .select(F.lower("a").alias("a"), F.lower("b").alias("b")).distinct())
    number = F.crc32(F.concat_ws(" ", "a", "b").cast("binary"))
    lone = lambda body: F.concat(F.lit("(?<![^ ])"), *body, F.lit("(?![^ ])"))
    form = (F.when(number % FORMS == 0, lone([F.lit("(?:"), F.col("a"), F.lit(" )"), F.col("b")]))
            .when(number % FORMS == 1, lone([F.col("a"), F.lit("[ ]"), F.upper("b")]))
            .otherwise(lone([F.col("a"), F.lit(" "), F.when(number % 2 == 0, F.col("b")).otherwise(F.upper("b"))])))
    return found.select(F.concat(F.lit("c"), (F.length("a") * 20 + F.length("b")) % CATEGORIES).alias("category"), form.alias("pattern"))


def q_c5k_keyword_index(spark, sf):
    return I.keyword_matches(documents(spark, sf), word_pair_patterns(spark, sf), "doc_id", ["text"])


def q_c5k_pattern_counts(spark, sf):
    """How many texts each pattern hits."""
    pats = word_pair_patterns(spark, sf).select(F.col("pattern").alias("pattern_id"), "pattern").distinct()
    texts = documents(spark, sf).select(F.col("doc_id").alias("key"), "text")
    return I.pattern_hits(texts, pats).groupBy(F.col("pattern_id").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


# words as the patterns see them: the text between spaces; case is folded
_PAIRS = f"""
t AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
raw AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, {PAIRS} + 1)) AS i FROM t)),
pats AS (SELECT DISTINCT lower(a) AS a, lower(b) AS b FROM raw WHERE regexp_full_match(a, '[A-Za-z]{{2,}}') AND regexp_full_match(b, '[A-Za-z]{{2,}}')),
two AS (SELECT DISTINCT doc_id, lower(w[i]) AS a, lower(w[i + 1]) AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)),
hits AS (SELECT doc_id, a, b, 'c' || CAST((length(a) * 20 + length(b)) % {CATEGORIES} AS VARCHAR) AS category FROM two JOIN pats USING (a, b))"""
SQL_C5K = f"WITH {_PAIRS} SELECT DISTINCT doc_id, category FROM hits"

QUERIES = {"c5k_keyword_index": q_c5k_keyword_index, "c5k_pattern_counts": q_c5k_pattern_counts}
ORACLES = {"c5k_keyword_index": SQL_C5K}
