"""Keyword-list phenotypes (C17, K11): a list of keyword patterns becomes
named keyword categories (curated like a codelist), one keyword criterion
per category, then case resolution.  Keywords are matched through an index of their
literals (:mod:`phenospark.operators.keyword_index`), so a list may have any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.functions import text as TX
from phenospark.functions.cells import q
from phenospark.operators import codelists as K
from phenospark.operators import criteria as C
from phenospark.operators.keyword_index import keyword_flags, keyword_matches
from phenospark.plans.steplist import clean_name_expr
from phenospark.session import cut_lineage

# Fixed value: the escaped word-boundary marker removed from stored keywords.
ESCAPED_BOUNDARY = r"\\b"


def keyword_rows(keywords: DataFrame, filename: str = "keywords.csv") -> DataFrame:
    """``keywords(keyword[, row_no])`` -> long codelist rows whose value and
    description are the keyword without the escaped boundary marker; in a
    multi-word description the ignored words are left out."""
    kw = keywords if "row_no" in keywords.columns else keywords.withColumn("row_no", F.monotonically_increasing_id())
    value = F.replace(F.col("keyword"), F.lit(ESCAPED_BOUNDARY), F.lit(""))
    kw = kw.withColumn("_v", value)
    words = F.split(F.col("_v"), " ")
    desc = F.when(F.col("_v").contains(" "),
                  F.array_join(F.filter(words, lambda w: ~TX.ignored(TX.clean_word(w))), " ")).otherwise(F.col("_v"))
    attrs = F.create_map(F.lit("keyword"), F.col("_v"), F.lit("description"), desc)
    return kw.select(F.lit(filename).alias("filename"), "row_no", attrs.alias("attrs"))


def keyword_patterns(keywords: DataFrame, name: str) -> DataFrame:
    """A keyword list as a codelist: ``(category, pattern, row_no)``, categories as
    flag columns spell them."""
    cats = K.categories(keyword_rows(keywords), name)
    return cats.select(clean_name_expr(F.lower("category")).alias("category"), F.col("code").alias("pattern"), "row_no")


def keyword_list_matches(df: DataFrame, keywords: DataFrame, name: str, key: str, cols=None) -> DataFrame:
    """The long form, for lists with any number of categories: distinct ``(key,
    category)`` that are CASE."""
    return keyword_matches(df, keyword_patterns(keywords, name), key, cols)


def evaluate_keyword_list(df: DataFrame, keywords: DataFrame, name: str, cols=None) -> DataFrame:
    """One ``<category>-identified`` column per keyword category, in the order of the
    list, then resolution.  Only the categories' names come to the driver (they are
    the schema); keywords stay a table.  Rows with equal cells have equal flags, so
    flags are joined by a digest of the cells and rows need no key."""
    patterns = cut_lineage(keyword_patterns(keywords, name))
    first = patterns.groupBy("category").agg(F.min("row_no").alias("first"))
    categories = [r["category"] for r in first.orderBy("first", "category").collect()]
    cells = F.to_json(F.struct(*[q(c).cast("string").alias(c) for c in (df.columns if cols is None else cols)]), {"ignoreNullFields": "false"})
    keyed = df.withColumn("_row", F.sha2(cells, 256))
    found = keyword_matches(keyed, patterns, "_row", [c for c in df.columns] if cols is None else cols)
    return C.resolve_cases(keyword_flags(keyed, found, categories, "_row").drop("_row"))
