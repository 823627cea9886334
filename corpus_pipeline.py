"""A training corpus from ``documents``: toxic documents go, repeated line chunks
and passages of two lines or more are cut, one document of each near-duplicate group stays, contaminated documents
go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  A stage works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.llm.common import shared_folder, written
from phenospark.llm.decontaminate import contamination
from phenospark.llm.jaccard import jaccard_links
from phenospark.llm.linechunks import A_WORD, without_repeated_chunks, without_repeated_passages
from phenospark.llm.queries import TOXIC_FROM, packed, toxicity_of


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` that aren't in ``gone`` (``doc_id``, ``key``: a hash of the
    text, null as empty).  Rows that share id and text are one document."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("k"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    same = F.col("d.k").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h") == F.col("o.key"))
    return keyed.alias("d").join(gone.select("doc_id", "key").distinct().alias("o"), same, "left_anti").select("doc.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.filter(F.col("score") >= TOXIC_FROM))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, wherever chunks would end, then the chunks of what is left
    (chunks first would leave single lines of a passage, which nothing judges).  Lines
    without a word are no passage: paragraph breaks stay."""
    whole = written(without_repeated_passages(docs), shared_folder(spark, "line_dedup"), "passages")
    cut = without_repeated_chunks(whole, worded=True).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class stays.  Wordless documents, which have no
    links, are a class where their texts are equal (null texts are one too): copies
    that line_dedup emptied leave one row."""
    found = jaccard_links(docs).filter(~F.col("leader")).select("doc_id", "key")
    wordless = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .filter(~F.coalesce("text", F.lit("")).rlike(A_WORD)) \
        .withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    # minima are taken before the shuffle; the rest meets by id and text, so a large group is spread
    first = wordless.groupBy("text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("x")) \
        .select("x.doc_id", "x.key")
    same = F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.key") == F.col("f.key"))
    later = wordless.alias("w").join(first.alias("f"), same, "left_anti").select("doc_id", "key")
    return _without(docs, found.unionByName(later))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any hit word go."""
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: The classifier and the tokenizer can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
