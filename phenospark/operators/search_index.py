"""Substring search over the catalog by an index, page by page (G3 at scale).

``search_definitions`` looks at every definition for every search, and ``offset``
sorts all that was shown before.  Here the catalog is indexed once:

* ``postings``: for each field, the runs of three characters (lower case) of its
  value with the definition's id.  The end of a value is padded, so every position
  starts a run and searches of one or two characters find theirs by prefix.
* Postings are stored by bucket of the run and sorted inside, so a search reads the
  buckets of its own runs (partition pruning) and there the row groups that hold them.
* Definitions that have all runs in one field are candidates; the text itself is
  checked on them alone.
* A page starts after the last (name, id) of the page before (keyset), so no page
  costs more than the first.

Defined cases: null fields hold nothing; the empty text finds everything; case is
ignored as by ``ilike``; ids are unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
BUCKETS = 64
#: Values whose runs in one bucket are a slice of it, sorted by one task.
SLICE_VALUES = 4_000_000
FIELDS = ("name", "about", "user_name")
# Ends a value; not a character of text.
_PAD = "\x01" * (GRAM - 1)


class SearchIndex(NamedTuple):
    folder: str
    schema: T.StructType


def build_search_index(workflow: DataFrame, folder: str, fields: Sequence[str] = FIELDS) -> SearchIndex:
    """Writes the index of ``workflow(id, name, ...)`` to ``folder``: ``rows`` (what
    pages return) and ``postings``."""
    rows = workflow.select("id", *[F.col(c).cast("string").alias(c) for c in dict.fromkeys(("name", *fields))])
    rows.write.mode("errorifexists").parquet(f"{folder}/rows")
    rows = workflow.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    text = F.concat(F.lower("value"), F.lit(_PAD))
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{%d}))" % GRAM), F.lit(1)))
    values = rows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"))
    postings = values.where(F.col("x.value").isNotNull()).select("id", "x.field", "x.value").select("id", "field", F.explode(grams).alias("gram"))
    bucket = (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int")
    # a frequent run is many rows: a bucket's are dealt by id to so many slices, so no task holds all of one
    slices = max(1, -(-rows.count() * len(fields) // SLICE_VALUES))
    place = F.pmod(F.xxhash64("id"), F.lit(slices))
    (postings.withColumn("bucket", bucket).repartition(BUCKETS * slices, "bucket", place).sortWithinPartitions("bucket", "gram", "id")
     .write.partitionBy("bucket").parquet(f"{folder}/postings"))
    return SearchIndex(folder, rows.schema)


def matching_ids(spark: SparkSession, index: SearchIndex, text: str) -> DataFrame:
    """Candidates: ``id`` of definitions with all runs of ``text`` in one field."""
    schema = T.StructType([index.schema["id"], T.StructField("field", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("bucket", T.IntegerType())])
    postings = spark.read.schema(schema).parquet(f"{index.folder}/postings")
    wanted = text.lower()
    if len(wanted) < GRAM:
        return postings.where(F.col("gram").startswith(wanted)).select("id").distinct()
    grams = sorted({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
    held = postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") == len(grams)).select("id").distinct()


def search_page(spark: SparkSession, index: SearchIndex, text: str, limit: int = 100, after: tuple[str, object] | None = None,
                among: DataFrame | None = None, also: str | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The ``limit`` definitions next ``after`` (name, id) whose ``fields`` contain
    ``text``, by name and id.  ``among(id)``: those to choose from (complete,
    top-level, visible ones); ``also``: a second text that must be found too."""
    found = spark.read.schema(index.schema).parquet(f"{index.folder}/rows")
    if after is not None:
        name, at = after
        later = F.col("name").isNotNull() if name is None else F.col("name") > name
        found = found.where(later | (F.col("name").eqNullSafe(F.lit(name)) & (F.col("id") > at)))
    for wanted in (text, also):
        if wanted:
            holds = F.lit(False)
            for f in fields:
                holds = holds | F.coalesce(F.contains(F.lower(f), F.lit(wanted.lower())), F.lit(False))
            found = found.join(matching_ids(spark, index, wanted), "id", "left_semi").where(holds)
    if among is not None:
        found = found.join(among.select("id"), "id", "left_semi")
    return found.orderBy(F.col("name").asc_nulls_first(), "id").limit(int(limit))
