"""S6-S8: codelist and steplist files, concept exports.

Codelist files are many CSVs whose headers differ, so no reader with one header
fits them.  They are read as lines by Spark's text source, which splits large files,
and put together by columns: lines are ordered by the place in their file, a record
ends where the quotes before it are balanced (quoted line breaks stay in their
cell), the first record of a file is its header and is joined to the others.

Running counts go over the lines of one block of a file and, a row a block, over the
blocks, so a large file is as many tasks as it has blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenospark.session import cut_lineage, maybe_broadcast

#: One cell of a record that starts with a comma: quoted (quotes doubled inside) or plain.
_CELL = r',("(?:[^"]|"")*+"[^,]*|[^,]*)'
_BOM = "\ufeff"


def _cells(record: Column) -> Column:
    """The cells of a CSV record."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))
    return F.transform(raw, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_extract(c, '(?s)^"(.*)"', 1), F.lit('""'), F.lit('"'))).otherwise(c))


def _unique(keys: Column) -> Column:
    """Names that come again get a number: ``a``, ``a.1``, ``a.2``."""
    def name(k: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(keys, F.lit(1), i), lambda x: x == k))
        return F.when(before > 0, F.concat(k, F.lit("."), before.cast("string"))).otherwise(k)

    return F.transform(keys, name)


def file_identity(path: Column, root: str) -> Column:
    """The file's path below ``root``: its bare name where it lies in ``root``
    itself, so files of one name in two folders stay apart."""
    base = root.rstrip("/")
    if "*" in base or re.search(r"\.[A-Za-z0-9]+$", base.rpartition("/")[2]):
        base = base.split("*")[0].rpartition("/")[0]  # a file or a pattern: its folder
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", base)
    rest = F.substring_index(path, below.replace(" ", "%20") + "/", -1)
    return F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))


def csv_records(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``filename, record_no, record``; ``filename, reason`` of files that can't be
    read): CSV records of all files as text, numbered from 0 (the header) in the
    order of the file.  Blank lines between records don't count.  A file whose
    quotes don't balance is rejected whole."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    # rows of one block come in order in one task; numbers are fixed before anything depends on them
    lines = cut_lineage(reader.text(path).select(
        file_identity(F.col("_metadata.file_path"), path).alias("filename"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    own, earlier = ["filename", "block"], Window.partitionBy("filename").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy(*own).orderBy("at")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*own).agg(F.sum(quotes).alias("q")).withColumn("q0", F.coalesce(F.sum("q").over(earlier), F.lit(0)))
    broken = blocks.groupBy("filename").agg(F.sum("q").alias("q")).where("q % 2 = 1").select("filename", F.lit("unbalanced quotes").alias("reason"))
    starts = (lines.join(blocks.select(*own, "q0"), own).join(broken.select("filename"), "filename", "left_anti")
              .withColumn("inside", (F.col("q0") + F.coalesce(F.sum(quotes).over(before), F.lit(0))) % 2 == 1)
              .withColumn("start", (~F.col("inside") & (F.trim("value") != "")).cast("long"))
              .where("inside or start = 1"))
    starts = starts.withColumn("n", F.sum("start").over(in_block))
    records = starts.groupBy(*own).agg(F.sum("start").alias("s")).withColumn("s0", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    numbered = starts.join(records.select(*own, "s0"), own).withColumn("record_no", F.col("s0") + F.col("n") - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])  # the lines of one record
    text = numbered.groupBy("filename", "record_no").agg(F.array_join(parts, "\n").alias("record"))
    text = text.withColumn("record", F.when(F.col("record_no") == 0, F.regexp_replace("record", "^" + _BOM, "")).otherwise(F.col("record")))
    return text, broken


def read_codelists(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """All CSV files under ``path`` as ``(filename, row_no, attrs)``; ``filename`` is
    the path below ``path``, ``row_no`` counts from 0 in the order of the file.
    Short rows have empty cells at the end, cells beyond the header are left out, a
    header's repeated names are numbered.  See :func:`csv_records` for its rejects."""
    records, _ = csv_records(spark, path, glob, recursive)
    records = cut_lineage(records)
    header = maybe_broadcast(records.where("record_no = 0").select("filename", _unique(_cells(F.col("record"))).alias("keys")))
    rows = records.where("record_no > 0").join(header, "filename").withColumn("cells", _cells(F.col("record")))
    value = lambda k, i: F.coalesce(F.get("cells", i), F.lit(""))
    return rows.select("filename", (F.col("record_no") - 1).cast("int").alias("row_no"),
                       F.map_from_arrays("keys", F.transform("keys", value)).alias("attrs"))


def read_steplist(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Steplist files as ``(filename, seq, logicType, param)``; ``seq`` is the
    row number inside the file, from 1."""
    long = read_codelists(spark, path, glob, recursive)
    return long.select("filename", (F.col("row_no") + 1).alias("seq"),
                       F.col("attrs")["logicType"].alias("logicType"), F.col("attrs")["param"].alias("param"))


# Coding-system ids of the concept export.
SYSTEM_NAMES = {5: "read", 4: "icd10", 7: "opcs4"}


def codelists_from_concept_export(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Working-set export ``(working_set_name, concept_id, concept_name, code)``
    with ``concepts(concept_id, coding_system)`` -> ``(name, category, code)``
    for working sets named ``... PHE<n> - <name>``; the category reads
    ``"<name> using <system> codes - <concept tail>"``."""
    systems = F.create_map(*[x for k, v in SYSTEM_NAMES.items() for x in (F.lit(k), F.lit(v))])
    # the concept dictionary can be large: broadcast only under the checked bound
    r = rows.where(F.col("working_set_name").contains("PHE")).join(maybe_broadcast(concepts), "concept_id", "left")
    name = F.regexp_extract("working_set_name", r".*PHE[0-9]*\s-\s(.*)", 1)
    tail = F.lower(F.regexp_extract("concept_name", r".*-.*-\s(.*)", 1))
    tail = F.regexp_replace(tail, r"^(.*?) care", "$1")
    cat = F.concat(name, F.lit(" using "), systems[F.col("coding_system").cast("int")], F.lit(" codes - "), tail)
    # long (name, category, code): a large category is never gathered into one row
    return r.select(name.alias("name"), cat.alias("category"), F.col("code").cast("string").alias("code")).distinct()
