"""Shared folder, written tables and small column helpers of the llm operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.session import ensure_checkpoint_dir

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII; texts are lower-cased in A-Z only.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = re.compile(WORD)


def words_of(text: str) -> list[str]:
    """The words of a text after lower-casing A-Z."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes lower in A-Z only


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder for one run of an operator, below the shared
    checkpoint folder (``spark.checkpoint.dir``; tests set their own)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base:
        base = "file:///" + re.sub(r"^(file:)?/*", "", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the
    lineage ends there, so a lost executor doesn't replay earlier stages."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI on any shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole; parents are made where the store has folders."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def partition_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def doc_columns(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty, plus ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def text_key():
    """Tells rows with one ``doc_id`` apart: a hash of the text (after :func:`doc_columns`)."""
    return F.xxhash64("text").alias("key")


def in_doc_order(docs: DataFrame, *first: str) -> DataFrame:
    """Rows in ranges of (``first``, ``doc_id``), each partition sorted; the rank
    of the partition is the rank of its rows.  Null ids come last; rows with one
    id are ordered by their text's hash, so a rerun writes the same."""
    keys = [F.col(c).asc_nulls_last() for c in (*first, "doc_id")]
    return docs.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64("text"))


def by_key(batches: Iterator, key: str) -> Iterator[tuple[object, list]]:
    """(key, its record batches) of a partition whose rows lie sorted by ``key``;
    holds one key's rows at a time."""
    import pyarrow.compute as pc

    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        change = [0, *[i + 1 for i in pc.indices_nonzero(
            pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))).to_pylist()], len(column)]
        for a, b in zip(change, change[1:], strict=False):
            value = column[a].as_py()
            if held and value != at:
                yield at, held
                held = []
            at = value
            held.append(batch.slice(a, b - a))
    if held:
        yield at, held
