"""Potential-cases files arriving in a folder -> cases written to a sink.

The wide criteria (codelists, exclusions, temporal, keywords, age, last
encounter, rules, resolution, branches) are stateless projections of one
row, so the same chain that runs in batch runs per micro-batch.  The file
sink with a checkpoint location gives exactly-once output across restarts
and lost executors; nothing is kept in state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from phenospark.functions.cells import q


def cases_schema(columns) -> StructType:
    """Every potential-cases column is a string."""
    return StructType([StructField(c, StringType(), True) for c in columns])


def _read(spark: SparkSession, source: str, columns, fmt: str, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(cases_schema(columns)).format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    df = r.load(source)
    return df.select(*[F.coalesce(q(c), F.lit("")).alias(c) for c in columns])


def start_phenotype_stream(spark: SparkSession, source: str, columns, chain: Callable[[DataFrame], DataFrame],
                           sink: str, checkpoint: str, fmt: str = "csv", sink_format: str = "parquet",
                           available_now: bool = False, max_files: int | None = None) -> StreamingQuery:
    """Start the stream: read arriving files, apply ``chain`` (a function of
    criteria), append to ``sink``.  ``checkpoint`` must be a shared folder."""
    out = chain(_read(spark, source, columns, fmt, max_files))
    w = (out.writeStream.format(sink_format).option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_phenotype_stream(spark: SparkSession, source: str, columns, chain, sink: str, checkpoint: str,
                         fmt: str = "csv") -> DataFrame:
    """Process everything available now, then return the sink as a table."""
    qy = start_phenotype_stream(spark, source, columns, chain, sink, checkpoint, fmt, available_now=True)
    qy.awaitTermination()
    return spark.read.parquet(sink)
