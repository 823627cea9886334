"""Frame helpers shared by operators (W4 row index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row number in partition


def row_index(df: DataFrame, key: str, name: str = "index", partitions: int | None = None) -> DataFrame:
    """Adds a 0-based index in ``key`` order (``key`` must be unique), as the
    leading column.  Rows are range-partitioned by the key and numbered inside
    each partition; each partition's offset comes from a per-partition count
    (one row per partition, summed in order) — never one task for all rows.
    The numbered table is checkpointed so that a recomputation after a lost
    executor cannot renumber it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key).sortWithinPartitions(key)
    mid = F.monotonically_increasing_id()
    numbered = cut_lineage(ranged.withColumn("_mid", mid)
                           .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
                           .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a running sum over that small table
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = numbered.join(F.broadcast(offsets), "_pid")
    return out.select((F.col("_off") + F.col("_local")).alias(name), *[F.col(f"`{c}`") for c in df.columns])
