"""Session setup and small plan helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side (rows) that we hand to a broadcast join.  Codelists, category
# maps and steplists are definitions, not data: they stay far below this.
BROADCAST_MAX_ROWS = 200_000
# ... and its largest size in bytes, as text.
BROADCAST_MAX_BYTES = 32 << 20


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "phenospark") -> SparkSession:
    """Build (or reuse) a session with the settings every operator relies on.

    * UTC session time zone: dates in the health record are civil dates.
    * AQE with skew-join splitting and partition coalescing: patient and code
      distributions are skewed in real records.
    * UI off: no server is started by batch jobs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once a context: they import it
    wherever the job was submitted from."""
    sc = spark.sparkContext
    if getattr(sc, "_phenospark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # the driver's own scratch, kept as long as the driver: its file service reads the archive from there
    path = os.path.join(tempfile.mkdtemp(prefix="phenospark-package-"), "phenospark_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(here), os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._phenospark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="phenospark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one) so a lost executor does not
    replay a long chain of criteria."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no plan needs any more: it finds them when the
    driver's collector runs, which by itself may be long after the job.  Twice, as what the
    job's last events hold is only let go after them."""
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def store_and_free(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for large tables: stored by column in the checkpoint folder, a third of a
    checkpoint's bytes, and the shuffle files that led to it go.  Partitioning is not kept.
    Callers must not hold on to ``df``."""
    spark, schema = df.sparkSession, df.schema
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


#: Rows of a table that one task takes at the most where a row costs much time.
TASK_ROWS = 10_000


def tasks_for(df: DataFrame) -> int:
    """Tasks of at most ``TASK_ROWS`` rows."""
    return max(1, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals the rows of a table (read or checkpointed) to tasks by their number: by its bytes
    a small file is one task, however long its rows take.  Small tables stay as they are.
    The dealt rows are checkpointed: filters on what is worked out from them would else be
    pushed below the dealing, into the few tasks that read the file."""
    tasks = tasks_for(df)
    return cut_lineage(df.repartition(tasks, *keys)) if tasks > df.rdd.getNumPartitions() else df


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """Bounded size check: reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Bounded check of rows and bytes: reads at most ``max_rows + 1`` rows."""
    size = F.octet_length(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast a definition-sized side only after checking that it is small;
    beyond the bounds the join stays a shuffle join (AQE may still switch)."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
