"""S1, S9, S10: header CSV in and out, named datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions.cells import q


def read_cohort_csv(spark: SparkSession, path: str) -> DataFrame:
    """A potential-cases CSV with header; every value stays a string, empty
    cells are empty strings (quoted cells may hold commas and newlines)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("inferSchema", False).option("mode", "FAILFAST").csv(path))
    return df.select(*[F.coalesce(q(c), F.lit("")).alias(c) for c in df.columns])


def write_cases(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cases out, with header, in column order.  Each task writes its own part
    file; nothing is funnelled through one task."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


#: The file of a dataset's folder that names its current version.
POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    """(the file context of ``path``, a function that makes its Hadoop paths)."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsc.hadoopConfiguration()
    fs = at(path).getFileSystem(conf)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf), fs, at


def _rename(spark: SparkSession, files, source, target, replace: bool) -> None:
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if replace else option.NONE
    files.rename(source, target, options)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that readers see; None if there is no dataset."""
    _, fs, at = _hadoop(spark, path)
    pointer = at(f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path.rstrip('/')}/" + spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def publish_dataset(df: DataFrame, path: str, replace: bool = False, fmt: str = "parquet") -> str:
    """Store a named dataset: replace it, or fail if it already exists.

    Each publication is a folder of its own; the pointer to it is swapped by one
    rename once it is complete.  Readers see the old version or the new one, never a
    part, and a write that fails leaves the old one as it was.  Of two first
    publications at once one fails.  Returns the new version's folder; old ones stay
    until :func:`drop_old_versions`."""
    spark = df.sparkSession
    base = path.rstrip("/")
    if not replace and current_version(spark, base):
        raise FileExistsError(f"dataset {path} exists")
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").format(fmt).save(f"{base}/{version}")
    files, fs, at = _hadoop(spark, base)
    draft = at(f"{base}/{POINTER}.{version}")
    out = fs.create(draft, False)
    try:
        out.write(version.encode())
    finally:
        out.close()
    try:
        _rename(spark, files, draft, at(f"{base}/{POINTER}"), replace)
    except Exception as e:
        fs.delete(draft, False)
        if not replace and current_version(spark, base):
            raise FileExistsError(f"dataset {path} exists") from e
        raise
    return f"{base}/{version}"


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The current version of a published dataset; a reader that has begun keeps
    its version until old ones are dropped."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no dataset at {path}")
    return spark.read.format(fmt).load(version)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the current one (also what failed writes left);
    call it when no reader and no publication is under way."""
    _, fs, at = _hadoop(spark, path)
    current, dropped = current_version(spark, path), 0
    for status in fs.listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and not (current or "").endswith("/" + name):
            fs.delete(status.getPath(), True)
            dropped += 1
    return dropped
