"""Nested JSON results of trace-based clustering, written and read with explicit
schemas.

Partitions: ``{"partition_k_N": {"cluster_M": [instance index, ...]}}``; matrix of
matches: ``{"partition_k_K_cluster_M": {"instances": [...],
"match_with_previous_partitions": {"partition_k_N": {"max_value_of_match": x,
"cluster_with_max_value_of_match": "partition_k_N_cluster_C"}}}}``.

A cluster may hold any share of all instances, so it is never one row: a line holds
the members of one range of ``chunk`` indexes, and ``ordinal`` is the number of the
range.  Each line is a whole document of the nested form with one cluster in it; the
lines of a result merge into the one document by appending arrays in the order of
``ordinal``, and a single document with everything in it reads the same way.

Clusters without members have one line with an empty array.  A null index is left
out.  Lines that are not such documents come back as rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS_SCHEMA = "map<string,map<string,array<bigint>>>"
MATRIX_SCHEMA = ("map<string,struct<instances:array<bigint>,match_with_previous_partitions:map<string,"
                 "struct<max_value_of_match:double,cluster_with_max_value_of_match:string>>>>")
#: Indexes in the range of one line.
CHUNK = 10_000
# Names of the nested form.
PARTITION, CLUSTER = "partition_k_", "cluster_"


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _number(name: Column, pattern: str) -> Column:
    """The number that ``pattern`` captures; null where the name has another form."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")


def _chunks(members: DataFrame, by: list[str], key: str, chunk: int) -> DataFrame:
    """``by..., ordinal, ids``: at most ``chunk`` different indexes a row."""
    return (members.where(F.col(key).isNotNull())
            .groupBy(*by, F.floor(F.col(key) / chunk).cast("bigint").alias("ordinal"))
            .agg(F.sort_array(F.collect_set(F.col(key).cast("bigint"))).alias("ids")))


def _all_clusters(spark: SparkSession, ks: range) -> DataFrame:
    """Every (k, cluster) of the partitions: a few rows, from the number of clusters."""
    return spark.createDataFrame([(k, c) for k in ks for c in range(k)], "k int, cluster int")


def partition_lines(parts: DataFrame, K: int, key: str = "row_id", chunk: int = CHUNK) -> DataFrame:
    """``(key, k, cluster)`` -> ``(k, cluster, ordinal, json)``."""
    held = _chunks(parts.select(key, F.col("k").cast("int").alias("k"), F.col("cluster").cast("int").alias("cluster")), ["k", "cluster"], key, chunk)
    empty = _all_clusters(parts.sparkSession, range(2, K + 1)).join(held.select("k", "cluster").distinct(), ["k", "cluster"], "left_anti")
    rows = held.unionByName(empty.select("*", F.lit(0).cast("bigint").alias("ordinal"), F.array().cast("array<bigint>").alias("ids")))
    document = F.create_map(_name(PARTITION, F.col("k")), F.create_map(_name(CLUSTER, F.col("cluster")), F.col("ids")))
    return rows.select("k", "cluster", "ordinal", F.to_json(document).alias("json"))


def matrix_lines(parts: DataFrame, matches: DataFrame, K: int, key: str = "row_id", chunk: int = CHUNK) -> DataFrame:
    """Partitions ``(key, k, cluster)`` and their ``matches`` ``(cluster, k,
    best_cluster, match)`` -> ``(cluster, ordinal, json)``.  The first line of a
    cluster carries its matches (one a partition, so at most K - 2)."""
    held = _chunks(parts.where(F.col("k") == K).select(key, F.col("cluster").cast("int").alias("cluster")), ["cluster"], key, chunk)
    first = held.groupBy("cluster").agg(F.min("ordinal").alias("ordinal"))
    clusters = _all_clusters(parts.sparkSession, range(K, K + 1)).select("cluster").join(first, "cluster", "left") \
        .select("cluster", F.coalesce("ordinal", F.lit(0).cast("bigint")).alias("ordinal"))
    entry = F.struct(_name(PARTITION, F.col("k")).alias("key"), F.struct(
        F.col("match").cast("double").alias("max_value_of_match"),
        F.concat(_name(PARTITION, F.col("k")), F.lit("_"), _name(CLUSTER, F.col("best_cluster"))).alias("cluster_with_max_value_of_match")).alias("value"))
    told = matches.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("told"))
    rows = held.join(clusters.join(told, "cluster", "left"), ["cluster", "ordinal"], "full")
    document = F.create_map(F.concat(_name(PARTITION, F.lit(K)), F.lit("_"), _name(CLUSTER, F.col("cluster"))), F.struct(
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("instances"), F.col("told").alias("match_with_previous_partitions")))
    return rows.select("cluster", "ordinal", F.to_json(document).alias("json"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The ``json`` column as text, a line a row, in the order of the other
    columns over all files."""
    order = [c for c in lines.columns if c != "json"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("json").write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("json")).where(F.trim("json") != "")


def parse_partitions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``json`` lines -> (``(row_id, k, cluster)``, rejected lines).  A line is
    rejected whole: not such a document, or a name of another form in it."""
    parsed = lines.select("json", F.from_json("json", PARTITIONS_SCHEMA).alias("doc"))
    number = lambda c: _number(c, f"^{PARTITION}([0-9]+)$")
    cluster = lambda c: _number(c, f"^{CLUSTER}([0-9]+)$")
    good = (F.size(F.coalesce("doc", F.map_from_arrays(F.array(), F.array()).cast(PARTITIONS_SCHEMA))) > 0) & F.forall(
        F.map_entries("doc"), lambda e: number(e["key"]).isNotNull() & e["value"].isNotNull() & F.coalesce(F.forall(
            F.map_entries(e["value"]), lambda x: cluster(x["key"]).isNotNull() & x["value"].isNotNull()), F.lit(False)))
    parsed = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = (parsed.where("good").select(F.explode("doc").alias("p", "clusters"))
            .select("p", F.explode("clusters").alias("c", "ids"))
            .select(number(F.col("p")).alias("k"), cluster(F.col("c")).alias("cluster"), F.explode("ids").alias("row_id")))
    return rows.where(F.col("row_id").isNotNull()).select("row_id", "k", "cluster"), parsed.where(~F.col("good")).select("json")


def parse_matrix(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``json`` lines -> (``(row_id, k, cluster)`` of the last partition,
    ``(cluster, k, best_cluster, match)``, rejected lines)."""
    pattern = f"^{PARTITION}%s_{CLUSTER}%s$"
    parsed = lines.select("json", F.from_json("json", MATRIX_SCHEMA).alias("doc"))
    k_of = lambda c: _number(c, pattern % ("([0-9]+)", "[0-9]+"))
    cluster_of = lambda c: _number(c, pattern % ("[0-9]+", "([0-9]+)"))
    good = (F.size(F.map_keys("doc")) > 0) & F.forall(F.map_entries("doc"), lambda e: k_of(e["key"]).isNotNull() & e["value"]["instances"].isNotNull())
    parsed = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    each = parsed.where("good").select(F.explode("doc").alias("name", "x")).select(
        k_of(F.col("name")).alias("K"), cluster_of(F.col("name")).alias("cluster"), "x.*")
    members = each.select(F.explode("instances").alias("row_id"), F.col("K").alias("k"), "cluster").where(F.col("row_id").isNotNull())
    matches = (each.select("cluster", F.explode("match_with_previous_partitions").alias("p", "m"))
               .select("cluster", _number(F.col("p"), f"^{PARTITION}([0-9]+)$").alias("k"),
                       cluster_of(F.col("m.cluster_with_max_value_of_match")).alias("best_cluster"), F.col("m.max_value_of_match").alias("match")))
    return members, matches, parsed.where(~F.col("good")).select("json")
