"""Size-checked broadcast and lineage helpers."""

from phenospark.session import cut_lineage, has_at_most, maybe_broadcast


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_below_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only our hint may broadcast
    try:
        big = spark.range(0, 5000).withColumnRenamed("id", "k")
        small = spark.range(0, 10).withColumnRenamed("id", "k")
        assert has_at_most(small, 10) and not has_at_most(small, 9)
        assert "BroadcastHashJoin" in _plan(big.join(maybe_broadcast(small, max_rows=100), "k"))
        assert "BroadcastHashJoin" not in _plan(big.join(maybe_broadcast(big, max_rows=100), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cut_lineage_is_reliable(spark):
    df = spark.range(0, 100).selectExpr("id", "id * 2 AS v")
    out = cut_lineage(df)
    assert out.count() == 100
    assert spark.sparkContext.getCheckpointDir()
    assert "LocalCheckpoint" not in out._jdf.queryExecution().logical().toString()


def test_rows_of_a_small_file_are_dealt_to_tasks(spark, tmp_path):
    """One file of few bytes and many rows: several tasks, also for what is filtered by a value worked out."""
    from pyspark.sql import functions as F
    from phenospark.operators import codelists as K
    from phenospark.queries import curation_queries as Q

    (spark.range(25_000).select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand"), F.lit("steel").alias("p_type"),
                                F.lit("plated tin").alias("p_name"), F.lit(1).alias("p_size"))
     .coalesce(1).write.parquet(str(tmp_path / "part.parquet")))
    rows = K.with_description(K.included(Q.codelists(spark, str(tmp_path)))).where("description is not null")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.rdd.getNumPartitions() >= 3 and "Exchange" not in plan
    assert tuple(rows.agg(F.count("row_no"), F.countDistinct("row_no")).first()) == (25_000, 25_000)


def test_xml_records_are_written_in_files_of_so_many_rows(spark, tmp_path, monkeypatch):
    """A task reads an XML file whole: files must not grow with the table."""
    from pyspark.sql import functions as F
    from phenospark.queries import extra_queries as Q

    monkeypatch.setattr(Q, "_scratch", lambda spark, name: str(tmp_path / name))
    (spark.range(25_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"))
     .coalesce(1).write.parquet(str(tmp_path / "customer.parquet")))
    assert Q.q_s5_cohort_from_xml(spark, str(tmp_path)).count() == 25_000
    assert len(list((tmp_path / "xml").glob("part-*"))) >= 3


def test_shuffle_files_go_once_a_table_is_stored(spark):
    """What led to a stored table leaves no shuffle files behind; its rows and types stay."""
    import time

    from phenospark.session import store_and_free

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    known = lambda: {k for k in range(20_000) if tracker.containsShuffle(k)}
    before = known()
    out = store_and_free(spark.range(1000).selectExpr("id % 7 AS k", "CAST(id AS string) AS v").repartition(5, "k"))
    ended = time.time() + 10
    while known() - before and time.time() < ended:
        time.sleep(0.1)
    assert not known() - before
    assert out.dtypes == [("k", "bigint"), ("v", "string")] and out.count() == 1000 and out.select("k").distinct().count() == 7
