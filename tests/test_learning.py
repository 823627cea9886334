"""Trace-based clustering and classifiers: exact small cases and invariants."""

import pytest
from pyspark.sql import functions as F

from phenospark.operators import learn as M
from phenospark.operators import tbc as T


def test_tbc_matches_by_hand(spark):
    # 6 instances; partitions k=2, k=3 and K=4
    rows = [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 1, 1), (3, 1, 1, 2), (4, 1, 2, 3), (5, 1, 2, 3)]
    wide = spark.createDataFrame(rows, "row_id long, c_2 int, c_3 int, c_4 int")
    m = {(r["cluster"], r["k"]): (r["best_cluster"], round(r["match"], 6)) for r in T.tbc_matches(wide, 4, "jaccard").collect()}
    # K-cluster 0 = {0,1}: vs k=2 {0,1,2} -> 2/3; vs k=3 {0,1} -> 1
    assert m[(0, 2)] == (0, round(2 / 3, 6)) and m[(0, 3)] == (0, 1.0)
    # K-cluster 2 = {3}: k=3 {2,3} -> 1/2 ; k=2 cluster 1 {3,4,5} -> 1/3
    assert m[(2, 3)] == (1, 0.5) and m[(2, 2)] == (1, round(1 / 3, 6))
    cands = {r["cluster"]: r["mean_match"] for r in T.tbc_candidates(T.tbc_matches(wide, 4, "jaccard"), 0.8).collect()}
    assert set(cands) == {0, 3}  # cluster 3 = {4,5}: 2/3 and 1
    out = T.tbc_output(wide, T.tbc_candidates(T.tbc_matches(wide, 4, "jaccard"), 0.8), 4).collect()
    assert sorted((r["instance_index"], r["cluster_name"]) for r in out) == [
        (0, "partition_k_4_cluster_0"), (1, "partition_k_4_cluster_0"),
        (4, "partition_k_4_cluster_3"), (5, "partition_k_4_cluster_3")]


def test_tbc_ties_go_to_lowest_cluster(spark):
    rows = [(0, 0, 0), (1, 1, 0)]
    wide = spark.createDataFrame(rows, "row_id long, c_2 int, c_3 int")
    r = T.tbc_matches(wide, 3, "dice").collect()[0]
    assert r["best_cluster"] == 0


def test_tbc_argument_checks(spark):
    wide = spark.createDataFrame([(0, 0, 0)], "row_id long, c_2 int, c_3 int")
    with pytest.raises(ValueError):
        T.tbc_matches(wide, 2)
    with pytest.raises(ValueError):
        T.tbc_matches(wide, 3, "cosine")


def test_tbc_partitions_invariants(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(60)], "row_id long, x double, y double")
    wide = T.tbc_partitions(df, ["x", "y"], 4, seed=0)
    assert wide.count() == 60
    for k in (2, 3, 4):
        assert wide.agg(F.max(T.cluster_col(k))).first()[0] <= k - 1
    again = T.tbc_partitions(df, ["x", "y"], 4, seed=0)
    assert sorted(wide.collect()) == sorted(again.collect())


def _data(spark):
    rows = [(i, float(i % 10), float((i * 3) % 7), "yes" if (i % 10) + ((i * 3) % 7) > 8 else "no") for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, cls string")


def test_split_is_repeatable_and_seeded(spark):
    df = _data(spark)
    s1 = M.split_train_test(df, "row_id", seed=100)
    share = s1.where("split = 'train'").count() / 200
    assert 0.6 < share < 0.8
    assert sorted(s1.collect()) == sorted(M.split_train_test(df, "row_id", seed=100).collect())
    assert sorted(s1.collect()) != sorted(M.split_train_test(df, "row_id", seed=0).collect())
    with pytest.raises(ValueError):
        M.split_train_test(df, "row_id", seed=-1)


@pytest.mark.parametrize("model", ["logistic", "decision_tree", "svc"])
def test_classifier_invariants(spark, model, tmp_path):
    df = M.split_train_test(_data(spark), "row_id")
    train = df.where("split = 'train'").drop("split")
    test = df.where("split = 'test'").drop("split", "cls")          # test may lack the class
    fitted, tr, te = M.fit_predict(train, test, "cls", model, seed=0, features=["a", "b"])
    assert tr.count() == train.count() and te.count() == test.count()
    assert {r[0] for r in tr.select("cls_pred").distinct().collect()} <= {"yes", "no"}
    acc = tr.where(F.col("cls") == F.col("cls_pred")).count() / tr.count()
    majority = max(train.where("cls = 'yes'").count(), train.where("cls = 'no'").count()) / train.count()
    assert acc >= majority
    M.save_model(fitted, str(tmp_path / "m"))
    again = M.load_model(str(tmp_path / "m"))
    assert again.transform(train).select("cls_pred").count() == train.count()


def test_ordinal_encode(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4)], "v string, k int")
    out = {r["k"]: r["v"] for r in M.ordinal_encode(df, ["v"]).collect()}
    assert out == {1: 1.0, 2: 0.0, 3: 2.0, 4: 0.0}


def test_fits_keep_their_vectors_themselves(spark, monkeypatch):
    """k-means keeps the vectors of a table that is not persisted; of a persisted one it would decode them in every round."""
    from pyspark.ml.clustering import KMeans

    from phenospark.operators import tbc
    df = spark.range(60).selectExpr("id AS row_id", "CAST(id % 5 AS double) AS a", "CAST(id % 3 AS double) AS b")
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data, *a: seen.append(data.storageLevel.useMemory) or fit(self, data, *a))
    assert tbc.tbc_partitions(df, ["a", "b"], 3, seed=1).count() == 60 and seen == [False, False]
