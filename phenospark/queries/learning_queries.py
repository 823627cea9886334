"""Registered learned-phenotype queries: trace-based clustering and the
classifiers on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import learn as M
from phenospark.operators import tbc as T
from phenospark.plans import records as R

K = 5
THRESHOLD = 0.5


def given_partitions(spark, sf):
    """Assignments fixed by arithmetic on account balance (nested bands),
    so the relational steps T2-T4 can be checked exactly."""
    c = R.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    band = lambda k: F.least(F.lit(k - 1), F.floor((F.col("c_acctbal") + 1000.0) / 11000.0 * k)).cast("int")
    return c.select(F.col("c_custkey").alias("row_id"), *[band(k).alias(T.cluster_col(k)) for k in range(2, K + 1)])


def q_t2_tbc_matches(spark, sf):
    return T.tbc_matches(given_partitions(spark, sf), K, "jaccard")


def q_t2d_tbc_matches_dice(spark, sf):
    return T.tbc_matches(given_partitions(spark, sf), K, "dice")


def q_t3_tbc_candidates(spark, sf):
    return T.tbc_candidates(T.tbc_matches(given_partitions(spark, sf), K, "jaccard2"), THRESHOLD)


def q_t4_tbc_output(spark, sf):
    wide = given_partitions(spark, sf)
    return T.tbc_output(wide, T.tbc_candidates(T.tbc_matches(wide, K, "jaccard"), THRESHOLD), K)


#: Values of an embedding: all of them are features.
DIMS = 64


def _embedding_table(spark, sf):
    e = R.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    arr = F.col("embedding")
    return e.select(F.col("vec_id").alias("row_id"), *[arr[i].cast("double").alias(f"f{i}") for i in range(DIMS)],
                    F.concat(F.lit("label"), F.col("label").cast("string")).alias("label"))


def q_t1_tbc_partitions(spark, sf):
    df = _embedding_table(spark, sf)
    wide = T.tbc_partitions(df, [f"f{i}" for i in range(DIMS)], K, seed=1)
    return T.partitions_long(wide, K)


def q_t5_trace_based_clustering(spark, sf):
    df = _embedding_table(spark, sf)
    return T.trace_based_clustering(df, [f"f{i}" for i in range(DIMS)], K, "jaccard", seed=1, threshold=0.3)


def q_m1_ordinal_encode(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return M.ordinal_encode(li, ["l_returnflag", "l_linestatus"])


def q_m2_split_train_test(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return M.split_train_test(o, "o_orderkey", seed=M.SPLIT_SEED)


def _classify(spark, sf, model, binary=False, **settings):
    df = _embedding_table(spark, sf)
    if binary:
        df = df.withColumn("label", F.when(F.col("label").isin("label0", "label1", "label2", "label3", "label4"), "low")
                           .otherwise("high"))
    split = M.split_train_test(df, "row_id", seed=M.SPLIT_SEED)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    feats = [f"f{i}" for i in range(DIMS)]
    _, tr, te = M.fit_predict(train, test, "label", model, 0, feats, **settings)
    return (tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
            .select("row_id", "split", "label", "label_pred"))


def q_m4_logistic_regression(spark, sf):
    return _classify(spark, sf, "logistic")


def q_m5_decision_tree(spark, sf):
    return _classify(spark, sf, "decision_tree")


def q_m6_random_forest(spark, sf):
    return _classify(spark, sf, "random_forest")


def q_m7_gradient_boosting(spark, sf):
    return _classify(spark, sf, "gradient_boost", binary=True)


#: Stages of the query on ten labels: a stage is three jobs.
SOFTMAX_STAGES = 10


def q_m7k_softmax_boosting(spark, sf):
    return _classify(spark, sf, "gradient_boost", boosts=SOFTMAX_STAGES)


def q_m8_svc(spark, sf):
    return _classify(spark, sf, "svc", binary=True)


#: Most that the kernel of the query may be off for any pair of rows.
KERNEL_ERROR = 0.05


def q_m8k_svc_landmarks(spark, sf):
    return _classify(spark, sf, "svc", kernel_error=KERNEL_ERROR, iterations=100)


def q_w4_row_index(spark, sf):
    from phenospark.operators.frames import row_index

    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return row_index(o, "o_orderkey")


def q_m10_output_predictions(spark, sf):
    return M.output_predictions(q_m4_logistic_regression(spark, sf), "row_id")


GIVEN = """
g AS (SELECT c_custkey AS row_id,
             least(1, CAST(floor((c_acctbal + 1000.0) / 11000.0 * 2) AS INTEGER)) AS c2,
             least(2, CAST(floor((c_acctbal + 1000.0) / 11000.0 * 3) AS INTEGER)) AS c3,
             least(3, CAST(floor((c_acctbal + 1000.0) / 11000.0 * 4) AS INTEGER)) AS c4,
             least(4, CAST(floor((c_acctbal + 1000.0) / 11000.0 * 5) AS INTEGER)) AS c5 FROM customer),
lng AS (SELECT row_id, 2 AS k, c2 AS c FROM g UNION ALL SELECT row_id, 3, c3 FROM g UNION ALL SELECT row_id, 4, c4 FROM g
        UNION ALL SELECT row_id, 5, c5 FROM g),
sizes AS (SELECT k, c, count(*) AS size FROM lng GROUP BY k, c),
sk AS (SELECT c AS cluster, size AS size_k FROM sizes WHERE k = 5),
grid AS (SELECT sk.cluster, sk.size_k, kk.k, cc.ck FROM sk, (SELECT unnest(range(2, 5)) AS k) kk,
         LATERAL (SELECT unnest(range(0, kk.k)) AS ck) cc),
inter AS (SELECT g.c5 AS cluster, l.k, l.c AS ck, count(*) AS inter FROM g JOIN lng l ON l.row_id = g.row_id AND l.k < 5 GROUP BY ALL),
v AS (SELECT grid.cluster, grid.k, grid.ck, coalesce(inter.inter, 0) AS inter, grid.size_k, coalesce(sizes.size, 0) AS size_prev
      FROM grid LEFT JOIN inter USING (cluster, k, ck) LEFT JOIN sizes ON sizes.k = grid.k AND sizes.c = grid.ck)"""


def _best(expr):
    return ("WITH " + GIVEN + f""",
m AS (SELECT cluster, k, ck, {expr} AS match FROM v),
best AS (SELECT cluster, k, arg_min(ck, [-match, ck]) AS best_cluster, max(match) AS match FROM m WHERE match IS NOT NULL GROUP BY cluster, k)
""")


J = "CAST(inter AS DOUBLE) / (size_k + size_prev - inter)"
J2 = "CASE WHEN size_prev > 0 THEN CAST(inter AS DOUBLE) / size_prev END"
D = "CASE WHEN size_k + size_prev > 0 THEN 2.0 * inter / (size_k + size_prev) END"

SQL_T2 = _best(J) + "SELECT cluster, CAST(k AS INTEGER) AS k, CAST(best_cluster AS INTEGER) AS best_cluster, match FROM best"
SQL_T2D = _best(D) + "SELECT cluster, CAST(k AS INTEGER) AS k, CAST(best_cluster AS INTEGER) AS best_cluster, match FROM best"
SQL_T3 = _best(J2) + f"SELECT cluster, avg(match) AS mean_match FROM best GROUP BY cluster HAVING avg(match) >= {THRESHOLD}"
SQL_T4 = _best(J) + f""",
cand AS (SELECT cluster, avg(match) AS mean_match FROM best GROUP BY cluster HAVING avg(match) >= {THRESHOLD})
SELECT g.row_id AS instance_index, 'partition_k_5_cluster_' || CAST(g.c5 AS VARCHAR) AS cluster_name, cand.mean_match
FROM g JOIN cand ON cand.cluster = g.c5"""

SQL_M1 = """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS l_returnflag,
       CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE) AS l_linestatus
FROM lineitem"""
SQL_M2 = """
SELECT o_orderkey, o_orderstatus, CASE WHEN ((o_orderkey * 7919 + 100) % 1000 + 1000) % 1000 < 700 THEN 'train' ELSE 'test' END AS split
FROM orders"""

QUERIES = {
    "t1_tbc_partitions": q_t1_tbc_partitions,
    "t2_tbc_matches": q_t2_tbc_matches,
    "t2d_tbc_matches_dice": q_t2d_tbc_matches_dice,
    "t3_tbc_candidates": q_t3_tbc_candidates,
    "t4_tbc_output": q_t4_tbc_output,
    "t5_trace_based_clustering": q_t5_trace_based_clustering,
    "m1_ordinal_encode": q_m1_ordinal_encode,
    "m2_split_train_test": q_m2_split_train_test,
    "m4_logistic_regression": q_m4_logistic_regression,
    "m5_decision_tree": q_m5_decision_tree,
    "m6_random_forest": q_m6_random_forest,
    "m7_gradient_boosting": q_m7_gradient_boosting,
    "m7k_softmax_boosting": q_m7k_softmax_boosting,
    "m8k_svc_landmarks": q_m8k_svc_landmarks,
    "m8_svc": q_m8_svc,
    "w4_row_index": q_w4_row_index,
    "m10_output_predictions": q_m10_output_predictions,
}
ORACLES = {
    "t2_tbc_matches": SQL_T2,
    "t2d_tbc_matches_dice": SQL_T2D,
    "t3_tbc_candidates": SQL_T3,
    "t4_tbc_output": SQL_T4,
    "m1_ordinal_encode": SQL_M1,
    "m2_split_train_test": SQL_M2,
    "w4_row_index": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS \"index\", o_orderkey, o_custkey, o_orderstatus FROM orders",
}
