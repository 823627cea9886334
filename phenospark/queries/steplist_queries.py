"""Registered steplist phenotypes: a definition with a codelist, an
exclusion, age, a temporal rule, last encounter and a nested branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.plans import records as R
from phenospark.plans import steplist as S
from phenospark.queries.sqlparts import DEV, EV, LE, PAT, age_sql, with_

# Fixed definition: steplist rows (seq, logicType, param) and one branch.
STEPLIST = [
    (1, "codelist", "economy.csv:2"),
    (2, "codelistExclude", "promo.csv"),
    (3, "age", "30:80"),
    (4, "codelistsTemporal", "small.csv:large.csv:31:186"),
    (5, "lastEncounter", "5"),
    (6, "branch", "branch-medium.csv"),
]
NESTED = {"branch-medium.csv": [(1, "codelist", "medium.csv:1"), (2, "codelist", "standard.csv:1")]}
OUT_FLAGS = ["economy-brands-identified", "large-brands-31-to-186-days-after-small-identified",
             "branch-medium-identified"]


def type_codelist_files(spark, sf):
    """``(file, category, code)``: one codelist file per part type listing
    the brands of its smallest parts; its one category is "<Type> brands".
    (The smallest size is found by an aggregate per type and a join, so
    every type has codes at every scale.)"""
    part = R.table(spark, sf, "part").select("p_type", "p_brand", "p_size")
    smallest = part.groupBy("p_type").agg(F.min("p_size").alias("p_size"))
    p = part.join(smallest, ["p_type", "p_size"])
    return p.select(F.concat(F.lower("p_type"), F.lit(".csv")).alias("file"),
                    F.concat(F.initcap("p_type"), F.lit(" brands")).alias("category"),
                    F.col("p_brand").alias("code")).distinct()


def _steps(spark, sf):
    cats = type_codelist_files(spark, sf)
    return S.plan_steplist(STEPLIST, cats, NESTED), cats


def q_c16_steplist(spark, sf):
    steps, cats = _steps(spark, sf)
    out = S.evaluate_steplist(R.cohort(spark, sf), steps, cats, R.AS_OF)
    return out.select("patient-id", *OUT_FLAGS)


def q_c16l_steplist_events(spark, sf):
    steps, cats = _steps(spark, sf)
    pats = R.patients(spark, sf).join(R.last_encounters(spark, sf), "patient_id", "left")
    out = S.evaluate_steplist_events(R.coded_events(spark, sf), pats, steps, cats, R.AS_OF)
    return out.select("patient_id", *OUT_FLAGS)


#: One file in two steps and in a branch, whose age rule is its own.
REPEATED = [(1, "codelist", "economy.csv:2"), (2, "codelist", "economy.csv:4"), (3, "branch", "branch-economy.csv"), (4, "age", "20:90")]
REPEATED_NESTED = {"branch-economy.csv": [(1, "age", "30:80"), (2, "codelist", "economy.csv:1")]}
REPEATED_FLAGS = ["economy-brands-identified", "economy-brands-2-identified", "branch-economy-identified"]


def _repeated_steps(spark, sf):
    cats = type_codelist_files(spark, sf)
    return S.plan_steplist(REPEATED, cats, REPEATED_NESTED), cats


def q_c16r_steplist_repeated_file(spark, sf):
    steps, cats = _repeated_steps(spark, sf)
    pats = R.patients(spark, sf).join(R.last_encounters(spark, sf), "patient_id", "left")
    out = S.evaluate_steplist_events(R.coded_events(spark, sf), pats, steps, cats, R.AS_OF)
    return out.select("patient_id", *REPEATED_FLAGS)


def _hits(name, file, src="dev"):
    return (f"{name} AS (SELECT patient_id, count(*) AS n FROM {src} "
            f"WHERE code IN (SELECT code FROM cl WHERE file = '{file}') GROUP BY patient_id)")


def _sql(order):
    item = "'(' || code || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
    if order == "listed":
        b, a = f"arg_max(ts, {item})", f"arg_min(ts, {item})"
    else:
        b, a = "max(ts)", "min(ts)"
    pid = 'CAST(patient_id AS VARCHAR) AS "patient-id"' if order == "listed" else "patient_id"
    return with_(EV, DEV, PAT, LE,
                 "cl AS (SELECT DISTINCT lower(p_type) || '.csv' AS file, p_brand AS code FROM part "
                 "WHERE p_size = (SELECT min(p2.p_size) FROM part p2 WHERE p2.p_type = part.p_type))",
                 _hits("he", "economy.csv"), _hits("hp", "promo.csv"), _hits("hm", "medium.csv"),
                 _hits("hs", "standard.csv")) + f""",
b AS (SELECT patient_id, {b} AS bts FROM dev WHERE code IN (SELECT code FROM cl WHERE file = 'small.csv') GROUP BY 1),
a AS (SELECT patient_id, {a} AS ats FROM dev WHERE code IN (SELECT code FROM cl WHERE file = 'large.csv') GROUP BY 1),
d AS (SELECT patient_id, CAST(floor((epoch_us(ats) - epoch_us(bts)) / 86400000000.0) AS BIGINT) AS days
      FROM b JOIN a USING (patient_id)),
f AS (SELECT pat.patient_id, coalesce(he.n, 0) >= 2 AS e, hp.n IS NOT NULL AS p,
             NOT coalesce({age_sql("pat.dob")} >= 30 AND {age_sql("pat.dob")} < 80, false) AS age_ex,
             coalesce(d.days > 31 AND d.days < 186, false) AS t,
             NOT coalesce(2002 - year(le.last_ts) < 5, false) AS le_ex,
             hm.n IS NOT NULL AS m, hs.n IS NOT NULL AS s
      FROM pat LEFT JOIN le USING (patient_id) LEFT JOIN he USING (patient_id) LEFT JOIN hp USING (patient_id)
           LEFT JOIN hm USING (patient_id) LEFT JOIN hs USING (patient_id) LEFT JOIN d USING (patient_id))
SELECT {pid},
       CASE WHEN e THEN 'CASE' ELSE 'UNK' END AS "economy-brands-identified",
       CASE WHEN t AND NOT p AND NOT age_ex THEN 'CASE' ELSE 'UNK' END
         AS "large-brands-31-to-186-days-after-small-identified",
       CASE WHEN m AND s AND NOT p AND NOT age_ex AND NOT le_ex THEN 'CASE' ELSE 'UNK' END AS "branch-medium-identified"
FROM f"""


SQL_REPEATED = with_(EV, DEV, PAT, """cl AS (SELECT DISTINCT lower(p_type) || '.csv' AS file, p_brand AS code FROM part
         WHERE p_size = (SELECT min(p2.p_size) FROM part p2 WHERE p2.p_type = part.p_type))""", _hits("he", "economy.csv")) + f"""
SELECT patient_id, CASE WHEN n >= 2 THEN 'CASE' ELSE 'UNK' END AS "economy-brands-identified",
       CASE WHEN n >= 4 THEN 'CASE' ELSE 'UNK' END AS "economy-brands-2-identified",
       CASE WHEN n >= 1 AND {age_sql("dob")} >= 30 AND {age_sql("dob")} < 80 THEN 'CASE' ELSE 'UNK' END AS "branch-economy-identified"
FROM pat LEFT JOIN he USING (patient_id)"""

QUERIES = {"c16_steplist": q_c16_steplist, "c16l_steplist_events": q_c16l_steplist_events,
           "c16r_steplist_repeated_file": q_c16r_steplist_repeated_file}
ORACLES = {"c16_steplist": _sql("listed"), "c16l_steplist_events": _sql("date"), "c16r_steplist_repeated_file": SQL_REPEATED}
