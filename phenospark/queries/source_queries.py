"""Registered source queries: health-record exports shaped from the given
tables, read back through the connectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from phenospark.plans import records as R
from phenospark.session import ensure_checkpoint_dir
from phenospark.sources import files as SF
from phenospark.sources import records as SR
from phenospark.sources import tabular as ST
from phenospark.queries.criteria_queries import SQL_COHORT


def _scratch(spark, what):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{what}-{uuid.uuid4().hex}"


def q_s1_cohort_csv_roundtrip(spark, sf):
    """Write the cohort as header CSV (S9) and read it back (S1)."""
    path = _scratch(spark, "cases")
    ST.write_cases(R.cohort(spark, sf), path)
    return SR_cast(ST.read_cohort_csv(spark, path))


def SR_cast(df):
    # Cells come back as strings; a missing last encounter reads as ''.
    return df.select("patient-id", "dob", "codes",
                     F.when(F.col("last-encounter") == "", None).otherwise(F.col("last-encounter")).alias("last-encounter"))


def _fhir_frames(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand")
    cond = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.struct(F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("reference")).alias("subject"),
                    F.struct(F.concat(F.lit("Encounter/"), F.col("l_orderkey").cast("string")).alias("reference")).alias("context"),
                    F.struct(F.array(F.struct(F.col("p_brand").alias("code"))).alias("coding")).alias("code")))
    pat = R.patients(spark, sf).select(F.col("patient_id").cast("string").alias("id"),
                                       F.date_format("dob", "yyyy-MM-dd").alias("birthDate"))
    enc = o.select(F.col("o_orderkey").cast("string").alias("id"),
                   F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("end")).alias("period"))
    return cond, pat, enc


def q_s2_cohort_from_fhir(spark, sf):
    return SR.cohort_from_fhir(*_fhir_frames(spark, sf))


SQL_S2 = """
WITH j AS (SELECT o_custkey AS patient, p_brand AS code, o_orderdate AS d
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT patient, array_to_string(list_sort(list(DISTINCT '(' || code || ',' || strftime(d, '%Y-%m-%dT%H:%M:%S.%g') || 'Z)')), ',') AS codes,
             max(d) AS last FROM j GROUP BY patient)
SELECT CAST(patient AS VARCHAR) AS "patient-id",
       strftime(DATE '1920-01-01' + CAST((patient * 7919) % 36500 AS INTEGER), '%Y-%m-%d') AS dob,
       codes, strftime(last, '%Y-%m-%dT%H:%M:%S.%g') AS "last-encounter"
FROM c"""


def _omop_frames(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = R.table(spark, sf, "part").select("p_partkey")
    recs = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("person_id"),
                    F.when(F.col("l_returnflag") == "R", "drug").otherwise("condition").alias("domain"),
                    F.col("p_partkey").alias("concept_id"),
                    F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("end_day")))
    person = R.patients(spark, sf).select(F.col("patient_id").alias("person_id"), F.year("dob").alias("year_of_birth"))
    obs = o.select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month_year"))
    return person, recs, obs


def q_s3_cohort_from_omop(spark, sf):
    return SR.cohort_from_omop(*_omop_frames(spark, sf))


SQL_S3 = """
WITH st AS (SELECT min(year(o_orderdate) * 100 + month(o_orderdate)) AS m FROM orders),
s AS (SELECT make_date(CAST(m // 100 AS INTEGER), CAST(m % 100 AS INTEGER), 1) AS start FROM st),
r AS (SELECT o_custkey AS patient, p_partkey AS concept,
             CAST(s.start + CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS TIMESTAMP) AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey, s
      WHERE l_returnflag <> 'R'),
c AS (SELECT patient, array_to_string(list_sort(list(DISTINCT '(' || CAST(concept AS VARCHAR) || ',' || strftime(w, '%Y-%m-%dT%H:%M:%S.%g') || 'Z)')), ',') AS codes,
             max(w) AS last FROM r GROUP BY patient)
SELECT CAST(patient AS VARCHAR) AS "patient-id",
       CAST(year(DATE '1920-01-01' + CAST((patient * 7919) % 36500 AS INTEGER)) AS VARCHAR) || '-01-01' AS dob,
       codes, strftime(last, '%Y-%m-%dT%H:%M:%S.%g') AS "last-encounter"
FROM c"""


def _i2b2_frames(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand")
    obs = (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
           .select(F.col("o_custkey").alias("patient_id"), F.concat(F.lit("BRAND:"), F.col("p_brand")).alias("concept_cd"),
                   F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("end_date"), "l_linenumber"))
    primary = obs.where(F.col("l_linenumber") == 1).drop("l_linenumber")
    secondary = obs.where(F.col("l_linenumber") != 1).drop("l_linenumber")
    pats = R.patients(spark, sf).select("patient_id", F.date_format("dob", "yyyy-MM-dd").alias("birth_date"))
    return pats, primary, secondary


def q_s4_cohort_from_i2b2(spark, sf):
    return SR.cohort_from_i2b2(*_i2b2_frames(spark, sf))


SQL_S4 = """
WITH j AS (SELECT o_custkey AS patient, p_brand AS code, l_shipdate AS d
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT patient, array_to_string(list_sort(list(DISTINCT '(' || code || ',' || strftime(d, '%Y-%m-%dT%H:%M:%S.%g') || ')')), ',') AS codes,
             max(d) AS last FROM j GROUP BY patient)
SELECT CAST(patient AS VARCHAR) AS "patient-id",
       strftime(DATE '1920-01-01' + CAST((patient * 7919) % 36500 AS INTEGER), '%Y-%m-%d') AS dob,
       codes, strftime(last, '%Y-%m-%dT%H:%M:%S.%g') AS "last-encounter"
FROM c"""


def _concept_frames(spark, sf):
    p = R.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows = p.select(F.concat(F.lit("Export "), F.when(F.col("p_type") != "PROMO", F.lit("PHE7 - ")).otherwise(F.lit("- ")),
                             F.initcap("p_type")).alias("working_set_name"),
                    F.col("p_size").alias("concept_id"),
                    F.concat(F.lit("Part - "), F.col("p_type"), F.lit(" - "), F.col("p_name"), F.lit(" care")).alias("concept_name"),
                    F.col("p_partkey").alias("code"))
    concepts = p.select(F.col("p_size").alias("concept_id"),
                        F.when(F.col("p_size") < 17, 4).when(F.col("p_size") < 34, 5).otherwise(7).alias("coding_system")
                        ).distinct()
    return rows, concepts


def q_s8_concept_export(spark, sf):
    return SF.codelists_from_concept_export(*_concept_frames(spark, sf))


SQL_S8 = """
WITH r AS (SELECT p_type, p_name, p_partkey,
                  CASE WHEN p_size < 17 THEN 'icd10' WHEN p_size < 34 THEN 'read' ELSE 'opcs4' END AS sys
           FROM part WHERE p_type <> 'PROMO')
SELECT upper(p_type[1]) || lower(p_type[2:]) AS name,
       upper(p_type[1]) || lower(p_type[2:]) || ' using ' || sys || ' codes - ' || lower(p_name) AS category,
       CAST(p_partkey AS VARCHAR) AS code
FROM r GROUP BY ALL"""


QUERIES = {
    "s1_cohort_csv_roundtrip": q_s1_cohort_csv_roundtrip,
    "s2_cohort_from_fhir": q_s2_cohort_from_fhir,
    "s3_cohort_from_omop": q_s3_cohort_from_omop,
    "s4_cohort_from_i2b2": q_s4_cohort_from_i2b2,
    "s8_concept_export": q_s8_concept_export,
}
ORACLES = {
    "s1_cohort_csv_roundtrip": SQL_COHORT,
    "s2_cohort_from_fhir": SQL_S2,
    "s3_cohort_from_omop": SQL_S3,
    "s4_cohort_from_i2b2": SQL_S4,
    "s8_concept_export": SQL_S8,
}


def q_st_phenotype_stream(spark, sf):
    """The resolved phenotype chain over the cohort arriving as CSV files,
    run by Structured Streaming (available-now trigger, checkpointed sink)."""
    from phenospark.operators import criteria as C
    from phenospark.queries.criteria_queries import FLAG_COLS, phenotype_chain
    from phenospark.streaming import run_phenotype_stream

    src = _scratch(spark, "stream-in")
    ST.write_cases(R.cohort(spark, sf), src)
    cols = ["patient-id", "dob", "codes", "last-encounter"]
    out = run_phenotype_stream(spark, src, cols, lambda df: C.resolve_cases(phenotype_chain(df)),
                               _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt"))
    return out.select("patient-id", *FLAG_COLS)


QUERIES["st_phenotype_stream"] = q_st_phenotype_stream


def _c13_sql():
    from phenospark.queries.criteria_queries import SQL_C13
    return SQL_C13


ORACLES["st_phenotype_stream"] = _c13_sql()
