"""Registered queries of file formats: mixed NDJSON exports, codelist and steplist
files, nested JSON results, published datasets.  Each writes the given tables in the
format, with planted faults, and reads them back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import tbc as T
from phenospark.operators import tbc_json as J
from phenospark.plans import records as R
from phenospark.queries.learning_queries import GIVEN, K, SQL_T2, given_partitions
from phenospark.queries.source_queries import _fhir_frames, _scratch
from phenospark.sources import files as SF
from phenospark.sources import ndjson as N
from phenospark.sources import tabular as ST

#: Every so many conditions, patients and encounters carry a planted fault.
FAULT_EVERY = 50
CHUNK = 100


# --- S2: NDJSON of mixed resources -------------------------------------------------
def _export(spark, sf):
    """One folder of mixed resources; faults depend on the row's numbers only."""
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    fault = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % FAULT_EVERY
    ref = lambda kind, key: F.struct(F.concat(F.lit(kind), key.cast("string")).alias("reference"))
    cond = F.to_json(F.struct(
        F.lit("Condition").alias("resourceType"), F.when(fault != 1, ref("Patient/", F.col("o_custkey"))).alias("subject"),
        F.when(fault != 2, ref("Encounter/", F.col("l_orderkey"))).alias("context"),
        F.when(fault != 3, F.struct(F.array(F.struct(F.col("p_brand").alias("code"))).alias("coding"))).alias("code")))
    cond = F.when(fault == 0, F.substring(cond, 1, 40)).otherwise(cond)  # a line cut short
    _, pat, enc = _fhir_frames(spark, sf)
    gone = lambda c: c.cast("long") % FAULT_EVERY == 7
    pats = pat.where(~gone(F.col("id"))).select(F.to_json(F.struct(F.lit("Patient").alias("resourceType"), "id", "birthDate")).alias("value"))
    end = F.when(F.col("id").cast("long") % FAULT_EVERY == 9, F.struct(F.lit("soon").alias("end"))).otherwise(F.col("period"))
    encs = enc.where(~gone(F.col("id"))).select(F.to_json(F.struct(F.lit("Encounter").alias("resourceType"), "id", end.alias("period"))).alias("value"))
    other = pat.select(F.to_json(F.struct(F.lit("Practitioner").alias("resourceType"), "id")).alias("value"))
    typeless = pat.where(F.col("id").cast("long") % FAULT_EVERY == 11).select(F.to_json(F.struct("id")).alias("value"))
    path = _scratch(spark, "ndjson")
    rows.select(cond.alias("value")).unionByName(pats).unionByName(encs).unionByName(other).unionByName(typeless).write.text(path)
    return N.record_tables(spark, N.scan_resources(spark, path))


def q_s2n_events_from_ndjson(spark, sf):
    return _export(spark, sf).events


def q_s2n_cohort_from_ndjson(spark, sf):
    got = _export(spark, sf)
    return N.cases_from_events(got.events, got.patients)


def q_s2n_rejects(spark, sf):
    """Rejected rows a reason, beside what the same passes observed."""
    got = _export(spark, sf)
    counts = spark.createDataFrame(list(got.counts.items()), "what string, seen long")
    found = got.rejects.groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("rejected"))
    return counts.join(found, "what", "full")


_NDJSON = f"""
c AS (SELECT (l_orderkey * 7 + l_linenumber) % {FAULT_EVERY} AS fault, o_custkey AS patient, l_orderkey AS encounter, p_brand AS code, o_orderdate AS d
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
j AS (SELECT *, patient % {FAULT_EVERY} <> 7 AND patient IN (SELECT c_custkey FROM customer) AS known, encounter % {FAULT_EVERY} NOT IN (7, 9) AS dated
      FROM c WHERE fault > 3),
ok AS (SELECT * FROM j WHERE known AND dated)"""
SQL_S2N_EVENTS = f"WITH {_NDJSON} SELECT DISTINCT CAST(patient AS VARCHAR) AS patient_id, code, CAST(d AS TIMESTAMP) AS ts FROM ok"
SQL_S2N_COHORT = f"""WITH {_NDJSON}
SELECT CAST(patient AS VARCHAR) AS "patient-id", strftime(DATE '1920-01-01' + CAST((patient * 7919) % 36500 AS INTEGER), '%Y-%m-%d') AS dob,
       array_to_string(list_sort(list(DISTINCT '(' || code || ',' || strftime(d, '%Y-%m-%dT%H:%M:%S.%g') || 'Z)')), ',') AS codes,
       strftime(max(d), '%Y-%m-%dT%H:%M:%S.%g') AS "last-encounter"
FROM ok GROUP BY patient"""
SQL_S2N_REJECTS = f"""WITH {_NDJSON},
n AS (SELECT (SELECT count(*) FROM c WHERE fault = 0) AS cut, (SELECT count(*) FROM c WHERE fault IN (1, 2, 3)) AS lacking, (SELECT count(*) FROM j) AS conditions,
             (SELECT count(*) FROM customer WHERE c_custkey % {FAULT_EVERY} <> 7) AS patients, (SELECT count(*) FROM customer) AS people,
             (SELECT count(*) FROM customer WHERE c_custkey % {FAULT_EVERY} = 11) AS typeless,
             (SELECT count(*) FROM orders WHERE o_orderkey % {FAULT_EVERY} NOT IN (7, 9)) AS encounters, (SELECT count(*) FROM orders WHERE o_orderkey % {FAULT_EVERY} = 9) AS undated),
seen AS (SELECT 'lines' AS what, cut + lacking + conditions + patients + people + typeless + encounters + undated AS seen FROM n
         UNION ALL SELECT 'condition', conditions FROM n UNION ALL SELECT 'patient', patients FROM n UNION ALL SELECT 'encounter', encounters FROM n
         UNION ALL SELECT 'reject', cut + lacking + typeless + undated FROM n UNION ALL SELECT 'other', people FROM n
         UNION ALL SELECT 'accepted', (SELECT count(*) FROM ok) UNION ALL SELECT 'unknown patient', (SELECT count(*) FROM j WHERE NOT known)
         UNION ALL SELECT 'unknown encounter', (SELECT count(*) FROM j WHERE known AND NOT dated)),
rejected AS (SELECT CASE fault WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no patient reference' WHEN 2 THEN 'no encounter reference' ELSE 'no code' END AS what, count(*) AS rejected
             FROM c WHERE fault <= 3 GROUP BY 1
             UNION ALL SELECT 'no resource type', typeless FROM n WHERE typeless > 0 UNION ALL SELECT 'no end date', undated FROM n WHERE undated > 0
             UNION ALL SELECT 'unknown patient', count(*) FROM j WHERE NOT known HAVING count(*) > 0
             UNION ALL SELECT 'unknown encounter', count(*) FROM j WHERE known AND NOT dated HAVING count(*) > 0)
SELECT what, CAST(seen AS BIGINT) AS seen, rejected FROM seen FULL JOIN rejected USING (what)"""


# --- S6, S7: files with headers of their own, equal names in two folders -----------
def _codelist_files(spark, sf):
    """``part`` as codelist files: a file a brand, in two folders by size, so names
    repeat; two header forms; descriptions with commas, quotes and line breaks."""
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    num = F.regexp_extract("p_brand", r"#([0-9]+)", 1).cast("int")
    text = F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, ',\n"').when(F.col("p_partkey") % 5 == 1, "\n\n").otherwise(" "), F.col("p_name"),
                    F.when(F.col("p_partkey") % 7 == 0, '"').otherwise(""))
    rows = p.select(F.when(F.col("p_size") > 25, "large").otherwise("small").alias("folder"), F.concat(F.lit("brand-"), num.cast("string")).alias("name"),
                    num.alias("num"), "p_partkey", F.col("p_partkey").cast("string").alias("code"), text.alias("description"))
    base = _scratch(spark, "codelist files")
    for primary, header in ((True, "Read Code"), (False, "ICD-10 code")):
        part = rows.where((F.col("num") <= 9) == F.lit(primary)).select("folder", "name", "p_partkey", F.col("code").alias(header), F.col("description").alias("Description"))
        dealt = part.repartition("folder", "name").sortWithinPartitions("folder", "name", "p_partkey").drop("p_partkey")
        dealt.write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).partitionBy("folder", "name").csv(base)
    return base


def q_s6_codelist_files(spark, sf):
    got = SF.read_codelists(spark, _codelist_files(spark, sf), recursive=True)
    part = lambda k: F.regexp_extract("filename", f"{k}=([^/]*)/", 1).alias(k)
    return got.select(part("folder"), part("name"), "row_no", F.explode("attrs").alias("key", "value"))


_S6_ROWS = """
SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS folder, 'brand-' || regexp_extract(p_brand, '#([0-9]+)', 1) AS name,
       CAST(row_number() OVER (PARTITION BY p_size > 25, p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS row_no, p_partkey,
       CASE WHEN CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) <= 9 THEN 'Read Code' ELSE 'ICD-10 code' END AS header,
       p_type || CASE WHEN p_partkey % 5 = 0 THEN ',' || chr(10) || '"' WHEN p_partkey % 5 = 1 THEN chr(10) || chr(10) ELSE ' ' END || p_name
              || CASE WHEN p_partkey % 7 = 0 THEN '"' ELSE '' END AS description
FROM part"""
SQL_S6 = f"""WITH r AS ({_S6_ROWS})
SELECT folder, name, row_no, header AS key, CAST(p_partkey AS VARCHAR) AS value FROM r
UNION ALL SELECT folder, name, row_no, 'Description', description FROM r"""


def q_s7_steplist_files(spark, sf):
    """Steplists out of ``part``: a file a brand, a row a part, in order."""
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    rows = p.select(F.regexp_replace("p_brand", "#", "-").alias("name"), "p_partkey",
                    F.when(F.col("p_size") % 3 == 0, "codelist").when(F.col("p_size") % 3 == 1, "codelistExclude").otherwise("age").alias("logicType"),
                    F.concat(F.lower("p_type"), F.lit(".csv:"), F.col("p_size").cast("string")).alias("param"))
    base = _scratch(spark, "steplists")
    rows.repartition("name").sortWithinPartitions("name", "p_partkey").drop("p_partkey").write.option("header", True).partitionBy("name").csv(base)
    got = SF.read_steplist(spark, base, recursive=True)
    return got.select(F.regexp_extract("filename", "name=([^/]*)/", 1).alias("name"), "seq", "logicType", "param")


SQL_S7 = """
SELECT replace(p_brand, '#', '-') AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS seq,
       CASE p_size % 3 WHEN 0 THEN 'codelist' WHEN 1 THEN 'codelistExclude' ELSE 'age' END AS "logicType",
       lower(p_type) || '.csv:' || CAST(p_size AS VARCHAR) AS param
FROM part"""


# --- S10: versions of a dataset ----------------------------------------------------
def q_s10_published_dataset(spark, sf):
    """Published twice; the second publication replaces the first."""
    path = _scratch(spark, "dataset")
    c = R.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ST.publish_dataset(c, path)
    ST.publish_dataset(c.where(F.col("c_mktsegment") != "BUILDING"), path, replace=True)
    return ST.read_dataset(spark, path)


# --- nested JSON results -----------------------------------------------------------
def _lines(spark, sf):
    return J.partition_lines(T.partitions_long(given_partitions(spark, sf), K), K, chunk=CHUNK)


def q_j1_partition_lines(spark, sf):
    return _lines(spark, sf)


def q_j1_partitions_roundtrip(spark, sf):
    path = _scratch(spark, "partitions")
    J.write_lines(_lines(spark, sf), path)
    rows, _ = J.parse_partitions(J.read_lines(spark, path))
    return rows


def _matrix(spark, sf):
    wide = given_partitions(spark, sf)
    path = _scratch(spark, "matrix")
    J.write_lines(J.matrix_lines(T.partitions_long(wide, K), T.tbc_matches(wide, K, "jaccard"), K, chunk=CHUNK), path)
    return J.parse_matrix(J.read_lines(spark, path))


def q_j2_matrix_matches(spark, sf):
    return _matrix(spark, sf)[1]


def q_j2_matrix_members(spark, sf):
    return _matrix(spark, sf)[0]


SQL_J1_LINES = "WITH " + GIVEN + f""",
a AS (SELECT k, c, row_id // {CHUNK} AS ordinal, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS ids FROM lng GROUP BY ALL),
e AS (SELECT kk.k, cc.c FROM (SELECT unnest(range(2, 6)) AS k) kk, LATERAL (SELECT unnest(range(0, kk.k)) AS c) cc),
l AS (SELECT e.k, e.c, coalesce(ordinal, 0) AS ordinal, coalesce(ids, '') AS ids FROM e LEFT JOIN a ON a.k = e.k AND a.c = e.c)
SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster, CAST(ordinal AS BIGINT) AS ordinal,
       '{{"partition_k_' || k || '":{{"cluster_' || c || '":[' || ids || ']}}}}' AS json FROM l"""
SQL_J1 = "WITH " + GIVEN + " SELECT CAST(row_id AS BIGINT) AS row_id, k, c AS cluster FROM lng"
SQL_J2_MEMBERS = "WITH " + GIVEN + " SELECT CAST(row_id AS BIGINT) AS row_id, k, c AS cluster FROM lng WHERE k = 5"

QUERIES = {
    "s2n_events_from_ndjson": q_s2n_events_from_ndjson,
    "s2n_cohort_from_ndjson": q_s2n_cohort_from_ndjson,
    "s2n_rejects": q_s2n_rejects,
    "s6_codelist_files": q_s6_codelist_files,
    "s7_steplist_files": q_s7_steplist_files,
    "s10_published_dataset": q_s10_published_dataset,
    "j1_partition_lines": q_j1_partition_lines,
    "j1_partitions_roundtrip": q_j1_partitions_roundtrip,
    "j2_matrix_matches": q_j2_matrix_matches,
    "j2_matrix_members": q_j2_matrix_members,
}
ORACLES = {
    "s2n_events_from_ndjson": SQL_S2N_EVENTS,
    "s2n_cohort_from_ndjson": SQL_S2N_COHORT,
    "s2n_rejects": SQL_S2N_REJECTS,
    "s6_codelist_files": SQL_S6,
    "s7_steplist_files": SQL_S7,
    "s10_published_dataset": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "j1_partition_lines": SQL_J1_LINES,
    "j1_partitions_roundtrip": SQL_J1,
    "j2_matrix_matches": SQL_T2,
    "j2_matrix_members": SQL_J2_MEMBERS,
}
