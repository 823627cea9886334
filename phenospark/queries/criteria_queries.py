"""Registered criteria queries over the given tables (wide and long forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.functions.cells import q
from phenospark.operators import criteria as C
from phenospark.operators import events as E
from phenospark.plans import records as R
from phenospark.queries.sqlparts import CELLS, DEV, EV, LE, PAT, SEV, age_sql, hits_sql, with_

# Fixed definition parameters of the registered phenotypes.
AS_OF = R.AS_OF
BRANDS_A = ["Brand#13", "Brand#22"]
BRANDS_B = ["Brand#3"]
BRANDS_C = ["Brand#25"]
BRANDS_X = ["Brand#7"]
TEMPORAL_BEFORE = ["Brand#11", "Brand#21"]
TEMPORAL_AFTER = ["Brand#12", "Brand#22"]
TEMPORAL_MIN, TEMPORAL_MAX = 31, 186
STREAM_BEFORE, STREAM_AFTER = ["view"], ["purchase"]
STREAM_MIN, STREAM_MAX = -28, -20
KEYWORDS = ["licen[cs]e", "secret", "straße|strasse", "élé"]
KEYWORD_POS = {"legal": ["licen[cs]e", "copyright"], "credential": ["token\\s*=", "secret", "password"]}
KEYWORD_NEG = {"legal": ["mit licen[cs]e"]}
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _lst(codes):
    return ", ".join("'" + c + "'" for c in codes)


# --- cohort -----------------------------------------------------------------
def q_cohort(spark, sf):
    return R.cohort(spark, sf)


SQL_COHORT = with_(EV, PAT, LE, CELLS) + """
SELECT CAST(pat.patient_id AS VARCHAR) AS "patient-id", strftime(pat.dob, '%Y-%m-%d') AS dob,
       coalesce(cells.codes, '') AS codes, strftime(le.last_ts, '%Y-%m-%d') AS "last-encounter"
FROM pat LEFT JOIN cells USING (patient_id) LEFT JOIN le USING (patient_id)"""


# --- C1 / C1L -----------------------------------------------------------------
def q_c1_codelist(spark, sf):
    df = C.codelist(R.cohort(spark, sf), "brand-a", BRANDS_A, required=3)
    return df.select("patient-id", "brand-a-identified")


SQL_C1 = with_(EV, DEV, PAT, hits_sql("h", BRANDS_A)) + """
SELECT CAST(patient_id AS VARCHAR) AS "patient-id",
       CASE WHEN coalesce(h.n, 0) >= 3 THEN 'CASE' ELSE 'UNK' END AS "brand-a-identified"
FROM pat LEFT JOIN h USING (patient_id)"""


def q_c1l_codelist_events(spark, sf):
    return E.codelist_events(R.coded_events(spark, sf), R.patients(spark, sf), "brand-a", BRANDS_A, required=3)


SQL_C1L = with_(EV, DEV, PAT, hits_sql("h", BRANDS_A)) + """
SELECT patient_id, CASE WHEN coalesce(h.n, 0) >= 3 THEN 'CASE' ELSE 'UNK' END AS "brand-a-identified"
FROM pat LEFT JOIN h USING (patient_id)"""


# --- C2 -------------------------------------------------------------------------
def q_c2_codelist_plain(spark, sf):
    """Plain cells: per order, the comma list of its line brands."""
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand")
    cells = (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey")
             .agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("codes")))
    wide = cells.select(F.col("l_orderkey").cast("string").alias("patient-id"), "codes")
    return C.codelist_plain(wide, "brand-b", BRANDS_B)


SQL_C2 = """
WITH cells AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS codes
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT CAST(l_orderkey AS VARCHAR) AS "patient-id", codes,
       CASE WHEN list_has_any(string_split(codes, ','), ['""" + "','".join(BRANDS_B) + """']) THEN 'CASE' ELSE 'UNK' END
         AS "brand-b-identified"
FROM cells"""


# --- C3 / C3L -------------------------------------------------------------------
def q_c3_codelist_exclude(spark, sf):
    return C.codelist_exclude(R.cohort(spark, sf), "brand-x", BRANDS_X).select("patient-id", "brand-x-exclusion")


SQL_C3 = with_(EV, DEV, PAT, hits_sql("h", BRANDS_X)) + """
SELECT CAST(patient_id AS VARCHAR) AS "patient-id",
       CASE WHEN h.n IS NOT NULL THEN 'TRUE' ELSE 'FALSE' END AS "brand-x-exclusion"
FROM pat LEFT JOIN h USING (patient_id)"""


def q_c3l_exclude_events(spark, sf):
    return E.codelist_exclude_events(R.coded_events(spark, sf), R.patients(spark, sf), "brand-x", BRANDS_X)


SQL_C3L = with_(EV, DEV, PAT, hits_sql("h", BRANDS_X)) + """
SELECT patient_id, CASE WHEN h.n IS NOT NULL THEN 'TRUE' ELSE 'FALSE' END AS "brand-x-exclusion"
FROM pat LEFT JOIN h USING (patient_id)"""


# --- C4 / C4L -------------------------------------------------------------------
def q_c4_temporal(spark, sf):
    df = C.codelists_temporal(R.cohort(spark, sf), "follow-up", TEMPORAL_BEFORE, TEMPORAL_AFTER,
                              TEMPORAL_MIN, TEMPORAL_MAX)
    return df.select("patient-id", "follow-up-identified")


# Listed order of a sorted cell: the last-listed before hit is the greatest
# '(code,ts)' item, the first-listed after hit the smallest.
SQL_C4 = with_(EV, DEV, PAT) + f""",
b AS (SELECT patient_id, arg_max(ts, '(' || code || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS bts
      FROM dev WHERE code IN ({_lst(TEMPORAL_BEFORE)}) GROUP BY patient_id),
a AS (SELECT patient_id, arg_min(ts, '(' || code || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS ats
      FROM dev WHERE code IN ({_lst(TEMPORAL_AFTER)}) GROUP BY patient_id),
d AS (SELECT patient_id, CAST(floor((epoch_us(ats) - epoch_us(bts)) / 86400000000.0) AS BIGINT) AS days
      FROM b JOIN a USING (patient_id))
SELECT CAST(patient_id AS VARCHAR) AS "patient-id",
       CASE WHEN d.days > {TEMPORAL_MIN} AND d.days < {TEMPORAL_MAX} THEN 'CASE' ELSE 'UNK' END AS "follow-up-identified"
FROM pat LEFT JOIN d USING (patient_id)"""


def q_c4l_temporal_events(spark, sf):
    ev = R.stream_events(spark, sf)
    users = ev.select("patient_id").distinct()
    return E.codelists_temporal_events(ev, users, "purchase-after-view", STREAM_BEFORE, STREAM_AFTER,
                                       STREAM_MIN, STREAM_MAX)


SQL_C4L = with_(SEV) + f""",
per AS (SELECT patient_id, max(CASE WHEN code IN ({_lst(STREAM_BEFORE)}) THEN ts END) AS bts,
               min(CASE WHEN code IN ({_lst(STREAM_AFTER)}) THEN ts END) AS ats
        FROM sev WHERE ts IS NOT NULL GROUP BY patient_id),
d AS (SELECT patient_id, CAST(floor((epoch_us(ats) - epoch_us(bts)) / 86400000000.0) AS BIGINT) AS days FROM per)
SELECT patient_id,
       CASE WHEN days > {STREAM_MIN} AND days < {STREAM_MAX} THEN 'CASE' ELSE 'UNK' END AS "purchase-after-view-identified"
FROM d"""


# --- C5 / C6 --------------------------------------------------------------------
def _notes(spark, sf):
    d = R.table(spark, sf, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").cast("string").alias("patient-id"), "text")


def q_c5_keywords(spark, sf):
    return C.keywords(_notes(spark, sf), "note", KEYWORDS).select("patient-id", "note-identified")


def _re_any(col, pats):
    return " OR ".join(f"coalesce(regexp_matches({col}, '(?i)' || '{p}'), false)" for p in pats)


SQL_C5 = f"""
SELECT CAST(doc_id AS VARCHAR) AS "patient-id",
       CASE WHEN {_re_any("CAST(doc_id AS VARCHAR)", KEYWORDS)} OR {_re_any("text", KEYWORDS)} THEN 'CASE' ELSE 'UNK' END
         AS "note-identified"
FROM documents"""


def q_c6_keyword_categories(spark, sf):
    df = C.keyword_categories(_notes(spark, sf), KEYWORD_POS, KEYWORD_NEG)
    return df.select("patient-id", "legal-identified", "credential-identified")


def _cat_sql(cat):
    pos = "(" + _re_any("CAST(doc_id AS VARCHAR)", KEYWORD_POS[cat]) + " OR " + _re_any("text", KEYWORD_POS[cat]) + ")"
    if cat in KEYWORD_NEG:
        neg = "(" + _re_any("CAST(doc_id AS VARCHAR)", KEYWORD_NEG[cat]) + " OR " + _re_any("text", KEYWORD_NEG[cat]) + ")"
        pos = f"({pos} AND NOT {neg})"
    return f"CASE WHEN {pos} THEN 'CASE' ELSE 'UNK' END AS \"{cat}-identified\""


SQL_C6 = f"""
SELECT CAST(doc_id AS VARCHAR) AS "patient-id", {_cat_sql("legal")}, {_cat_sql("credential")}
FROM documents"""


# --- C7 / C8 / C9 -----------------------------------------------------------------
def _demographics(spark, sf):
    pats = R.patients(spark, sf).join(R.last_encounters(spark, sf), "patient_id", "left")
    return pats.select(F.col("patient_id").cast("string").alias("patient-id"),
                       F.date_format("dob", R.DATE_FORMAT).alias("dob"),
                       F.date_format("last_ts", R.DATE_FORMAT).alias("last-encounter"))


def q_c7_age(spark, sf):
    return C.age(_demographics(spark, sf), 30, 80, AS_OF).select("patient-id", "dob", "age-exclusion")


SQL_C7 = with_(PAT) + f"""
SELECT CAST(patient_id AS VARCHAR) AS "patient-id", strftime(dob, '%Y-%m-%d') AS dob,
       CASE WHEN {age_sql("dob")} >= 30 AND {age_sql("dob")} < 80 THEN 'FALSE' ELSE 'TRUE' END AS "age-exclusion"
FROM pat"""


def q_c8_age_identified(spark, sf):
    return C.age_identified(_demographics(spark, sf), 18, 40, AS_OF).select("patient-id", "age-identified")


SQL_C8 = with_(PAT) + f"""
SELECT CAST(patient_id AS VARCHAR) AS "patient-id",
       CASE WHEN {age_sql("dob")} >= 18 AND {age_sql("dob")} < 40 THEN 'CASE' ELSE 'UNK' END AS "age-identified"
FROM pat"""


def q_c9_last_encounter(spark, sf):
    return C.last_encounter(_demographics(spark, sf), 5, AS_OF).select("patient-id", "last-encounter",
                                                                     "last-encounter-exclusion")


SQL_C9 = with_(PAT, LE) + """
SELECT CAST(patient_id AS VARCHAR) AS "patient-id", strftime(le.last_ts, '%Y-%m-%d') AS "last-encounter",
       CASE WHEN 2002 - year(le.last_ts) < 5 THEN 'FALSE' ELSE 'TRUE' END AS "last-encounter-exclusion"
FROM pat LEFT JOIN le USING (patient_id)"""


# --- C10 -------------------------------------------------------------------------
def _order_stats(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_custkey").alias("patient_id"))
            .agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("returned_cnt"),
                 F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).cast("bigint").alias("accepted_cnt"),
                 F.sum("l_quantity").alias("qty")))


RULE = "returned_cnt >= 5 AND accepted_cnt < 12 AND qty > 300"


def q_c10_boolean_rule(spark, sf):
    return C.boolean_rule(_order_stats(spark, sf), "heavy-returner-identified", RULE,
                          ["returned_cnt", "accepted_cnt", "qty"])


SQL_C10 = f"""
WITH s AS (SELECT o_custkey AS patient_id,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned_cnt,
                  CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS accepted_cnt,
                  sum(l_quantity) AS qty
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT *, CASE WHEN {RULE} THEN 'CASE' ELSE 'UNK' END AS "heavy-returner-identified" FROM s"""


# --- C11 / C12 ----------------------------------------------------------------------
def type_codelists(spark, sf):
    """``(category, code)``: each part type lists the brands of its size-1 parts."""
    p = R.table(spark, sf, "part").select("p_type", "p_brand", "p_size").where(F.col("p_size") == 1)
    return p.select(F.col("p_type").alias("category"), F.col("p_brand").alias("code")).distinct()


def q_c11_multi_codelist(spark, sf):
    return E.multi_codelist(R.coded_events(spark, sf), R.patients(spark, sf), type_codelists(spark, sf), TYPES,
                            required=2)


def _multi_sql():
    cols = ",\n  ".join(
        f"CASE WHEN max(CASE WHEN category = '{t}' THEN n END) >= 2 THEN 'CASE' ELSE 'UNK' END AS \"{t}-identified\""
        for t in TYPES)
    return with_(EV, DEV, PAT) + f""",
cl AS (SELECT DISTINCT p_type AS category, p_brand AS code FROM part WHERE p_size = 1),
n AS (SELECT patient_id, category, count(*) AS n FROM dev JOIN cl USING (code) GROUP BY patient_id, category)
SELECT pat.patient_id,
  {cols}
FROM pat LEFT JOIN n USING (patient_id) GROUP BY pat.patient_id"""


SQL_C11 = _multi_sql()


def q_c12_extend_codelist(spark, sf):
    p = R.table(spark, sf, "part").select("p_brand", "p_size", "p_retailprice")
    static = p.where(F.col("p_size") <= 2).select(F.col("p_brand").alias("code"))
    dynamic = p.where(F.col("p_retailprice") >= 1995.0).select(F.col("p_brand").alias("code"))
    extended = E.extend_codelist(static, dynamic)
    return E.codelist_events(R.coded_events(spark, sf), R.patients(spark, sf), "extended", extended, required=25)


SQL_C12 = with_(EV, DEV, PAT) + """,
cl AS (SELECT p_brand AS code FROM part WHERE p_size <= 2 UNION SELECT p_brand FROM part WHERE p_retailprice >= 1995.0),
h AS (SELECT patient_id, count(*) AS n FROM dev WHERE code IN (SELECT code FROM cl) GROUP BY patient_id)
SELECT patient_id, CASE WHEN coalesce(h.n, 0) >= 25 THEN 'CASE' ELSE 'UNK' END AS "extended-identified"
FROM pat LEFT JOIN h USING (patient_id)"""


# --- C13 / C14: the flagship chain ---------------------------------------------------
FLAG_COLS = ["brand-a-identified", "brand-x-exclusion", "brand-b-identified", "age-exclusion",
             "last-encounter-exclusion", "brand-c-identified"]


def phenotype_chain(df):
    """codelist A (2 items) -> exclude X -> codelist B -> age 30..80 ->
    last encounter < 5 years -> codelist C; one fused projection."""
    df = C.codelist(df, "brand-a", BRANDS_A, required=2)
    df = C.codelist_exclude(df, "brand-x", BRANDS_X)
    df = C.codelist(df, "brand-b", BRANDS_B)
    df = C.age(df, 30, 80, AS_OF)
    df = C.last_encounter(df, 5, AS_OF)
    return C.codelist(df, "brand-c", BRANDS_C)


def q_c13_resolve_cases(spark, sf):
    out = C.resolve_cases(phenotype_chain(R.cohort(spark, sf)))
    return out.select("patient-id", *FLAG_COLS)


def _flags_sql():
    return with_(EV, DEV, PAT, LE, hits_sql("ha", BRANDS_A), hits_sql("hx", BRANDS_X), hits_sql("hb", BRANDS_B),
                 hits_sql("hc", BRANDS_C)) + f""",
f AS (
  SELECT pat.patient_id,
         coalesce(ha.n, 0) >= 2 AS a, hx.n IS NOT NULL AS x, hb.n IS NOT NULL AS b,
         NOT coalesce({age_sql("pat.dob")} >= 30 AND {age_sql("pat.dob")} < 80, false) AS age_ex,
         NOT coalesce(2002 - year(le.last_ts) < 5, false) AS le_ex, hc.n IS NOT NULL AS c
  FROM pat LEFT JOIN le USING (patient_id) LEFT JOIN ha USING (patient_id) LEFT JOIN hx USING (patient_id)
       LEFT JOIN hb USING (patient_id) LEFT JOIN hc USING (patient_id))
"""


def _tf(b):
    return f"CASE WHEN {b} THEN 'TRUE' ELSE 'FALSE' END"


def _cu(b):
    return f"CASE WHEN {b} THEN 'CASE' ELSE 'UNK' END"


SQL_C13 = _flags_sql() + f"""
SELECT CAST(patient_id AS VARCHAR) AS "patient-id",
       {_cu("a")} AS "brand-a-identified", {_tf("x")} AS "brand-x-exclusion",
       {_cu("b AND NOT x")} AS "brand-b-identified", {_tf("age_ex")} AS "age-exclusion",
       {_tf("le_ex")} AS "last-encounter-exclusion", {_cu("c AND NOT x AND NOT age_ex AND NOT le_ex")} AS "brand-c-identified"
FROM f"""


NESTED_GROUPS = [["brand-a-identified", "brand-b-identified"], ["brand-c-identified"]]


def q_c14_nested_cases(spark, sf):
    out = C.nested_cases(phenotype_chain(R.cohort(spark, sf)), NESTED_GROUPS, "nested-brands")
    return out.select("patient-id", "nested-brands-identified")


SQL_C14 = _flags_sql() + """
SELECT CAST(patient_id AS VARCHAR) AS "patient-id",
       CASE WHEN (a OR (b AND NOT x)) AND (c AND NOT x AND NOT age_ex AND NOT le_ex) THEN 'CASE' ELSE 'UNK' END
         AS "nested-brands-identified"
FROM f"""


def phenotype_steps():
    """The flagship chain as planned steps for the long evaluator."""
    from phenospark.plans.steplist import Step

    return [Step("codelist", "brand-a-identified", "a", "A", required=2, item=0),
            Step("exclude", "brand-x-exclusion", "x", "X", item=1),
            Step("codelist", "brand-b-identified", "b", "B", item=2),
            Step("age", "age-exclusion", lower=30, upper=80, item=3),
            Step("last_encounter", "last-encounter-exclusion", years=5, item=4),
            Step("codelist", "brand-c-identified", "c", "C", item=5)]


def phenotype_codelists(spark):
    rows = [(f, c, code) for f, c, codes in (("a", "A", BRANDS_A), ("x", "X", BRANDS_X), ("b", "B", BRANDS_B),
                                             ("c", "C", BRANDS_C)) for code in codes]
    return spark.createDataFrame(rows, "file string, category string, code string")


def q_phenotype_case_counts(spark, sf):
    """Flagship: the resolved chain over all patients, computed in the long
    form (one event join, one aggregate per patient, then projections) and
    summarised per flag value."""
    from phenospark.plans.steplist import evaluate_steplist_events

    pats = R.patients(spark, sf).join(R.last_encounters(spark, sf), "patient_id", "left")
    out = evaluate_steplist_events(R.coded_events(spark, sf), pats, phenotype_steps(), phenotype_codelists(spark), AS_OF)
    stacked = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), q(c).alias("value"))
                                             for c in FLAG_COLS])).alias("s"))
    return stacked.groupBy("s.flag", "s.value").agg(F.count(F.lit(1)).alias("patients"))


SQL_FLAGSHIP = """
SELECT flag, value, count(*) AS patients FROM (
  UNPIVOT (""" + SQL_C13.replace("\n", "\n  ") + """)
  ON COLUMNS(* EXCLUDE ("patient-id")) INTO NAME flag VALUE value)
GROUP BY flag, value"""


QUERIES = {
    "cohort": q_cohort,
    "phenotype_case_counts": q_phenotype_case_counts,
    "c1_codelist": q_c1_codelist,
    "c1l_codelist_events": q_c1l_codelist_events,
    "c2_codelist_plain": q_c2_codelist_plain,
    "c3_codelist_exclude": q_c3_codelist_exclude,
    "c3l_exclude_events": q_c3l_exclude_events,
    "c4_temporal": q_c4_temporal,
    "c4l_temporal_events": q_c4l_temporal_events,
    "c5_keywords": q_c5_keywords,
    "c6_keyword_categories": q_c6_keyword_categories,
    "c7_age": q_c7_age,
    "c8_age_identified": q_c8_age_identified,
    "c9_last_encounter": q_c9_last_encounter,
    "c10_boolean_rule": q_c10_boolean_rule,
    "c11_multi_codelist": q_c11_multi_codelist,
    "c12_extend_codelist": q_c12_extend_codelist,
    "c13_resolve_cases": q_c13_resolve_cases,
    "c14_nested_cases": q_c14_nested_cases,
}

ORACLES = {
    "cohort": SQL_COHORT,
    "phenotype_case_counts": SQL_FLAGSHIP,
    "c1_codelist": SQL_C1,
    "c1l_codelist_events": SQL_C1L,
    "c2_codelist_plain": SQL_C2,
    "c3_codelist_exclude": SQL_C3,
    "c3l_exclude_events": SQL_C3L,
    "c4_temporal": SQL_C4,
    "c4l_temporal_events": SQL_C4L,
    "c5_keywords": SQL_C5,
    "c6_keyword_categories": SQL_C6,
    "c7_age": SQL_C7,
    "c8_age_identified": SQL_C8,
    "c9_last_encounter": SQL_C9,
    "c10_boolean_rule": SQL_C10,
    "c11_multi_codelist": SQL_C11,
    "c12_extend_codelist": SQL_C12,
    "c13_resolve_cases": SQL_C13,
    "c14_nested_cases": SQL_C14,
}


def q_c4ll_temporal_listed_events(spark, sf):
    """C4 in listed order, computed on the events (no packed cells)."""
    return E.codelists_temporal_events(R.coded_events(spark, sf), R.patients(spark, sf), "follow-up",
                                       TEMPORAL_BEFORE, TEMPORAL_AFTER, TEMPORAL_MIN, TEMPORAL_MAX, order="listed")


QUERIES["c4ll_temporal_listed_events"] = q_c4ll_temporal_listed_events
ORACLES["c4ll_temporal_listed_events"] = SQL_C4.replace('SELECT CAST(patient_id AS VARCHAR) AS "patient-id",', "SELECT patient_id,")
