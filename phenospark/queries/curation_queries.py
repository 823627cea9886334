"""Registered curation queries: the ``part`` table as a set of codelists.

Each brand is one codelist file (``brand-<n>_read.csv`` for brands 1-9 with a
Read-code header, ``brand-<n>_icd10.csv`` otherwise); a part is a row with
its key as code, ``"<type> <name>"`` as description, and ``Case_Incl = N``
for the largest sizes.  The phenotype name is "Part"."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenospark.operators import codelists as K
from phenospark.plans import records as R
from phenospark.session import spread

NAME = "Part"
EXCLUDED_SIZE = 45


def raw_codelists(spark, sf):
    p = spread(R.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size"), "p_partkey")
    num = F.regexp_extract("p_brand", r"#([0-9]+)", 1).cast("int")
    primary = num <= 9
    fname = F.concat(F.lit("brand-"), num.cast("string"), F.when(primary, F.lit("_read.csv")).otherwise(F.lit("_icd10.csv")))
    code_key = F.when(primary, F.lit("Read Code")).otherwise(F.lit("ICD-10 code"))
    attrs = F.map_from_arrays(
        F.array(code_key, F.lit("Description"), F.lit("Case_Incl")),
        F.array(F.col("p_partkey").cast("string"), F.concat_ws(" ", "p_type", "p_name"),
                F.when(F.col("p_size") > EXCLUDED_SIZE, F.lit("N")).otherwise(F.lit("Y"))))
    return p.select(fname.alias("filename"), F.col("p_partkey").alias("row_no"), attrs.alias("attrs"))


def codelists(spark, sf):
    return K.clean_headers(raw_codelists(spark, sf)).withColumn("name", F.lit(NAME))


def q_k1_clean_headers(spark, sf):
    cl = codelists(spark, sf)
    return cl.select("filename", "row_no", F.explode("attrs").alias("key", "value"))


def q_k2_resolve_code(spark, sf):
    ok, _ = K.resolve_code(codelists(spark, sf))
    return ok.select("filename", "row_no", "code")


def q_k3_resolve_description(spark, sf):
    return K.resolve_description(codelists(spark, sf)).select("filename", "row_no", "description")


def q_k4_coding_system_group(spark, sf):
    return K.coding_system_group(codelists(spark, sf))


def q_k5_term_counts(spark, sf):
    return K.term_counts(codelists(spark, sf)).select("filename", "term", "n", "rank")


def q_k6_non_differentiating(spark, sf):
    tc = K.term_counts(codelists(spark, sf)).select("filename", "term", "n")
    return K.non_differentiating_terms(tc).select("filename", "term", "n", "frequent", "excluded")


def q_k7_file_category(spark, sf):
    return K.file_category(codelists(spark, sf))


def q_k8_categories(spark, sf):
    return K.categories(codelists(spark, sf))


def q_k13_fingerprint(spark, sf):
    return K.fingerprint(raw_codelists(spark, sf))


FILE = """CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER)"""
FNAME = f"""'brand-' || CAST({FILE} AS VARCHAR) || CASE WHEN {FILE} <= 9 THEN '_read.csv' ELSE '_icd10.csv' END"""
CODEKEY = f"""CASE WHEN {FILE} <= 9 THEN 'readcode' ELSE 'icd10code' END"""
INCL = f"p_size <= {EXCLUDED_SIZE}"

SQL_K1 = f"""
SELECT {FNAME} AS filename, p_partkey AS row_no, {CODEKEY} AS key, CAST(p_partkey AS VARCHAR) AS value FROM part
UNION ALL SELECT {FNAME}, p_partkey, 'description', p_type || ' ' || p_name FROM part
UNION ALL SELECT {FNAME}, p_partkey, 'caseincl', CASE WHEN p_size > {EXCLUDED_SIZE} THEN 'N' ELSE 'Y' END FROM part"""

SQL_K2 = f"SELECT {FNAME} AS filename, p_partkey AS row_no, CAST(p_partkey AS VARCHAR) AS code FROM part"
SQL_K3 = f"SELECT {FNAME} AS filename, p_partkey AS row_no, p_type || ' ' || p_name AS description FROM part"
SQL_K4 = f"""SELECT DISTINCT {FNAME} AS filename, CASE WHEN {FILE} <= 9 THEN 'primary' ELSE 'secondary' END AS system_group
FROM part WHERE {INCL}"""


def _sing(t):
    return (f"CASE WHEN regexp_matches({t}, '[a-z]{{2}}ies$') THEN regexp_replace({t}, 'ies$', 'y') "
            f"WHEN regexp_matches({t}, '(ss|us|is)$') THEN {t} "
            f"WHEN regexp_matches({t}, '(ches|shes|xes|sses)$') THEN regexp_replace({t}, 'es$', '') "
            f"WHEN regexp_matches({t}, '[a-z]{{3}}s$') THEN regexp_replace({t}, 's$', '') ELSE {t} END")


TERMS = f"""
w AS (SELECT {FNAME} AS filename, p_partkey AS row_no, 0 AS pos, p_type AS raw FROM part WHERE {INCL}
      UNION ALL SELECT {FNAME}, p_partkey, 1, split_part(p_name, ' ', 1) FROM part WHERE {INCL}
      UNION ALL SELECT {FNAME}, p_partkey, 2, split_part(p_name, ' ', 2) FROM part WHERE {INCL}),
c AS (SELECT filename, row_no, pos, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS t0 FROM w),
s AS (SELECT filename, row_no, pos, {_sing("t0")} AS term FROM c),
f AS (SELECT * FROM s WHERE length(term) >= 5 AND NOT (contains('part', term) OR contains(term, 'part'))),
tc AS (SELECT filename, term, count(*) AS n, min(row_no * 10 + pos) AS firstpos FROM f GROUP BY filename, term HAVING count(*) > 1),
rk AS (SELECT filename, term, n, CAST(row_number() OVER (PARTITION BY filename ORDER BY n DESC, firstpos) AS INTEGER) AS rank FROM tc)"""

SQL_K5 = "WITH " + TERMS + "\nSELECT filename, term, n, rank FROM rk"

ND = TERMS + """,
tot AS (SELECT filename, sum(n) AS total FROM rk GROUP BY filename),
fr AS (SELECT rk.filename, rk.term, rk.n, rk.rank, rk.n / tot.total >= 0.15 AS frequent FROM rk JOIN tot USING (filename)),
nd AS (SELECT a.*, EXISTS (SELECT 1 FROM fr b WHERE b.filename = a.filename AND b.frequent AND b.term <> a.term
                           AND contains(b.term, a.term)) AS excluded FROM fr a)"""

SQL_K6 = "WITH " + ND + "\nSELECT filename, term, n, frequent, excluded FROM nd"

SQL_K7 = "WITH " + ND.replace(f" WHERE {INCL}", "") + f""",
rows AS (SELECT {FNAME} AS filename, count(*) AS nrows FROM part GROUP BY 1),
top AS (SELECT filename, arg_min(term, rank) AS term, arg_min(n, rank) AS n FROM nd WHERE NOT excluded GROUP BY filename)
SELECT rows.filename, CASE WHEN top.n >= rows.nrows THEN top.term ELSE '' END AS file_category
FROM rows LEFT JOIN top USING (filename)"""

SQL_K13 = f"""
WITH r AS (SELECT {FNAME} AS filename, p_partkey AS row_no,
                  'Case_Incl=' || CASE WHEN p_size > {EXCLUDED_SIZE} THEN 'N' ELSE 'Y' END AS e1,
                  'Description=' || p_type || ' ' || p_name AS e2,
                  CASE WHEN {FILE} <= 9 THEN 'Read Code' ELSE 'ICD-10 code' END || '=' || CAST(p_partkey AS VARCHAR) AS e3
           FROM part),
t AS (SELECT filename, sha1(CAST(row_no AS VARCHAR) || '#' || array_to_string(list_sort([e1, e2, e3]), '|')) AS h FROM r)
SELECT filename, CAST(sum(CAST(CAST('0x' || substr(h, 1, 14) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' ||
       CAST(sum(CAST(CAST('0x' || substr(h, 15, 14) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' ||
       CAST(sum(CAST(CAST('0x' || substr(h, 29, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint
FROM t GROUP BY filename"""

QUERIES = {
    "k1_clean_headers": q_k1_clean_headers,
    "k2_resolve_code": q_k2_resolve_code,
    "k3_resolve_description": q_k3_resolve_description,
    "k4_coding_system_group": q_k4_coding_system_group,
    "k5_term_counts": q_k5_term_counts,
    "k6_non_differentiating": q_k6_non_differentiating,
    "k7_file_category": q_k7_file_category,
    "k8_categories": q_k8_categories,
    "k13_fingerprint": q_k13_fingerprint,
}
ORACLES = {
    "k1_clean_headers": SQL_K1,
    "k2_resolve_code": SQL_K2,
    "k3_resolve_description": SQL_K3,
    "k4_coding_system_group": SQL_K4,
    "k5_term_counts": SQL_K5,
    "k6_non_differentiating": SQL_K6,
    "k7_file_category": SQL_K7,
    "k13_fingerprint": SQL_K13,
}


# --- keyword lists, step names, definition groups --------------------------------------
KEYWORD_LIST = ["licen[cs]e agreement", "licen[cs]e", "copyright notice", "secret token", r"\\bpassword\\b"]


def q_c17_keyword_list(spark, sf):
    from phenospark.plans.keywords import evaluate_keyword_list

    kw = spark.createDataFrame(list(enumerate(KEYWORD_LIST)), "row_no long, keyword string")
    d = R.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("patient-id"), "text")
    return evaluate_keyword_list(d, kw, "Legal")


def q_k18_distinct_step_names(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    steps = (li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
             .select(F.col("l_orderkey").alias("definition"), F.col("l_linenumber").alias("position"),
                     F.concat(F.lower("f"), F.lit("-step")).alias("name"), F.lower("s").alias("file_category")))
    return K.distinct_step_names(steps)


def q_k19_group_definitions(spark, sf):
    p = R.table(spark, sf, "part").select("p_type", "p_size", "p_brand")
    meta = p.select(F.initcap("p_type").alias("name"),
                    F.when(F.col("p_size") > 25, "large").otherwise("small").alias("title"),
                    F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit(".csv")).alias("filename"))
    return K.group_definitions(meta)


SQL_K18 = """
WITH st AS (SELECT l_orderkey AS definition, l_linenumber AS position, lower(min(l_returnflag)) || '-step' AS name,
                   lower(min(l_linestatus)) AS file_category FROM lineitem GROUP BY l_orderkey, l_linenumber),
c1 AS (SELECT definition, name, count(*) AS n FROM st GROUP BY ALL),
s AS (SELECT st.*, CASE WHEN c1.n > 1 AND coalesce(file_category, '') <> '' THEN st.name || '-' || file_category ELSE st.name END AS step_name
      FROM st JOIN c1 USING (definition, name)),
c2 AS (SELECT definition, step_name, count(*) AS m FROM s GROUP BY ALL)
SELECT s.definition, s.position, s.name, s.step_name, c2.m > 1 AS rejected FROM s JOIN c2 USING (definition, step_name)"""

SQL_K19 = """
SELECT upper(p_type[1]) || lower(p_type[2:]) AS name, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS title,
       list_sort(list(DISTINCT lower(replace(p_brand, '#', '-')) || '.csv')) AS files
FROM part GROUP BY ALL"""

QUERIES.update({"c17_keyword_list": q_c17_keyword_list, "k18_distinct_step_names": q_k18_distinct_step_names,
                "k19_group_definitions": q_k19_group_definitions})
ORACLES.update({"k18_distinct_step_names": SQL_K18, "k19_group_definitions": SQL_K19})


def _nb(x):
    """Numbered bigrams of x in DuckDB list functions."""
    return (f"list_transform(range(1, length({x})), lambda i: substr({x}, i, 2) || '#' || "
            f"CAST(len(list_filter(range(1, i + 1), lambda j: substr({x}, j, 2) = substr({x}, i, 2))) AS VARCHAR))")


SQL_K8 = "WITH " + ND + f""",
cand AS (SELECT filename, term AS cterm, rank FROM nd WHERE NOT excluded),
words AS (SELECT filename, row_no, term AS sw FROM s WHERE term <> ''),
pairs AS (SELECT w.filename, w.row_no, c.cterm, c.rank,
                 CASE WHEN w.sw = c.cterm THEN 1.0 WHEN length(w.sw) < 2 OR length(c.cterm) < 2 THEN 0.0
                      ELSE 2.0 * len(list_intersect({_nb("w.sw")}, {_nb("c.cterm")})) / (length(w.sw) + length(c.cterm) - 2) END AS dice,
                 contains(c.cterm, w.sw) OR contains(w.sw, c.cterm) AS contained
          FROM words w JOIN cand c USING (filename)),
best AS (SELECT filename, row_no, arg_max(cterm, rank) AS matched FROM pairs WHERE dice >= 0.8 OR contained GROUP BY ALL),
grp AS (SELECT DISTINCT {FNAME} AS filename, CASE WHEN {FILE} <= 9 THEN 'primary' ELSE 'secondary' END AS g FROM part WHERE {INCL}),
r AS (SELECT {FNAME} AS filename, p_partkey AS row_no, CAST(p_partkey AS VARCHAR) AS code FROM part WHERE {INCL}),
k AS (SELECT r.*, coalesce(best.matched, 'Part') AS key, grp.g FROM r LEFT JOIN best USING (filename, row_no) JOIN grp USING (filename)),
lab AS (SELECT *, CASE WHEN contains(regexp_replace(lower(key), '[^a-z0-9]', '', 'g'), 'part')
                            OR contains('part', regexp_replace(lower(key), '[^a-z0-9]', '', 'g')) THEN key ELSE key || ' Part' END AS app
        FROM k),
sw AS (SELECT *, CASE WHEN len(string_split(app, ' ')) = 2 AND lower(string_split(app, ' ')[2]) = 'part'
                           AND NOT regexp_matches(lower(string_split(app, ' ')[1]), '(ic|al|ous|ive|ful|less|able|ible|ary|ant|ent|ed|ing)$')
                      THEN 'part ' || lower(string_split(app, ' ')[1]) ELSE app END AS swapped FROM lab)
SELECT CASE WHEN key = 'Part' THEN key ELSE upper(substr(swapped, 1, 1)) || substr(swapped, 2) END || ' - ' || g AS category,
       filename, row_no, code
FROM sw"""

ORACLES["k8_categories"] = SQL_K8


# --- codelists of a group, imported together -------------------------------------------
def _groups(spark, sf):
    """A group for each header form and last digit: brands of one form share a header."""
    cl = raw_codelists(spark, sf)
    num = F.regexp_extract("filename", "brand-([0-9]+)_", 1).cast("int")
    title = F.concat(F.when(num <= 9, "read-").otherwise("icd10-"), (num % 3).cast("string"))
    return cl.select(F.lit(NAME).alias("name"), title.alias("title"), "filename").distinct(), cl


def q_k19u_group_codelists(spark, sf):
    return K.group_codelists(*_groups(spark, sf)).select("title", "row_no", "source", "source_row")


def q_k19u_group_categories(spark, sf):
    return K.group_categories(*_groups(spark, sf)).select("title", "category", "source", "source_row", "code")


_VPART = f"""
f AS (SELECT {FNAME} AS source, CASE WHEN {FILE} <= 9 THEN 'read-' ELSE 'icd10-' END || CAST({FILE} % 3 AS VARCHAR) AS title, max(p_partkey) + 1 AS size
      FROM part GROUP BY ALL),
o AS (SELECT source, title, coalesce(sum(size) OVER (PARTITION BY title ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
vpart AS (SELECT part.*, o.title AS vname, CAST(o.start + p_partkey AS BIGINT) AS vrow, source FROM part JOIN o ON {FNAME} = o.source)"""
SQL_K19U_ROWS = f"WITH {_VPART} SELECT vname AS title, vrow AS row_no, source, p_partkey AS source_row FROM vpart"
# K8's own SQL over the virtual files
_K8_GROUPS = (SQL_K8.replace(FNAME, "vname").replace("p_partkey AS row_no", "vrow AS row_no").replace("vname, p_partkey,", "vname, vrow,")
              .replace("FROM part", "FROM vpart"))
SQL_K19U = f"WITH {_VPART}, k8 AS ({_K8_GROUPS}) " + """
SELECT k8.filename AS title, category, source, p_partkey AS source_row, code FROM k8 JOIN vpart ON vname = k8.filename AND vrow = k8.row_no"""
QUERIES.update({"k19u_group_codelists": q_k19u_group_codelists, "k19u_group_categories": q_k19u_group_categories})
ORACLES.update({"k19u_group_codelists": SQL_K19U_ROWS, "k19u_group_categories": SQL_K19U})

# KEYWORD_LIST as K5 and K8 see it: the list's one common term names two keywords, the others go by the name or by themselves
_FLAG = """CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN 'CASE' ELSE 'UNK' END AS "{c}-identified\""""
ORACLES["c17_keyword_list"] = 'SELECT CAST(doc_id AS VARCHAR) AS "patient-id", text, ' + ", ".join(
    _FLAG.format(p=p, c=c) for p, c in (("licen[cs]e", "legal-licencse---secondary"), ("copyright notice|secret token", "legal---secondary"),
                                        ("password", "legal-password---secondary"))) + " FROM documents"
