"""The long (events) forms give the same answers as the wide table forms."""

from pyspark.sql import functions as F

from phenospark.operators import criteria as C
from phenospark.operators import events as E
from phenospark.plans import records as R
from phenospark.plans import steplist as S
from phenospark.queries import steplist_queries as SQ
from tests.conftest import SF_ORACLE, SF_SMALL


def _by_id(df, id_col, flag):
    return {str(r[id_col]): r[flag] for r in df.select(id_col, flag).collect()}


def test_codelist_wide_equals_long(spark):
    codes = ["Brand#13", "Brand#22"]
    wide = C.codelist(R.cohort(spark, SF_SMALL), "a", codes, required=2)
    long = E.codelist_events(R.coded_events(spark, SF_SMALL), R.patients(spark, SF_SMALL), "a", codes, required=2)
    assert _by_id(wide, "patient-id", "a-identified") == _by_id(long, "patient_id", "a-identified")


def test_exclude_wide_equals_long(spark):
    wide = C.codelist_exclude(R.cohort(spark, SF_SMALL), "x", ["Brand#7"])
    long = E.codelist_exclude_events(R.coded_events(spark, SF_SMALL), R.patients(spark, SF_SMALL), "x", ["Brand#7"])
    assert _by_id(wide, "patient-id", "x-exclusion") == _by_id(long, "patient_id", "x-exclusion")


def test_temporal_date_order_wide_equals_long(spark):
    args = (["Brand#11", "Brand#21"], ["Brand#12", "Brand#22"], 31, 400)
    wide = C.codelists_temporal(R.cohort(spark, SF_SMALL), "t", *args, order="date")
    long = E.codelists_temporal_events(R.coded_events(spark, SF_SMALL), R.patients(spark, SF_SMALL), "t", *args)
    assert _by_id(wide, "patient-id", "t-identified") == _by_id(long, "patient_id", "t-identified")


def test_explode_cohort_roundtrip(spark):
    coh = R.cohort(spark, SF_SMALL)
    long = E.explode_cohort(coh, cols=["codes"])
    direct = R.coded_events(spark, SF_SMALL).select(F.col("patient_id").cast("string"), "code",
                                                       F.col("ts").cast("timestamp")).distinct()
    assert long.distinct().subtract(direct).count() == 0
    assert direct.subtract(long).count() == 0


def test_steplist_columns_and_order(spark):
    steps, cats = SQ._steps(spark, SF_ORACLE)
    assert [s.column for s in steps] == [
        "economy-brands-identified", "promo-brands-exclude-exclusion", "age-exclusion",
        "large-brands-31-to-186-days-after-small-identified", "last-encounter-exclusion", "branch-medium-identified"]
    assert S.branch_groups(steps[-1].branch) == [["medium-brands-identified"], ["standard-brands-identified"]]
    out = S.evaluate_steplist(R.cohort(spark, SF_ORACLE), steps, cats, R.AS_OF)
    assert out.columns == ["patient-id", "dob", "codes", "last-encounter"] + [
        "economy-brands-identified", "large-brands-31-to-186-days-after-small-identified", "branch-medium-identified"]


def test_steplist_rejects_unknown_kind(spark):
    cats = spark.createDataFrame([("a.csv", "A", "1")], "file string, category string, code string")
    try:
        S.plan_steplist([(1, "nonsense", "a.csv")], cats)
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_names():
    assert S.clean_name("Shortness of breath (finding), x") == "Shortness-of-breath-x"
    assert S.name_from_file("heart-failure-2_icd10.csv") == "Heart failure"


def test_flagship_chain_wide_equals_long(spark):
    from phenospark.operators import criteria as Cr
    from phenospark.plans.steplist import evaluate_steplist_events
    from phenospark.queries import criteria_queries as CQ

    wide = Cr.resolve_cases(CQ.phenotype_chain(R.cohort(spark, SF_SMALL)))
    pats = R.patients(spark, SF_SMALL).join(R.last_encounters(spark, SF_SMALL), "patient_id", "left")
    long = evaluate_steplist_events(R.coded_events(spark, SF_SMALL), pats, CQ.phenotype_steps(),
                                    CQ.phenotype_codelists(spark), R.AS_OF)
    assert long.columns[3:] == CQ.FLAG_COLS
    w = {r["patient-id"]: tuple(r[c] for c in CQ.FLAG_COLS) for r in wide.collect()}
    lg = {str(r["patient_id"]): tuple(r[c] for c in CQ.FLAG_COLS) for r in long.collect()}
    assert w == lg


def test_raw_codelists_to_steplist(spark):
    rows = [("asthma_icd10.csv", 0, {"ICD-10 code": "J45", "description": "asthma attack"}),
            ("asthma_icd10.csv", 1, {"ICD-10 code": "J46", "description": "asthma attack severe"}),
            ("copd-2_icd10.csv", 0, {"ICD-10 code": "J44", "description": "chronic obstructive"})]
    cl = spark.createDataFrame(rows, "filename string, row_no int, attrs map<string,string>")
    cats = S.steplist_categories(cl, "Asthma")
    got = sorted((r["file"], r["category"], r["code"]) for r in cats.where("category IS NOT NULL").collect())
    assert {f for f, _, _ in got} == {"asthma_icd10.csv", "copd-2_icd10.csv"}
    assert all(c.endswith(" - secondary") for _, c, _ in got)
    steps = S.plan_steplist([(1, "codelist", "asthma_icd10.csv:1"), (2, "codelistExclude", "copd-2_icd10.csv")], cats)
    df = spark.createDataFrame([("1", "(J45,2001-01-01)"), ("2", "(J45,2001-01-01),(J44,2000-01-01)")], ["patient-id", "codes"])
    out = S.evaluate_steplist(df, steps, cats, "2002-01-01")
    flag = [c for c in out.columns if c.endswith("-identified")][0]
    excl = [c for c in out.columns if c.endswith("-exclusion")][0]
    r = {x["patient-id"]: (x[flag], x[excl]) for x in out.collect()}
    assert r["1"] == ("CASE", "FALSE") and r["2"] == ("CASE", "TRUE")  # exclusion is right of the flag
    assert S.name_from_file("copd-2_icd10.csv") == "Copd"


def test_temporal_listed_order_wide_equals_long(spark):
    args = (["Brand#11", "Brand#21"], ["Brand#12", "Brand#22"], 31, 400)
    wide = C.codelists_temporal(R.cohort(spark, SF_SMALL), "t", *args, order="listed")
    long = E.codelists_temporal_events(R.coded_events(spark, SF_SMALL), R.patients(spark, SF_SMALL), "t", *args,
                                       order="listed")
    assert _by_id(wide, "patient-id", "t-identified") == _by_id(long, "patient_id", "t-identified")


def test_steplist_listed_long_equals_wide(spark):
    steps, cats = SQ._steps(spark, SF_ORACLE)
    wide = S.evaluate_steplist(R.cohort(spark, SF_ORACLE), steps, cats, R.AS_OF)
    pats = R.patients(spark, SF_ORACLE).join(R.last_encounters(spark, SF_ORACLE), "patient_id", "left")
    long = S.evaluate_steplist_events(R.coded_events(spark, SF_ORACLE), pats, steps, cats, R.AS_OF, temporal_order="listed")
    flags = SQ.OUT_FLAGS
    w = {r["patient-id"]: tuple(r[f] for f in flags) for r in wide.collect()}
    lg = {str(r["patient_id"]): tuple(r[f] for f in flags) for r in long.collect()}
    assert w == lg


def test_repeated_file_wide_equals_long(spark):
    steps, cats = SQ._repeated_steps(spark, SF_SMALL)
    flat = [s.column for s in S._flat(steps)] + [s.column for s in steps if s.kind == "branch"]
    assert len(set(flat)) == len(flat) and "age-2-exclusion" in flat and "economy-brands-3-identified" in flat
    wide = S.evaluate_steplist(R.cohort(spark, SF_SMALL), steps, cats, R.AS_OF)
    long = SQ.q_c16r_steplist_repeated_file(spark, SF_SMALL)
    w = {r["patient-id"]: tuple(r[f] for f in SQ.REPEATED_FLAGS) for r in wide.collect()}
    assert w == {str(r[0]): tuple(r)[1:] for r in long.collect()}
    assert any("CASE" in x for x in w.values())


def test_file_category_tells_steps_apart(spark):
    cats = spark.createDataFrame([("a.csv", "Asthma", "1"), ("b.csv", "Asthma", "2")], "file string, category string, code string")
    rows = [(1, "codelist", "a.csv:1"), (2, "codelist", "b.csv:1")]
    assert [s.column for s in S.plan_steplist(rows, cats, file_categories={"a.csv": "Primary Care", "b.csv": "secondary"})] == [
        "asthma-primary-care-identified", "asthma-secondary-identified"]
    assert [s.column for s in S.plan_steplist(rows, cats)] == ["asthma-identified", "asthma-2-identified"]


def test_temporal_before_codes_use_whole_file(spark):
    rows = [("flu_icd10.csv", 0, {"ICD-10 code": "J10", "description": "influenza virus", "Case_Incl": "Y"}),
            ("flu_icd10.csv", 1, {"ICD-10 code": "J11", "description": "influenza virus", "Case_Incl": "N"}),
            ("pneumonia_icd10.csv", 0, {"ICD-10 code": "J18", "description": "pneumonia lobar"})]
    cl = spark.createDataFrame(rows, "filename string, row_no int, attrs map<string,string>")
    cats = S.steplist_categories(cl, "Flu")
    named = {r["code"] for r in cats.where("file = 'flu_icd10.csv' AND category IS NOT NULL").collect()}
    assert named == {"J10"}                                    # excluded row has no category
    steps = S.plan_steplist([(1, "codelistsTemporal", "flu_icd10.csv:pneumonia_icd10.csv:1:30")], cats)
    assert len(steps) == 1
    df = spark.createDataFrame([("1", "(J11,2001-01-01),(J18,2001-01-10)"), ("2", "(J18,2001-01-10)")],
                               ["patient-id", "codes"])
    out = S.evaluate_steplist(df, steps, cats, "2002-01-01")
    flag = steps[0].column
    got = {r["patient-id"]: r[flag] for r in out.collect()}
    assert got == {"1": "CASE", "2": "UNK"}                     # J11 counts as a before code
    pats = spark.createDataFrame([(1, None, None), (2, None, None)], "patient_id long, dob date, last_ts timestamp")
    ev = spark.createDataFrame([(1, "J11", "2001-01-01"), (1, "J18", "2001-01-10"), (2, "J18", "2001-01-10")],
                               "patient_id long, code string, ts string").selectExpr("patient_id", "code", "CAST(ts AS TIMESTAMP) AS ts")
    long = S.evaluate_steplist_events(ev, pats, steps, cats, "2002-01-01")
    assert {r["patient_id"]: r[flag] for r in long.collect()} == {1: "CASE", 2: "UNK"}
