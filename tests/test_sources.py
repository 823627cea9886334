"""Readers of exports and definition files, on small in-test files."""

import json

import pytest

from phenospark import sources as S
from phenospark.sources.registry import COHORT_COLUMNS


def test_read_cohort_csv_keeps_strings(spark, tmp_path):
    p = tmp_path / "cases.csv"
    p.write_text('patient-id,dob,codes,keywords,last-encounter\n'
                 '1,1979-01-01,"(X01,2004-10-17T00:00:00.000),(Y01,2004-10-17T00:00:00.000)","keyword1,keyword2",2020-01-01\n'
                 '2,2020-01-01,,"k",1920-01-01\n')
    df = S.read_cohort_csv(spark, str(p))
    assert df.columns == ["patient-id", "dob", "codes", "keywords", "last-encounter"]
    rows = {r["patient-id"]: r for r in df.collect()}
    assert len(rows) == 2 and rows["2"]["codes"] == ""
    assert rows["1"]["codes"].startswith("(X01,")


def test_write_then_read(spark, tmp_path):
    df = spark.createDataFrame([("1", "x,y", "CASE")], ["patient-id", "codes", "a-identified"])
    S.write_cases(df, str(tmp_path / "out"))
    back = S.read_cohort_csv(spark, str(tmp_path / "out"))
    assert back.columns == df.columns and back.collect()[0]["codes"] == "x,y"
    with pytest.raises(Exception):
        S.write_cases(df, str(tmp_path / "out"))
    S.publish_dataset(df, str(tmp_path / "ds"))
    S.publish_dataset(df, str(tmp_path / "ds"), replace=True)


def test_fhir_from_ndjson(spark, tmp_path):
    cond = [{"subject": {"reference": "Patient/p1"}, "context": {"reference": "Encounter/e1"},
             "code": {"coding": [{"code": "C1"}, {"code": "IGNORED"}]}},
            {"subject": {"reference": "Patient/p1"}, "context": {"reference": "Encounter/e2"},
             "code": {"coding": [{"code": "C2"}]}},
            {"subject": {"reference": "Patient/p2"}, "context": {"reference": "Encounter/e1"},
             "code": {"coding": [{"code": "C1"}]}}]
    pats = [{"id": "p1", "birthDate": "1980-02-03"}, {"id": "p2"}]
    encs = [{"id": "e1", "period": {"end": "2010-01-01T10:00:00.000Z"}},
            {"id": "e2", "period": {"end": "2012-05-06T00:00:00.000Z"}}]
    for name, recs in (("c", cond), ("p", pats), ("e", encs)):
        (tmp_path / f"{name}.ndjson").write_text("\n".join(json.dumps(r) for r in recs))
    rd = lambda n: spark.read.json(str(tmp_path / f"{n}.ndjson"))
    out = {r["patient-id"]: r for r in S.cohort_from_fhir(rd("c"), rd("p"), rd("e")).collect()}
    assert out["p1"]["codes"] == "(C1,2010-01-01T10:00:00.000Z),(C2,2012-05-06T00:00:00.000Z)"
    assert out["p1"]["last-encounter"] == "2012-05-06T00:00:00.000"
    assert out["p2"]["dob"] == "0000-00-00"


def test_i2b2_zero_date_and_latest_over_both_sets(spark):
    pats = spark.createDataFrame([("1", "1970-01-01")], "patient_id string, birth_date string")
    prim = spark.createDataFrame([("1", "ICD10:A01", "2001-01-01T00:00:00.000")], "patient_id string, concept_cd string, end_date string")
    sec = spark.createDataFrame([("1", "ICD10:B02", "2005-01-01T00:00:00.000"), ("1", "ICD10:C03", None)],
                                "patient_id string, concept_cd string, end_date string")
    r = S.cohort_from_i2b2(pats, prim, sec).collect()[0]
    assert r["codes"] == "(A01,2001-01-01T00:00:00.000),(B02,2005-01-01T00:00:00.000),(C03,0000-00-00T00:00:00.000)"
    assert r["last-encounter"] == "2005-01-01T00:00:00.000"


def test_xml_keeps_identifier_string(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        "<Response><Identity><NHSNumber>0123456789</NHSNumber></Identity>"
        "<Demographics><DateOfBirth>2015-03-01</DateOfBirth></Demographics>"
        "<Clinical><Event><ClinicalCode><Code Code=\"F527.\"/></ClinicalCode></Event></Clinical></Response>")
    r = S.cohort_from_xml(spark, str(tmp_path / "r.xml")).collect()[0]
    assert (r["patient-id"], r["dob"], r["codes"]) == ("0123456789", "2015-03-01", "F527.")


def test_codelist_and_steplist_files(spark, tmp_path):
    (tmp_path / "listA_system.csv").write_text("ICD-10 code,description\n123,TermA TermB\n234,TermA TermC\n")
    (tmp_path / "listB_system.csv").write_text("SNOMED code,description\n345,TermD TermE\n")
    cl = S.read_codelists(spark, str(tmp_path))
    rows = sorted((r["filename"], r["row_no"], r["attrs"]["description"]) for r in cl.collect())
    assert rows == [("listA_system.csv", 0, "TermA TermB"), ("listA_system.csv", 1, "TermA TermC"),
                    ("listB_system.csv", 0, "TermD TermE")]
    sl = tmp_path / "sl"
    sl.mkdir()
    (sl / "steplist.csv").write_text("logicType,param\ncodelist,listA_system.csv:1\nbranch,branch-a.csv\n")
    st = sorted((r["seq"], r["logicType"], r["param"]) for r in S.read_steplist(spark, str(sl)).collect())
    assert st == [(1, "codelist", "listA_system.csv:1"), (2, "branch", "branch-a.csv")]


def test_registry(spark):
    S.register_source("tiny", lambda s: s.createDataFrame([("1", "2000-01-01", "", "2020-01-01")], list(COHORT_COLUMNS)))
    assert S.read_source("tiny", spark).count() == 1
    S.register_source("bad", lambda s: s.createDataFrame([("1",)], ["patient-id"]))
    with pytest.raises(ValueError):
        S.read_source("bad", spark)


def test_omop_reader(spark):
    person = spark.createDataFrame([(1, 1970), (2, None)], "person_id long, year_of_birth int")
    recs = spark.createDataFrame([(1, "condition", 100, 0), (1, "condition", 200, 31), (1, "drug", 300, 400),
                                  (2, "condition", 100, 5)], "person_id long, domain string, concept_id long, end_day int")
    obs = spark.createDataFrame([(201003,), (201001,)], "month_year int")
    out = {r["patient-id"]: r for r in S.cohort_from_omop(person, recs, obs).collect()}
    assert out["1"]["codes"] == "(100,2010-01-01T00:00:00.000Z),(200,2010-02-01T00:00:00.000Z)"  # drug ignored
    assert out["1"]["last-encounter"] == "2010-02-01T00:00:00.000"
    assert out["1"]["dob"] == "1970-01-01" and out["2"]["dob"] == "0000-00-00"


def test_xml_several_records(spark, tmp_path):
    rec = ("<Response><Identity><NHSNumber>{id}</NHSNumber></Identity><Demographics><DateOfBirth>{dob}</DateOfBirth>"
           "</Demographics><Clinical><Event><ClinicalCode><Code Code=\"{code}\"/></ClinicalCode></Event></Clinical></Response>")
    (tmp_path / "many.xml").write_text("<Responses>" + rec.format(id="0001", dob="2015-03-01", code="F527.")
                                       + rec.format(id="0002", dob="2016-04-02", code="XE2QD") + "</Responses>")
    got = sorted(tuple(r) for r in S.cohort_from_xml(spark, str(tmp_path / "many.xml")).collect())
    assert got == [("0001", "2015-03-01", "F527."), ("0002", "2016-04-02", "XE2QD")]
