"""Golden cases of the step templates, on two- and three-row tables."""

from phenospark.operators import criteria as C
from tests.conftest import rows

AS_OF = "2021-06-30"
DATED = [
    ("1", "1979-01-01",
     "(X01,2004-10-17T00:00:00.000),(Y01,2004-10-17T00:00:00.000),(Y02,2005-04-17T00:00:00.000),"
     "(Z01,2005-10-17T00:00:00.000),(Z02,2006-10-17T00:00:00.000),(E01,3000-10-17T00:00:00.000)",
     "keyword1,keyword2", "2020-01-01"),
    ("2", "2020-01-01",
     "(Y01,2004-10-17T00:00:00.000),(Y02,2005-10-17T00:00:00.000),(Z01,2004-10-17T00:00:00.000),"
     "(Z02,2005-10-17T00:00:00.000)",
     "keyword1,keyword2", "1920-01-01"),
]
COLS = ["patient-id", "dob", "codes", "keywords", "last-encounter"]


def dated(spark):
    return spark.createDataFrame(DATED, COLS)


def test_codelist(spark):
    r = rows(C.codelist(dated(spark), "category", ["X01"]))
    assert r["1"]["category-identified"] == "CASE"
    assert r["2"]["category-identified"] == "UNK"


def test_codelist_required_counts_repeats(spark):
    df = spark.createDataFrame([("1", "(A,2000-01-01),(A,2000-01-02)", "(A,2001-01-01)")], ["patient-id", "c1", "c2"])
    assert rows(C.codelist(df, "x", ["A"], required=3))["1"]["x-identified"] == "CASE"
    assert rows(C.codelist(df, "x", ["A"], required=4))["1"]["x-identified"] == "UNK"


def test_codelist_exclude(spark):
    r = rows(C.codelist_exclude(dated(spark), "category", ["X01"]))
    assert r["1"]["category-exclusion"] == "TRUE"
    assert r["2"]["category-exclusion"] == "FALSE"


def test_age(spark):
    r = rows(C.age(dated(spark), 30, 80, AS_OF))
    assert (r["1"]["age-exclusion"], r["2"]["age-exclusion"]) == ("FALSE", "TRUE")
    r = rows(C.age_identified(dated(spark), 30, 80, AS_OF))
    assert (r["1"]["age-identified"], r["2"]["age-identified"]) == ("CASE", "UNK")


def test_age_birthday_ahead(spark):
    df = spark.createDataFrame([("1", "1991-07-01"), ("2", "1991-06-30"), ("3", "0000-00-00")], ["patient-id", "dob"])
    r = rows(C.age(df, 30, 80, AS_OF))
    assert r["1"]["age-exclusion"] == "TRUE"   # 29 until tomorrow
    assert r["2"]["age-exclusion"] == "FALSE"  # 30 today
    assert r["3"]["age-exclusion"] == "TRUE"   # unreadable date excludes


def test_last_encounter(spark):
    r = rows(C.last_encounter(dated(spark), 10, AS_OF))
    assert (r["1"]["last-encounter-exclusion"], r["2"]["last-encounter-exclusion"]) == ("FALSE", "TRUE")


def test_temporal(spark):
    r = rows(C.codelists_temporal(dated(spark), "category", ["Y01", "Y02"], ["Z01", "Z02"], 31, 186))
    assert r["1"]["category-identified"] == "CASE"  # 183 days
    assert r["2"]["category-identified"] == "UNK"   # negative


def test_temporal_floor_days_uses_time_of_day(spark):
    df = spark.createDataFrame([("1", "(B,2000-01-01T12:00:00),(A,2000-01-03T06:00:00)")], ["patient-id", "codes"])
    # 1.75 days -> floor 1; min 0 < 1 < 2 is CASE, while 1 < 1 is not
    assert rows(C.codelists_temporal(df, "t", ["B"], ["A"], 0, 2))["1"]["t-identified"] == "CASE"
    assert rows(C.codelists_temporal(df, "t", ["B"], ["A"], 1, 3))["1"]["t-identified"] == "UNK"


def test_temporal_listed_vs_date_order(spark):
    df = spark.createDataFrame([("1", "(B,2000-03-01),(B,2000-01-01),(A,2000-02-01)")], ["patient-id", "codes"])
    # listed: last-listed B is 2000-01-01 -> 31 days; date: latest B is 03-01 -> negative
    assert rows(C.codelists_temporal(df, "t", ["B"], ["A"], 30, 40))["1"]["t-identified"] == "CASE"
    assert rows(C.codelists_temporal(df, "t", ["B"], ["A"], 30, 40, order="date"))["1"]["t-identified"] == "UNK"


def test_keywords(spark):
    df = spark.createDataFrame([("1", "Has ÉCZEMA today"), ("2", None), ("3", "nothing")], ["patient-id", "note"])
    r = rows(C.keywords(df, "k", ["éczema", r"\bto"]))
    assert r["1"]["k-identified"] == "CASE"
    assert r["2"]["k-identified"] == "UNK"
    assert r["3"]["k-identified"] == "UNK"


def test_keyword_categories_with_exclusion(spark):
    df = spark.createDataFrame([("1", "asthma"), ("2", "no asthma"), ("3", "flu")], ["patient-id", "note"])
    out = rows(C.keyword_categories(df, {"asthma": ["asthma"], "flu": ["flu"]}, {"asthma": [r"\bno "]}))
    assert [out[k]["asthma-identified"] for k in "123"] == ["CASE", "UNK", "UNK"]
    assert [out[k]["flu-identified"] for k in "123"] == ["UNK", "UNK", "CASE"]


def test_codelist_plain(spark):
    df = spark.createDataFrame([("1", "X01,X02"), ("2", "Z01")], ["patient-id", "codes"])
    r = rows(C.codelist_plain(df, "icd10", ["X02"]))
    assert (r["1"]["icd10-identified"], r["2"]["icd10-identified"]) == ("CASE", "UNK")


def test_boolean_rule(spark):
    cols = ["patient-id", "t1dm_dx_cnt", "t2dm_dx_cnt", "t2dm_rx_dts", "abnormal_lab"]
    df = spark.createDataFrame([("1", "0", "0", "2001", "1"), ("2", "1", "0", "", "1")], cols)
    pred = "t1dm_dx_cnt = '0' AND t2dm_dx_cnt = '0' AND abnormal_lab = '1'"
    r = rows(C.boolean_rule(df, "t2dm_prediction", pred, ["t2dm_rx_dts", "abnormal_lab"]))
    assert (r["1"]["t2dm_prediction"], r["2"]["t2dm_prediction"]) == ("CASE", "UNK")
    r = rows(C.boolean_rule(df.drop("t2dm_rx_dts"), "t2dm_prediction", pred, ["t2dm_rx_dts", "abnormal_lab"]))
    assert r["1"]["t2dm_prediction"] == "UNK"


def test_resolve_cases(spark):
    cols = ["patient-id", "dob", "codes", "keywords", "age-exclusion", "codesA-identified", "codesB-identified",
            "last-encounter"]
    df = spark.createDataFrame([
        ("1", "1979-01-01", "X01,X02", "keyword1,keyword2", "TRUE", "CASE", "CASE", "2020-01-01"),
        ("2", "1979-01-01", "Z01,Z02", "keyword1,keyword2", "FALSE", "UNK", "CASE", "2020-01-01")], cols)
    out = C.resolve_cases(df)
    assert out.columns == cols
    r = rows(out)
    assert (r["1"]["codesA-identified"], r["1"]["codesB-identified"]) == ("UNK", "UNK")
    assert (r["2"]["codesA-identified"], r["2"]["codesB-identified"]) == ("UNK", "CASE")
    assert r["1"]["last-encounter"] == "2020-01-01"


def test_resolve_only_left_exclusions(spark):
    cols = ["patient-id", "a-identified", "x-exclusion", "b-identified"]
    df = spark.createDataFrame([("1", "CASE", "TRUE", "CASE")], cols)
    r = rows(C.resolve_cases(df))
    assert (r["1"]["a-identified"], r["1"]["b-identified"]) == ("CASE", "UNK")


def test_nested_cases(spark):
    cols = ["patient-id", "dob", "codes", "keywords", "codesA-categoryA-identified", "codesA-categoryB-identified",
            "codesB-categoryA-exclusion", "codesC-categoryA-identified"]
    df = spark.createDataFrame([
        ("1", "1979-01-01", "X01,X02", "k", "UNK", "CASE", "FALSE", "CASE"),
        ("2", "1979-01-01", "Y01,Y02", "k", "UNK", "UNK", "FALSE", "CASE"),
        ("3", "1979-01-01", "Z01,Z02", "k", "CASE", "CASE", "TRUE", "CASE")], cols)
    groups = [["codesA-categoryA-identified", "codesA-categoryB-identified"], ["codesC-categoryA-identified"]]
    out = C.nested_cases(df, groups, "nested-phenotype-name")
    assert out.columns == ["patient-id", "dob", "codes", "keywords", "nested-phenotype-name-identified"]
    r = rows(out)
    assert [r[k]["nested-phenotype-name-identified"] for k in "123"] == ["CASE", "UNK", "UNK"]


def test_nested_empty_groups_is_case(spark):
    df = spark.createDataFrame([("1", "UNK")], ["patient-id", "a-identified"])
    assert rows(C.nested_cases(df, [], "n"))["1"]["n-identified"] == "CASE"
