"""Codelist curation rules on small in-test codelists."""

from pyspark.sql import functions as F

from phenospark.operators import codelists as K


def _long(spark, files):
    rows = [(f, i, dict(r)) for f, content in files for i, r in enumerate(content)]
    return spark.createDataFrame(rows, "filename string, row_no int, attrs map<string,string>")


def _cats(df):
    out = {}
    for r in df.orderBy("filename", "row_no").collect():
        out.setdefault(r["category"], []).append(r["code"])
    return out


def test_common_terms_grouped_by_category(spark):
    cl = K.clean_headers(_long(spark, [("file.csv", [
        {"ICD-10 code": "123", "description": "TermA TermB"},
        {"ICD-10 code": "234", "description": "TermA TermC"},
        {"ICD-10 code": "345", "description": "TermD TermE"}])]))
    assert _cats(K.categories(cl, "Phenotype")) == {"Phenotype terma - secondary": ["123", "234"],
                                                    "Phenotype - secondary": ["345"]}


def test_clean_headers_last_wins(spark):
    cl = K.clean_headers(_long(spark, [("f.csv", [{"Read Code": "a", "readcode": "b", "Description": "x"}])]))
    r = cl.collect()[0]["attrs"]
    assert r == {"readcode": "b", "description": "x"}


def test_code_and_description(spark):
    cl = K.clean_headers(_long(spark, [("f.csv", [
        {"Code": "", "SNOMED code": "", "ICD10 code": "I10", "Term": "[X]Shortness of breath"},
        {"foo": "1"}])]))
    ok, bad = K.resolve_code(cl)
    assert [r["code"] for r in ok.collect()] == ["I10"] and bad.count() == 1
    d = K.resolve_description(cl).orderBy("row_no").collect()
    assert d[0]["description"] == "breath Shortness" and d[1]["description"] is None


def test_system_group(spark):
    cl = K.clean_headers(_long(spark, [
        ("a.csv", [{"Read code": "1", "description": "x"}]),
        ("b.csv", [{"code": "1", "coding system": "ICD-10", "description": "x"}]),
        ("c_hes.csv", [{"code": "1", "description": "x"}]),
        ("d.csv", [{"code": "1", "description": "x"}])]))
    g = {r["filename"]: r["system_group"] for r in K.coding_system_group(cl).collect()}
    assert g == {"a.csv": "primary", "b.csv": "secondary", "c_hes.csv": "HES", "d.csv": "undefined"}


def test_term_counts_and_file_category(spark):
    cl = K.clean_headers(_long(spark, [("f.csv", [
        {"code": "1", "description": "asthma attacks severe"},
        {"code": "2", "description": "asthma attack"},
        {"code": "3", "description": "asthma chronic"}])]))
    tc = {r["term"]: r["n"] for r in K.term_counts(cl, "Lung").collect()}
    assert tc == {"asthma": 3, "attack": 2}
    assert K.file_category(cl, "Lung").collect()[0]["file_category"] == "asthma"


def test_terms_that_share_a_stem_with_the_name_are_the_names(spark):
    rows = [{"icd10code": str(i), "description": d} for i, d in enumerate(["Diabetic retinopathy", "diabetics retinopathy", "prediabetes retinopathies"] * 2)]
    cl = K.with_description(K.clean_headers(_long(spark, [("f.csv", rows)])))
    assert set(r["term"] for r in K.term_counts(cl, "Diabetes").collect()) == {"retinopathy"}
    assert {r["term"] for r in K.term_counts(cl, "Lung").collect()} > {"retinopathy", "diabetic"}


def test_non_differentiating_only_contained_ones(spark):
    tc = spark.createDataFrame([("f", "diabetes", 10), ("f", "diabete", 2), ("f", "insulin", 3)],
                               "filename string, term string, n long")
    r = {x["term"]: (x["frequent"], x["excluded"]) for x in K.non_differentiating_terms(tc).collect()}
    assert r["diabetes"] == (True, False)
    assert r["diabete"] == (False, True)
    assert r["insulin"] == (True, False)


def test_one_row_file_and_category_column(spark):
    cl = K.clean_headers(_long(spark, [
        ("one.csv", [{"ICD-10 code": "9", "description": "chronic asthma"}]),
        ("cat.csv", [{"code": "7", "category": "Diagnosis of Asthma"}, {"prodcode": "55", "drugsubstance": "Salbutamol"}])]))
    cats = _cats(K.categories(cl, "Asthma"))
    assert cats["Chronic Asthma - secondary"] == ["9"]
    assert cats["Diagnosis of Asthma - undefined"] == ["7"]
    assert cats["Use of Salbutamol Asthma - undefined"] == ["55"]


def test_bigram_dice_values(spark):
    from phenospark.functions.text import bigram_dice
    df = spark.createDataFrame([("termd", "terma"), ("night", "nacht"), ("aaaa", "aa"), ("x", "x")], "a string, b string")
    vals = [round(r[0], 4) for r in df.select(bigram_dice(F.col("a"), F.col("b"))).collect()]
    assert vals == [0.75, 0.25, 0.5, 1.0]


def test_labels_of_names_of_several_words(spark):
    rows = [("asthma", "Type diabetes", "Type diabetes asthma - primary"),
            ("Type diabetes", "Type diabetes", "Type diabetes - primary"),
            ("chronic", "Type diabetes", "Chronic Type diabetes - primary"),
            ("severe late asthma", "Type diabetes", "Severe late asthma Type diabetes - primary"),
            ("asthma", "Heart (left) failure", "Heart left failure asthma - primary"),
            ("wheeze", "Asthma", "Asthma wheeze - primary")]
    df = spark.createDataFrame(rows, "k string, n string, want string")
    got = [(r["k"], r["n"], r["label"]) for r in df.withColumn("label", K.label_expr(F.col("k"), F.lit("primary"), F.col("n"))).collect()]
    assert got == rows


def test_rejections(spark):
    cl = K.clean_headers(_long(spark, [("a_read.csv", [{"code": "1", "description": "asthma attack"}, {"description": "asthma severe"},
                                                       {"code": "3", "description": "asthma attack"}, {"code": "4"}]),
                                       ("b_read.csv", [{"code": "9"}])]))
    cats = K.categories(cl, "Asthma").collect()
    assert sorted(r["code"] for r in cats) == ["1", "3"]
    got = {(r["filename"], r["row_no"], r["reason"]) for r in K.rejections(cl, "Asthma").collect()}
    assert got == {("a_read.csv", 1, "no code"), ("a_read.csv", 3, "no category"), ("b_read.csv", 0, "no category"),
                   ("b_read.csv", None, "no category")}


def test_fingerprint_changes_with_content(spark):
    a = _long(spark, [("f.csv", [{"code": "1"}, {"code": "2"}])])
    b = _long(spark, [("f.csv", [{"code": "2"}, {"code": "1"}])])
    fa, fb = K.fingerprint(a).collect()[0][1], K.fingerprint(b).collect()[0][1]
    assert fa != fb and fa == K.fingerprint(a).collect()[0][1]


def test_distinct_step_names_and_grouping(spark):
    steps = spark.createDataFrame([("d", 1, "asthma", "inhaler"), ("d", 2, "asthma", "steroid"), ("d", 3, "copd", ""),
                                   ("e", 1, "x", ""), ("e", 2, "x", "")],
                                  "definition string, position int, name string, file_category string")
    r = {(x["definition"], x["position"]): (x["step_name"], x["rejected"]) for x in K.distinct_step_names(steps).collect()}
    assert r[("d", 1)] == ("asthma-inhaler", False) and r[("d", 3)] == ("copd", False)
    assert r[("e", 1)][1] is True
    meta = spark.createDataFrame([("A", "t", "f1"), ("A", "t", "f2"), ("A", "u", "f3")], "name string, title string, filename string")
    g = {(x["name"], x["title"]): x["files"] for x in K.group_definitions(meta).collect()}
    assert g == {("A", "t"): ["f1", "f2"], ("A", "u"): ["f3"]}
