"""Keyword-list phenotypes and custom steps."""

import pytest

from phenospark.plans import custom, keywords


def test_keyword_rows_strip_boundary(spark):
    kw = spark.createDataFrame([(0, r"\\basthma\\b"), (1, "wheeze of chest")], "row_no long, keyword string")
    rows = {r["row_no"]: r["attrs"] for r in keywords.keyword_rows(kw).collect()}
    assert rows[0] == {"keyword": "asthma", "description": "asthma"}
    assert rows[1]["description"] == "wheeze chest"


def test_keyword_list_phenotype(spark):
    kw = spark.createDataFrame([(0, "asthma attack"), (1, "asthma severe"), (2, "inhaler")], "row_no long, keyword string")
    notes = spark.createDataFrame([("1", "Severe ASTHMA ATTACK today"), ("2", "uses an inhaler"), ("3", "fine")],
                                  ["patient-id", "note"])
    out = keywords.evaluate_keyword_list(notes, kw, "Lung")
    flags = [c for c in out.columns if c.endswith("-identified")]
    assert flags
    rows = {r["patient-id"]: [r[f] for f in flags] for r in out.collect()}
    assert "CASE" in rows["1"] and "CASE" in rows["2"] and "CASE" not in rows["3"]


def test_custom_steps(spark):
    df = spark.createDataFrame([("1", 3), ("2", 9)], ["patient-id", "score"])
    out = custom.custom_step(df, lambda d: d.withColumn("high-identified", (d.score > 5).cast("string")))
    assert out.columns[-1] == "high-identified"
    with pytest.raises(ValueError):
        custom.custom_step(df, lambda d: d.drop("score"))

    def fn(pdf):
        pdf["risk-identified"] = ["CASE" if s > 5 else "UNK" for s in pdf["score"]]
        return pdf

    r = {x["patient-id"]: x["risk-identified"] for x in custom.custom_row_step(df, fn, "`risk-identified` string").collect()}
    assert r == {"1": "UNK", "2": "CASE"}
