"""Definitions of any length as tables: wide steplists, groups of codelists, search by
index, ranks of many categories."""

import random

import pytest
from pyspark.sql import functions as F

from phenospark.operators import codelists as K
from phenospark.operators import learn as M
from phenospark.operators import search_index as X
from phenospark.operators.catalog import search_definitions
from phenospark.plans import steplist as S


def test_wide_steplist_with_many_codes(spark):
    """200,000 codes; wide = long, equal rows keep their flags, repeats in a cell count."""
    codes = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a.csv").otherwise("b.csv").alias("file"),
                                        F.when(F.col("id") % 2 == 0, "A codes").otherwise("B codes").alias("category"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("code"))
    steplist = [(1, "codelist", "a.csv:2"), (2, "codelistsTemporal", "b.csv:a.csv:1:100"), (3, "branch", "inner.csv"), (4, "codelistExclude", "b.csv")]
    nested = {"inner.csv": [(1, "codelist", "b.csv:1")]}
    steps = S.plan_steplist(steplist, codes, nested)
    rnd = random.Random(2)
    events = sorted({(p, f"c{rnd.randrange(250_000)}", f"2001-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}T00:00:00.000000") for p in range(60) for _ in range(rnd.randint(0, 5))})
    cells = {p: ",".join(f"({c},{t})" for q, c, t in events if q == p) for p in range(60)}
    rows = [(str(p), "1950-01-01", cells[p], "2001-12-31") for p in range(60)]
    wide = spark.createDataFrame([*rows, rows[3]], "`patient-id` string, dob string, codes string, `last-encounter` string")
    out = S.evaluate_steplist(wide, steps, codes, "2002-01-01")
    flags = [s.column for s in steps if s.column in out.columns]
    got = out.select("patient-id", *[f"`{f}`" for f in flags]).collect()
    assert len(got) == 61
    long = S.evaluate_steplist_events(
        spark.createDataFrame(events, "patient_id long, code string, ts string").withColumn("ts", F.to_timestamp("ts")),
        spark.createDataFrame([(p, "1950-01-01", "2001-12-31") for p in range(60)], "patient_id long, dob string, last_ts string")
        .select("patient_id", F.to_date("dob").alias("dob"), F.to_timestamp("last_ts").alias("last_ts")), steps, codes, "2002-01-01", temporal_order="listed")
    want = {str(r["patient_id"]): [r[f] for f in flags] for r in long.collect()}
    assert all([r[f] for f in flags] == want[r["patient-id"]] for r in got)
    assert len(flags) == 4 and all(len({r[f] for r in got}) == 2 for f in flags)
    twice = spark.createDataFrame([("1", "(c0,2001-01-01T00:00:00.000000),(c0,2001-01-01T00:00:00.000000)")], "`patient-id` string, codes string")
    alone = S.plan_steplist([(1, "codelist", "a.csv:2")], codes)
    assert S.evaluate_steplist(twice, alone, codes, "2002-01-01").first()[alone[0].column] == "CASE"


def test_hits_are_added_up_before_they_are_shuffled(spark):
    """The shuffle after the cells are taken apart has one record a row, not one a hit; equal rows count once."""
    codes = spark.createDataFrame([("a.csv", "A codes", "c1"), ("a.csv", "A codes", "x,y")], "file string, category string, code string")
    steps = S.plan_steplist([(1, "codelist", "a.csv:3")], codes)
    cells = {"1": "(c1,2001-01-01),(c1,2001-01-02),(c1,2001-01-03)", "2": "(c1,2001-01-01),(c1,2001-01-02)", "3": "", "4": None}
    rows = [(p, c) for p, c in cells.items() for _ in range(1 + 2 * (p in "24"))]
    wide = spark.createDataFrame(rows, "`patient-id` string, codes string").repartition(3)
    out = S.evaluate_steplist(wide, steps, codes, "2002-01-01")
    got = [(r["patient-id"], r[steps[0].column]) for r in out.collect()]
    assert sorted(got) == sorted([("1", "CASE")] + [(p, "UNK") for p, _ in rows if p != "1"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate ")[1:]
    assert [p.split("]")[0].count(",") for p in plan] == [0]          # one aggregate, keyed by the row alone


def test_group_codelists_number_rows_on(spark):
    cl = spark.createDataFrame([(f, i, {"code": f"{f}{i}", "description": f"TermA of {f} number{i}"}) for f, n in (("b", 3), ("a", 2), ("c", 4)) for i in range(n)],
                               "filename string, row_no int, attrs map<string,string>")
    meta = spark.createDataFrame([("Gout", "one", "b"), ("Gout", "one", "a"), ("Gout", "one", "a"), ("Gout", None, "c"), ("Gout", "two", "c"), ("Gout", "two", "missing")],
                                 "name string, title string, filename string")
    got = sorted((r.title or "", r.row_no, r.source, r.source_row) for r in K.group_codelists(meta, cl).collect())
    assert got == [("", i, "c", i) for i in range(4)] + [("one", 0, "a", 0), ("one", 1, "a", 1), ("one", 2, "b", 0), ("one", 3, "b", 1), ("one", 4, "b", 2)] + \
        [("two", i, "c", i) for i in range(4)]
    found = K.group_categories(meta, cl).collect()
    assert {(r.title, r.source, r.source_row) for r in found} == {(t, s, i) for t, _, s, i in [(x[0] or None, *x[1:]) for x in got]}
    assert all("Gout" in r.category for r in found)


def test_search_by_index_equals_scan(spark, tmp_path):
    rnd = random.Random(4)
    words = ["Asthma", "COPD", "type 2", "İnsulin", "100%", "a_b", "x", ""]
    text = lambda: rnd.choice([" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))), None])
    w = spark.createDataFrame([(i, text(), text(), f"user{i % 5}") for i in range(200)], "id long, name string, about string, user_name string")
    index = X.build_search_index(w, str(tmp_path / "index"))
    complete = w.select("id", (F.col("id") % 3 != 0).alias("complete"))
    none = spark.createDataFrame([], "workflow_id long")
    for wanted, also in (("asthma", None), ("TYPE 2", "copd"), ("x", None), ("us", None), ("", None), ("user3", "a_b"), ("%", None), ("zzz", None)):
        scan = search_definitions(w, complete, none, text=wanted, also=also, limit=1000).select("id", "name").collect()
        pages, after = [], None
        while True:
            page = X.search_page(spark, index, wanted, 23, after, complete.where("complete"), also).collect()
            pages += page
            if len(page) < 23:
                break
            after = (page[-1]["name"], page[-1]["id"])
        assert [r.id for r in pages] == [r.id for r in sorted(scan, key=lambda r: (r.name is not None, r.name or "", r.id))], wanted
    plan = X.matching_ids(spark, index, "asthma")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan


def test_ranks_of_many_categories(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("v"), F.lpad((F.col("id") * 7919 % 10_000).cast("string"), 5, "0")).alias("cat"),
                                    (F.col("id") % 12).alias("num")).union(spark.createDataFrame([(-1, None, None)], "id long, cat string, num long"))
    got = {r.id: r for r in M.ordinal_encode(df, ["cat", "num"]).collect()}
    assert all(got[i].cat == i * 7919 % 10_000 and got[i].num == i % 12 for i in range(20_000))
    assert (got[-1].cat, got[-1].num) == (10_000.0, 12.0)  # nulls rank after all values


@pytest.mark.parametrize("key,name,label", [("gout", "Gout", "Gout - primary"), ("chronic", "Gout", "Chronic Gout - primary"), ("acute", "Gout", "Gout acute - primary"), ("asthma", "Type diabetes", "Type diabetes asthma - primary")])
def test_label_of_named_columns(spark, key, name, label):
    df = spark.createDataFrame([(key, "primary", name)], "category_key string, system_group string, name string")
    assert K.label_categories(df).first()["category"] == label


def test_frequent_runs_lie_in_several_sorted_files(spark, tmp_path, monkeypatch):
    """A bucket's postings are dealt by id, so that no task sorts all of a frequent run."""
    import glob

    from phenospark.operators import search_index as X
    monkeypatch.setattr(X, "SLICE_VALUES", 300)
    wf = spark.range(400).selectExpr("id", "'same name' AS name", "concat('about ', id % 7) AS about", "CAST(NULL AS string) AS user_name")
    index = X.build_search_index(wf, str(tmp_path / "i"))
    bucket = __import__("zlib").crc32(b"sam") % X.BUCKETS
    assert len(glob.glob(f"{index.folder}/postings/bucket={bucket}/*.parquet")) > 1
    assert X.matching_ids(spark, index, "same").count() == 400
    assert [r.id for r in X.search_page(spark, index, "about 3", 5).collect()] == [3, 10, 17, 24, 31]
