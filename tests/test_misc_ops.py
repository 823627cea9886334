"""Row index, codelist file dedupe, steplist fingerprints, existing definitions."""

import hashlib

import pytest

from phenospark.operators import catalog as G
from phenospark.operators import codelists as K
from phenospark.operators.frames import row_index


def test_row_index_is_dense_in_key_order(spark):
    df = spark.createDataFrame([(k * 7 % 101, str(k)) for k in range(101)], "k long, v string")
    out = row_index(df, "k", partitions=5).collect()
    assert out[0].__fields__[0] == "index"
    assert sorted((r["index"], r["k"]) for r in out) == [(i, i) for i in range(101)]


def test_dedupe_files_last_upload_wins(spark):
    cl = spark.createDataFrame([("a.csv", 1, 0, {"code": "1"}), ("a.csv", 2, 0, {"code": "2"}), ("b.csv", 1, 0, {"code": "3"})],
                               "filename string, upload_seq int, row_no int, attrs map<string,string>")
    got = sorted((r["filename"], r["attrs"]["code"]) for r in K.dedupe_files(cl).collect())
    assert got == [("a.csv", "2"), ("b.csv", "3")]


def test_steplist_fingerprint(spark):
    cl = spark.createDataFrame([("a.csv", 0, {"code": "1"}), ("b.csv", 0, {"code": "2"}), ("c.csv", 0, {"code": "3"})],
                               "filename string, row_no int, attrs map<string,string>")
    prints = K.fingerprint(cl)
    sl = spark.createDataFrame([
        ("main.csv", 1, "codelist", "a.csv:1"), ("main.csv", 2, "branch", "br.csv"),
        ("br.csv", 1, "codelistsTemporal", "b.csv:c.csv:1:10"), ("other.csv", 1, "codelist", "a.csv:2")],
        "filename string, seq int, logicType string, param string")
    fp = {r["filename"]: r["fingerprint"] for r in K.steplist_fingerprint(sl, prints).collect()}
    p = {r["filename"]: r["fingerprint"] for r in prints.collect()}

    def total(*texts):
        hs = [hashlib.sha1(t.encode()).hexdigest() for t in texts]
        return "-".join(str(sum(int(h[i:j], 16) for h in hs)) for i, j in ((0, 14), (14, 28), (28, 40)))

    assert fp["br.csv"] == total("false#" + p["b.csv"], "false#" + p["c.csv"])
    assert fp["main.csv"] == total("false#" + p["a.csv"], "true#" + fp["br.csv"])
    assert fp["other.csv"] == total("false#" + p["a.csv"])


def test_steplist_fingerprint_any_depth_cycles_and_unknown_files(spark):
    prints = K.fingerprint(spark.createDataFrame([("a.csv", 0, {"code": "1"})], "filename string, row_no int, attrs map<string,string>"))
    chain = [(f"s{i}", 1, "branch", f"s{i + 1}") for i in range(11)] + [("s11", 1, "codelist", "a.csv:1")]
    odd = [("age", 1, "age", "1:9"), ("gone", 1, "codelist", "nowhere.csv:1"), ("above", 1, "branch", "gone"),
           ("x", 1, "branch", "y"), ("y", 1, "branch", "x"),
           ("twice", 1, "codelist", "a.csv:1"), ("twice", 2, "codelistExclude", "a.csv")]
    sl = spark.createDataFrame(chain + odd, "filename string, seq int, logicType string, param string")
    got = {r["filename"]: (r["fingerprint"], r["problem"]) for r in K.steplist_fingerprint(sl, prints).collect()}
    assert all(got[f"s{i}"][0] and got[f"s{i}"][1] is None for i in range(12))
    assert len({got[f"s{i}"][0] for i in range(12)}) == 12
    assert got["age"] == ("empty", None) and got["twice"] == got["s11"]
    assert got["gone"] == got["above"] == (None, "unknown file") and got["x"] == got["y"] == (None, "cycle")


def test_fingerprint_escapes_separators(spark):
    cl = spark.createDataFrame([("a", 0, {"x": "1|y=2"}), ("b", 0, {"x": "1", "y": "2"})],
                               "filename string, row_no int, attrs map<string,string>")
    assert K.fingerprint(cl).select("fingerprint").distinct().count() == 2


def test_find_existing_and_changes(spark):
    wf = spark.createDataFrame([(i, "n", "a", "u") for i in range(1, 4)] + [(9, "m", "a", "u")],
                               "id long, name string, about string, user_name string")
    st = spark.createDataFrame([(11, 1, 1, "read-potential-cases-i2b2", "d", "load"), (21, 2, 1, "read-x", "d", "load")],
                               "id long, workflow_id long, position int, name string, doc string, type string")
    assert [r["id"] for r in G.find_existing(wf, st, "n", "a", "u", "read-potential-cases-i2b2").collect()] == [1]
    many = wf.unionByName(spark.createDataFrame([(5, "n", "a", "u"), (6, "n", "a", "u")], wf.schema))
    with pytest.raises(ValueError):
        G.find_existing(many, st, "n", "a", "u")
    old = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "workflow_id long, position int, name string")
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (2, 2, "w")], "workflow_id long, position int, name string")
    ch = {r["workflow_id"]: r["changed"] for r in G.definition_changed(old, new).collect()}
    assert ch == {1: False, 2: True}
