"""Mixed NDJSON, codelist files, nested JSON results, versions of a dataset."""

import json

import pytest
from pyspark.sql import functions as F

from phenospark import sources as S
from phenospark.operators import tbc_json as J
from phenospark.sources import files as SF
from phenospark.sources import tabular as ST


def _condition(patient, encounter, code, key="context"):
    return {"resourceType": "Condition", "subject": {"reference": f"Patient/{patient}"}, key: {"reference": f"Encounter/{encounter}"},
            "code": {"coding": [{"code": code, "system": "x"}, {"code": "IGNORED"}]}}


def test_mixed_resources_and_rejects(spark, tmp_path):
    docs = [_condition("p1", "e1", "C1"), _condition("p1", "e1", "C1"), _condition("p1", "e2", "C2", "encounter"), _condition("p2", "e1", "C3"),
            _condition("nobody", "e1", "C4"), _condition("p1", "never", "C5"), _condition("p1", "e3", "C6"),
            {"resourceType": "Condition", "context": {"reference": "Encounter/e1"}, "code": {"coding": [{"code": "C7"}]}},
            {"resourceType": "Condition", "subject": {"reference": "Patient/p1"}, "code": {"coding": [{"code": "C8"}]}},
            {"resourceType": "Condition", "subject": {"reference": "Patient/p1"}, "context": {"reference": "Encounter/e1"}, "code": {"coding": []}},
            {"resourceType": "Patient", "id": "p1", "birthDate": "1980-02-03", "extra": {"deep": [1]}}, {"resourceType": "Patient", "id": "p1"},
            {"resourceType": "Patient", "id": "p2"}, {"resourceType": "Patient"}, {"resourceType": "Encounter", "id": "e1", "period": {"end": "2010-01-01T10:00:00.000Z"}},
            {"resourceType": "Encounter", "id": "e2", "period": {"end": "2012-05-06T00:00:00.000Z"}}, {"resourceType": "Encounter", "id": "e3"},
            {"resourceType": "Practitioner", "id": "d1"}, {"id": "untyped"}]
    lines = [json.dumps(d) for d in docs] + ["", "  ", '{"resourceType":"Patient","id":"p', "[1,2]", "plain text"]
    (tmp_path / "a.ndjson").write_text("\n".join(lines[:9]) + "\n")
    (tmp_path / "b.ndjson").write_text("\n".join(lines[9:]))
    scan = S.scan_resources(spark, str(tmp_path))
    got = S.record_tables(spark, scan)
    events = sorted((r.patient_id, r.code, r.ts.isoformat()) for r in got.events.collect())
    assert events == [("p1", "C1", "2010-01-01T10:00:00"), ("p1", "C2", "2012-05-06T00:00:00"), ("p2", "C3", "2010-01-01T10:00:00")]
    reasons = sorted(r.reason for r in got.rejects.collect())
    assert reasons == sorted(["no patient reference", "no encounter reference", "no code", "no id", "no end date", "no resource type", "not JSON", "not JSON",
                              "not JSON", "unknown patient", "unknown encounter", "unknown encounter"])
    assert got.counts == {"lines": 22, "condition": 7, "patient": 3, "encounter": 2, "reject": 9, "other": 1,
                          "accepted": 4, "unknown patient": 1, "unknown encounter": 2}
    assert all(r.line and (r.file is None or r.file.endswith(".ndjson")) for r in got.rejects.collect())
    cases = {r["patient-id"]: r for r in S.cases_from_events(got.events, got.patients).collect()}
    assert cases["p1"]["codes"] == "(C1,2010-01-01T10:00:00.000Z),(C2,2012-05-06T00:00:00.000Z)" and cases["p1"]["dob"] == "1980-02-03"
    assert cases["p2"]["dob"] == "0000-00-00" and cases["p1"]["last-encounter"] == "2012-05-06T00:00:00.000"
    people = {r.patient_id: r for r in got.patients.collect()}
    assert set(people) == {"p1", "p2"} and people["p1"].last_encounter is not None


def test_no_resources(spark, tmp_path):
    (tmp_path / "empty.ndjson").write_text("\n\n")
    got = S.record_tables(spark, S.scan_resources(spark, str(tmp_path)))
    assert got.events.count() == got.patients.count() == got.rejects.count() == 0 and got.counts["lines"] == 0


def test_codelists_of_equal_name_stay_apart(spark, tmp_path):
    import csv
    import random

    rnd = random.Random(3)
    cells = ["", "plain", "a,b", 'quote " inside', "two\nlines", "\n\nlead", 'all ",\n"" of it', "é漢", " spaced ", "tail\n"]
    expected = set()
    for folder in ("north", "south & west", "deep/er"):
        (tmp_path / folder).mkdir(parents=True)
        for name, header in (("list_x.csv", ["code", "description"]), ("other.csv", ["ICD-10 code", "term", "term"])):
            rows = [[rnd.choice(cells) for _ in header] for _ in range(40)]
            rows = [r for r in rows if any(r)]
            with open(tmp_path / folder / name, "w", newline="", encoding="utf-8") as f:
                out = csv.writer(f, lineterminator=rnd.choice(["\n", "\r\n"]))
                out.writerow(header)
                for r in rows:
                    out.writerow(r)
            keys = header if len(set(header)) == len(header) else ["ICD-10 code", "term", "term.1"]
            expected |= {(f"{folder}/{name}", i, k, v) for i, r in enumerate(rows) for k, v in zip(keys, r, strict=True)}
    got = S.read_codelists(spark, str(tmp_path), recursive=True).select("filename", "row_no", F.explode("attrs").alias("k", "v"))
    assert {tuple(r) for r in got.collect()} == expected


def test_codelist_records_over_block_borders(spark, tmp_path):
    """Small splits: quoted line breaks and row numbers go on from block to block."""
    body = "".join(f'{i},"line one of {i}\nline ""two"" of {i}"\n' if i % 3 else f"{i},short\n\n" for i in range(3000))
    (tmp_path / "big.csv").write_text("﻿code,description,note\n" + body + "last,no end")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = sorted(S.read_codelists(spark, str(tmp_path)).collect(), key=lambda r: r.row_no)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.row_no for r in rows] == list(range(3001))
    assert [r.attrs["code"] for r in rows] == [*map(str, range(3000)), "last"]
    assert rows[4].attrs == {"code": "4", "description": 'line one of 4\nline "two" of 4', "note": ""}


def test_unbalanced_file_is_rejected_alone(spark, tmp_path):
    (tmp_path / "good.csv").write_text("code,description\n1,x\n")
    (tmp_path / "bad.csv").write_text('code,description\n1,"x\n2,y\n')
    (tmp_path / "empty.csv").write_text("")
    records, rejects = SF.csv_records(spark, str(tmp_path))
    assert {r.filename for r in records.collect()} == {"good.csv"}
    assert [tuple(r) for r in rejects.collect()] == [("bad.csv", "unbalanced quotes")]
    assert [tuple(r) for r in S.read_codelists(spark, str(tmp_path / "good.csv")).select("filename", "row_no").collect()] == [("good.csv", 0)]


def test_partitions_as_nested_json(spark, tmp_path):
    rows = [(i, k, i * 7 % k if k < 4 else i % 3) for i in range(95) for k in (2, 3, 4)]  # cluster 3 of partition 4 is empty
    parts = spark.createDataFrame([*rows, (None, 2, 0)], "row_id long, k int, cluster int")
    lines = J.partition_lines(parts, 4, chunk=10)
    got = lines.collect()
    merged: dict = {}
    for r in sorted(got, key=lambda r: r.ordinal):
        for p, clusters in json.loads(r.json).items():
            for c, ids in clusters.items():
                assert len(ids) <= 10
                merged.setdefault(p, {}).setdefault(c, []).extend(ids)
    assert merged == {f"partition_k_{k}": {f"cluster_{c}": [i for i, kk, cc in rows if (kk, cc) == (k, c)] for c in range(k)} for k in (2, 3, 4)}
    J.write_lines(lines, str(tmp_path / "out"))
    back, rejects = J.parse_partitions(J.read_lines(spark, str(tmp_path / "out")))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows) and rejects.count() == 0
    # one document with everything, and lines that are none
    odd = [json.dumps(merged), "{", "[]", "{}", '{"partition_k_2": 3}', '{"partition_k_x": {"cluster_0": [1]}}', '{"partition_k_2": {"c": [1]}}']
    back, rejects = J.parse_partitions(spark.createDataFrame([(x,) for x in odd], "json string"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    assert sorted(r.json for r in rejects.collect()) == sorted(odd[1:])


def test_matrix_as_nested_json(spark):
    parts = spark.createDataFrame([(i, 3, i % 2) for i in range(25)] + [(i, 2, 0) for i in range(25)], "row_id long, k int, cluster int")
    matches = spark.createDataFrame([(0, 2, 0, 0.52), (1, 2, 0, 0.48)], "cluster int, k int, best_cluster int, match double")
    lines = J.matrix_lines(parts, matches, 3, chunk=10)
    docs = [json.loads(r.json) for r in lines.collect()]
    whole = [d["partition_k_3_cluster_0"] for d in docs if "partition_k_3_cluster_0" in d]
    assert sorted(i for d in whole for i in d["instances"]) == list(range(0, 25, 2))
    assert [d["match_with_previous_partitions"] for d in whole if d.get("match_with_previous_partitions")] == \
        [{"partition_k_2": {"max_value_of_match": 0.52, "cluster_with_max_value_of_match": "partition_k_2_cluster_0"}}]
    assert {"partition_k_3_cluster_2": {"instances": []}} in docs
    bad = spark.createDataFrame([("{",), ('{"x": {"instances": [1]}}',)], "json string")
    members, told, rejects = J.parse_matrix(lines.select("json").unionByName(bad))
    assert sorted(tuple(r) for r in members.collect()) == sorted((i, 3, i % 2) for i in range(25))
    assert sorted(tuple(r) for r in told.collect()) == [(0, 2, 0, 0.52), (1, 2, 0, 0.48)]
    assert rejects.count() == 2


def test_failed_replacement_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "ds")
    ST.publish_dataset(spark.range(10), path)
    with pytest.raises(FileExistsError):
        ST.publish_dataset(spark.range(3), path)
    failing = spark.range(1000).repartition(4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("midway"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="midway"):
        ST.publish_dataset(failing, path, replace=True)
    assert sorted(r.id for r in ST.read_dataset(spark, path).collect()) == list(range(10))
    reader = ST.read_dataset(spark, path)
    ST.publish_dataset(spark.range(5), path, replace=True)
    assert reader.count() == 10 and ST.read_dataset(spark, path).count() == 5  # a reader keeps its version
    assert ST.drop_old_versions(spark, path) >= 1 and ST.read_dataset(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        ST.read_dataset(spark, str(tmp_path / "none"))
