"""S2 from files: bulk exports of mixed resources, one JSON document a line.

One scan reads every line once, parses it by the explicit schema of its resource
type and writes what it holds, one folder a kind: conditions, patients, encounters
and rejects.  Lines are split like any text, so a file is never one task and one
bad line never ends the job.  The scan and the join that follows count what they see
(observed metrics of the same pass, no second read).

``scan_resources`` -> ``Scan(conditions, patients, encounters, rejects, counts)``;
``record_tables`` -> ``Records(events, patients, rejects, counts)`` in the long form
``events(patient_id, code, ts)``, ``patients(patient_id, dob, last_encounter)``;
``cases_from_events`` packs these into the potential-cases table.

Reject reasons of a line: ``not JSON``, ``no resource type``, ``no id``, ``no
patient reference``, ``no encounter reference``, ``no code``, ``no end date``; of a
condition whose references lead nowhere: ``unknown patient``, ``unknown encounter``.
Other resource types are counted (``other``), not rejected; blank lines are neither.
A patient or encounter told several times counts with its latest date.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phenospark.session import ensure_checkpoint_dir
from phenospark.sources.records import ISO_MILLIS, ZERO_DATE, _item, _ref_id

# The fields of each resource type that phenotypes use.
REFERENCE = "struct<reference:string>"
SCHEMAS = {
    "Condition": f"struct<subject:{REFERENCE},context:{REFERENCE},encounter:{REFERENCE},code:struct<coding:array<struct<code:string>>>>",
    "Patient": "struct<id:string,birthDate:string>",
    "Encounter": "struct<id:string,period:struct<end:string>>",
}
KINDS = {"Condition": "condition", "Patient": "patient", "Encounter": "encounter"}


class Scan(NamedTuple):
    conditions: DataFrame
    patients: DataFrame
    encounters: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


class Records(NamedTuple):
    events: DataFrame
    patients: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def _folder(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def scan_resources(spark: SparkSession, path: str | list[str], folder: str | None = None) -> Scan:
    """Reads all files under ``path`` once.  ``folder`` (default: a new one in the
    shared checkpoint folder) keeps the result; drop it when done."""
    folder = folder or _folder(spark, "resources")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    # a document that ends early or is no object has no type and no parsed form
    kind = F.from_json("value", "struct<resourceType:string,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    typed = lines.withColumn("head", kind).withColumn("type", F.col("head.resourceType"))
    for name, schema in SCHEMAS.items():
        typed = typed.withColumn(KINDS[name], F.when(F.col("type") == name, F.from_json("value", schema)))
    code = F.try_element_at(F.col("condition.code.coding"), F.lit(1))["code"]
    visit = F.coalesce("condition.context.reference", "condition.encounter.reference")
    end = F.col("encounter.period.end").try_cast("timestamp")
    problem = (F.when(F.col("head._bad").isNotNull() | F.col("head").isNull(), "not JSON")
               .when(_blank(F.col("type")), "no resource type")
               .when(F.col("type").isin("Patient", "Encounter") & _blank(F.coalesce("patient.id", "encounter.id")), "no id")
               .when(F.col("type") == "Condition", F.when(_blank(F.col("condition.subject.reference")), "no patient reference")
                     .when(_blank(visit), "no encounter reference").when(_blank(code), "no code"))
               .when((F.col("type") == "Encounter") & end.isNull(), "no end date"))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rows = typed.select(
        F.when(problem.isNotNull(), "reject").otherwise(F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("other"))).alias("kind"),
        F.coalesce("patient.id", "encounter.id").alias("id"), _ref_id(F.col("condition.subject.reference")).alias("patient"),
        _ref_id(visit).alias("encounter"), code.alias("code"), F.col("patient.birthDate").alias("birth"), end.alias("end"),
        problem.alias("reason"), F.when(problem.isNotNull(), F.col("file")).alias("file"), F.when(problem.isNotNull(), F.col("value")).alias("line"))
    seen = Observation("scan")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    rows.observe(seen, F.count(F.lit(1)).alias("lines"), *map(count, (*KINDS.values(), "reject", "other"))) \
        .where("kind <> 'other'").write.partitionBy("kind").parquet(folder)
    kept = spark.read.schema(rows.schema).parquet(folder)  # the kind prunes folders
    of = lambda k, *cols: kept.where(F.col("kind") == k).select(*cols)
    return Scan(of("condition", "patient", "encounter", "code"), of("patient", "id", "birth"), of("encounter", "id", "end"),
                of("reject", "reason", "file", "line"), {k: int(v) for k, v in seen.get.items()})


def record_tables(spark: SparkSession, scan: Scan, folder: str | None = None) -> Records:
    """Conditions with their patient and encounter, in the long form."""
    folder = folder or _folder(spark, "records")
    # one row an id, written: the joins below then shuffle plain rows, which AQE can split where one patient is hot
    scan.patients.groupBy("id").agg(F.max("birth").alias("birth")).write.parquet(f"{folder}/patients")
    scan.encounters.groupBy("id").agg(F.max("end").alias("end")).write.parquet(f"{folder}/encounters")
    patients = spark.read.schema("id string, birth string").parquet(f"{folder}/patients")
    encounters = spark.read.schema("id string, end timestamp").parquet(f"{folder}/encounters")
    joined = (scan.conditions.join(encounters.select(F.col("id").alias("encounter"), "end"), "encounter", "left")
              .join(patients.select(F.col("id").alias("patient"), F.lit(True).alias("known")), "patient", "left"))
    reason = F.when(F.col("known").isNull(), "unknown patient").when(F.col("end").isNull(), "unknown encounter")
    rows = joined.select(F.col("patient").alias("patient_id"), "code", F.col("end").alias("ts"), "encounter", reason.alias("reason"))
    seen = Observation("join")
    count = lambda k: F.count(F.when(F.col("reason") == k, 1)).alias(k)
    rows.observe(seen, F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), count("unknown patient"), count("unknown encounter")) \
        .withColumn("rejected", F.col("reason").isNotNull()).write.partitionBy("rejected").parquet(f"{folder}/conditions")
    kept = spark.read.schema("patient_id string, code string, ts timestamp, encounter string, reason string, rejected boolean") \
        .parquet(f"{folder}/conditions")
    events = kept.where(~F.col("rejected")).select("patient_id", "code", "ts").distinct()
    last = events.groupBy("patient_id").agg(F.max("ts").alias("last_encounter"))
    people = patients.select(F.col("id").alias("patient_id"), F.col("birth").alias("dob")).join(last, "patient_id", "left")
    lost = kept.where("rejected").select("reason", F.lit(None).cast("string").alias("file"), F.to_json(F.struct(
        F.col("patient_id").alias("patient"), "encounter", "code")).alias("line"))
    return Records(events, people, scan.rejects.unionByName(lost), scan.counts | {k: int(v) for k, v in seen.get.items()})


def cases_from_events(events: DataFrame, patients: DataFrame) -> DataFrame:
    """The potential-cases table of the patients that have events: each one's
    items in one cell, by the table model."""
    item = _item(F.col("code"), F.concat(F.date_format("ts", ISO_MILLIS), F.lit("Z")))
    per = events.groupBy("patient_id").agg(F.array_join(F.sort_array(F.collect_set(item)), ",").alias("codes"), F.max("ts").alias("last"))
    return per.join(patients.select("patient_id", "dob"), "patient_id", "left").select(
        F.col("patient_id").alias("patient-id"), F.coalesce("dob", F.lit(ZERO_DATE)).alias("dob"), "codes",
        F.date_format("last", ISO_MILLIS).alias("last-encounter"))
