"""S2-S5: potential-cases tables out of health-record exports.

All readers end in the same shape — ``patient-id, dob, codes,
last-encounter`` as strings — built by one ``groupBy(patient)`` that packs
the distinct items (``collect_set``, de-duplicated map-side, sorted so the
listed order is repeatable) and takes the latest date in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date spellings of the exports.
ZERO_DATE = "0000-00-00"
ZERO_DATETIME = "0000-00-00T00:00:00.000"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def _item(code: Column, when: Column) -> Column:
    return F.concat(F.lit("("), code.cast("string"), F.lit(","), when, F.lit(")"))


def _ref_id(ref: Column) -> Column:
    return F.substring_index(ref, "/", -1)


# S2 ------------------------------------------------------------------------------
def cohort_from_fhir(condition: DataFrame, patient: DataFrame, encounter: DataFrame) -> DataFrame:
    """FHIR Condition / Patient / Encounter resources (as read from bulk NDJSON
    with ``spark.read.json``).  Each condition is joined to its patient and
    encounter; the first coding is the code, the encounter end the date."""
    c = condition.select(_ref_id(F.col("subject.reference")).alias("patient"),
                         _ref_id(F.col("context.reference")).alias("encounter"),
                         F.try_element_at(F.col("code.coding"), F.lit(1))["code"].alias("code"))
    p = patient.select(F.col("id").cast("string").alias("patient"), F.col("birthDate").cast("string").alias("dob"))
    e = encounter.select(F.col("id").cast("string").alias("encounter"),
                         F.col("period.end").cast("string").try_cast("timestamp").alias("end"))
    j = c.join(p, "patient").join(e, "encounter")
    item = _item(F.col("code"), F.concat(F.date_format("end", ISO_MILLIS), F.lit("Z")))
    per = j.groupBy("patient").agg(F.array_join(F.sort_array(F.collect_set(item)), ",").alias("codes"),
                                   F.max("dob").alias("dob"), F.max("end").alias("last"))
    return per.select(F.col("patient").alias("patient-id"), F.coalesce("dob", F.lit(ZERO_DATE)).alias("dob"), "codes",
                      F.date_format("last", ISO_MILLIS).alias("last-encounter"))


# S3 ------------------------------------------------------------------------------
def cohort_from_omop(person: DataFrame, records: DataFrame, observation: DataFrame) -> DataFrame:
    """OMOP person profiles: ``person(person_id, year_of_birth)``,
    ``records(person_id, domain, concept_id, end_day)`` with days counted from
    the first observed month of ``observation(month_year)`` (``YYYYMM``).
    Only the ``condition`` domain counts.  No cap on the number of persons."""
    # The start is one scalar (first observed month); it enters the plan as a literal.
    first = observation.agg(F.min("month_year").alias("m")).first()["m"]
    start = F.to_date(F.lit(str(first)), "yyyyMM")
    r = (records.where(F.col("domain") == "condition")
         .select(F.col("person_id").alias("patient"), "concept_id",
                 F.date_add(start, F.col("end_day").cast("int")).cast("timestamp").alias("when")))
    item = _item(F.col("concept_id"), F.concat(F.date_format("when", ISO_MILLIS), F.lit("Z")))
    per = r.groupBy("patient").agg(F.array_join(F.sort_array(F.collect_set(item)), ",").alias("codes"),
                                   F.max("when").alias("last"))
    p = person.select(F.col("person_id").alias("patient"),
                      F.when(F.col("year_of_birth").isNotNull(),
                             F.concat(F.col("year_of_birth").cast("string"), F.lit("-01-01")))
                      .otherwise(F.lit(ZERO_DATE)).alias("dob"))
    return (per.join(p, "patient", "left")
            .select(F.col("patient").cast("string").alias("patient-id"), F.coalesce("dob", F.lit(ZERO_DATE)).alias("dob"),
                    "codes", F.date_format("last", ISO_MILLIS).alias("last-encounter")))


# S4 ------------------------------------------------------------------------------
def cohort_from_i2b2(patients: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """i2b2 patient set ``(patient_id, birth_date)`` and two observation sets
    ``(patient_id, concept_cd, end_date)``: the code is the text after ':' in
    ``concept_cd``; an observation without end date gets the zero date; the
    last encounter is the latest end date over both sets."""
    obs = primary.select("patient_id", "concept_cd", "end_date").unionByName(
        secondary.select("patient_id", "concept_cd", "end_date"))
    end = F.col("end_date").cast("string").try_cast("timestamp")
    o = obs.select(F.col("patient_id").cast("string").alias("patient"),
                   F.try_element_at(F.split("concept_cd", ":"), F.lit(2)).alias("code"), end.alias("end"))
    item = _item(F.col("code"), F.coalesce(F.date_format("end", ISO_MILLIS), F.lit(ZERO_DATETIME)))
    per = o.groupBy("patient").agg(F.array_join(F.sort_array(F.collect_set(item)), ",").alias("codes"),
                                   F.max("end").alias("last"))
    p = patients.select(F.col("patient_id").cast("string").alias("patient"), F.col("birth_date").cast("string").alias("dob"))
    return (per.join(p, "patient", "left")
            .select(F.col("patient").alias("patient-id"), "dob", "codes",
                    F.date_format("last", ISO_MILLIS).alias("last-encounter")))


# S5 ------------------------------------------------------------------------------
XML_SCHEMA = T.StructType([
    T.StructField("Identity", T.StructType([T.StructField("NHSNumber", T.StringType())])),
    T.StructField("Demographics", T.StructType([T.StructField("DateOfBirth", T.StringType())])),
    T.StructField("Clinical", T.StructType([T.StructField("Event", T.StructType([
        T.StructField("ClinicalCode", T.StructType([T.StructField("Code", T.StructType([
            T.StructField("@_Code", T.StringType())]))]))]))])),
])


def cohort_from_xml(spark: SparkSession, path: str, row_tag: str = "Response") -> DataFrame:
    """One ``<Response>`` record per patient: NHS number, date of birth and the
    code attribute -> ``patient-id, dob, codes``.  The schema is explicit so
    that identifiers stay strings."""
    df = (spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@_")
          .schema(XML_SCHEMA).load(path))
    return df.select(F.col("Identity.NHSNumber").alias("patient-id"),
                     F.col("Demographics.DateOfBirth").alias("dob"),
                     F.col("Clinical.Event.ClinicalCode.Code.`@_Code`").alias("codes"))
