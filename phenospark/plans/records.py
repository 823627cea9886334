"""The given tables seen as a health record.

* patients  = ``customer``; ``dob`` is derived from the key by a fixed rule.
* coded events = ``lineitem`` joined to ``orders`` (patient) and ``part``
  (code = brand), dated by the ship date.  A second event set is ``events``
  (patient ``user_id``, code ``event_type``, time ``ts`` with microseconds).
* last encounter = latest order date of the patient.
* the wide potential-cases table packs each patient's distinct dated codes
  as ``(code,date),...`` in sorted order, so "listed order" is repeatable.

Every function reads only the columns it needs, so the parquet scans carry
narrow ``ReadSchema``s and the filters of later criteria push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping (shared with the SQL oracles).
DOB_ORIGIN = "1920-01-01"
DOB_MULTIPLIER = 7919
DOB_SPAN_DAYS = 36500
AS_OF = "2002-06-30"
CELL_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
DATE_FORMAT = "yyyy-MM-dd"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(patient_id BIGINT, dob DATE)``, one row per patient."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    offset = ((F.col("c_custkey") * DOB_MULTIPLIER) % DOB_SPAN_DAYS).cast("int")
    return c.select(F.col("c_custkey").alias("patient_id"),
                    F.date_add(F.lit(DOB_ORIGIN).cast("date"), offset).alias("dob"))


def coded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(patient_id, code, ts)``: one row per line item (repeats kept)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("o_custkey").alias("patient_id"), F.col("p_brand").alias("code"),
                      F.col("l_shipdate").alias("ts")))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second event set: ``(patient_id, code, ts)`` out of ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("code"), "ts")


def last_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return o.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.max("o_orderdate").alias("last_ts"))


def cell_item(code, ts):
    return F.concat(F.lit("("), code, F.lit(","), F.date_format(ts, CELL_TS_FORMAT), F.lit(")"))


def pack_events(events: DataFrame) -> DataFrame:
    """``(patient_id, codes)``: distinct ``(code,date)`` items, sorted, joined
    by commas.  ``collect_set`` de-duplicates in its map-side partial
    aggregate, so a patient with a huge raw history ships only its distinct
    items per map task, in one shuffle keyed by patient."""
    items = events.select("patient_id", cell_item(F.col("code"), F.col("ts")).alias("item"))
    return items.groupBy("patient_id").agg(F.array_join(F.sort_array(F.collect_set("item")), ",").alias("codes"))


def cohort_from_parts(pats: DataFrame, events: DataFrame, last_enc: DataFrame) -> DataFrame:
    """Wide table ``patient-id, dob, codes, last-encounter`` (all strings)."""
    packed = pack_events(events)
    j = pats.join(packed, "patient_id", "left").join(last_enc, "patient_id", "left")
    return j.select(
        F.col("patient_id").cast("string").alias("patient-id"),
        F.date_format("dob", DATE_FORMAT).alias("dob"),
        F.coalesce(F.col("codes"), F.lit("")).alias("codes"),
        F.date_format("last_ts", DATE_FORMAT).alias("last-encounter"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_from_parts(patients(spark, sf_dir), coded_events(spark, sf_dir),
                             last_encounters(spark, sf_dir))


def stream_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table over the ``events`` set; patients are its users, dob by the
    same rule, last encounter = latest event."""
    ev = stream_events(spark, sf_dir)
    users = ev.select("patient_id").distinct()
    offset = ((F.col("patient_id") * DOB_MULTIPLIER) % DOB_SPAN_DAYS).cast("int")
    pats = users.select("patient_id", F.date_add(F.lit(DOB_ORIGIN).cast("date"), offset).alias("dob"))
    last = ev.groupBy("patient_id").agg(F.max("ts").alias("last_ts"))
    return cohort_from_parts(pats, ev, last)
