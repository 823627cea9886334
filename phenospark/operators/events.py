"""Criteria on the long event table ``(patient_id, code, ts)`` — the form to
use at scale.

The wide table packs every event of a patient into one cell, which is the
table model's interface but grows with the longest history.  Here the same
answers come from joins and aggregates whose partial (map-side) phase
combines a hot patient's rows before any shuffle, so a patient holding a
third of all events costs one pre-aggregated row per map task:

* codelists are definitions; they are broadcast only after a bounded size
  check (``maybe_broadcast``), otherwise the join is a shuffle join that AQE
  may split for skewed codes;
* hit counts de-duplicate ``(code, ts)`` pairs, as the wide cell holds the
  distinct items of a patient (``count(DISTINCT code, ts)`` is planned as a
  two-level aggregate, first keyed by the triple, then by patient);
* every result keeps all patients (left join from the patient table).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions.cells import row_dated_codes, q
from phenospark.functions.dates import floor_days
from phenospark.operators.criteria import CASE, EXCLUSION, IDENTIFIED, UNK, TRUE, FALSE, case_flag
from phenospark.session import maybe_broadcast


def codes_frame(spark: SparkSession, codes: Iterable[str] | DataFrame, category: str | None = None) -> DataFrame:
    """A codelist as a one-column (or ``category, code``) DataFrame."""
    if isinstance(codes, DataFrame):
        return codes
    rows = [(str(c),) for c in codes]
    if not rows:
        raise ValueError("a codelist needs at least one code")
    df = spark.createDataFrame(rows, "code string")
    return df if category is None else df.select(F.lit(category).alias("category"), "code")


def _hits(events: DataFrame, codes: Iterable[str] | DataFrame) -> DataFrame:
    spark = events.sparkSession
    cl = codes_frame(spark, codes).select("code").distinct()
    return events.join(maybe_broadcast(cl), "code", "left_semi")


# C1L ------------------------------------------------------------------------
def codelist_events(events: DataFrame, patients: DataFrame, category: str,
                    codes: Iterable[str] | DataFrame, required: int = 1,
                    distinct_items: bool = True) -> DataFrame:
    """``(patient_id, <category>-identified)`` for every patient."""
    if int(required) < 1:
        raise ValueError("required must be >= 1")
    hits = _hits(events, codes)
    n = F.count_distinct("code", "ts") if distinct_items else F.count(F.lit(1))
    counts = hits.groupBy("patient_id").agg(n.alias("n_hits"))
    return (patients.select("patient_id").join(counts, "patient_id", "left")
            .select("patient_id", case_flag(F.col("n_hits") >= F.lit(int(required))).alias(f"{category}-{IDENTIFIED}")))


# C3L ------------------------------------------------------------------------
def codelist_exclude_events(events: DataFrame, patients: DataFrame, category: str,
                            codes: Iterable[str] | DataFrame) -> DataFrame:
    """``(patient_id, <category>-exclusion)``: TRUE where any event is listed."""
    hit_patients = _hits(events, codes).select("patient_id").distinct().withColumn("_hit", F.lit(True))
    return (patients.select("patient_id").join(hit_patients, "patient_id", "left")
            .select("patient_id", F.when(F.col("_hit"), F.lit(TRUE)).otherwise(F.lit(FALSE))
                    .alias(f"{category}-{EXCLUSION}")))


# C4L ------------------------------------------------------------------------
def codelists_temporal_events(events: DataFrame, patients: DataFrame, category: str,
                              before: Iterable[str] | DataFrame, after: Iterable[str] | DataFrame,
                              min_days: int, max_days: int, order: str = "date") -> DataFrame:
    """One aggregate pass per patient: ``CASE`` iff ``min_days < floor(days)
    < max_days`` between a *before* and an *after* event.

    ``order='date'``: latest before date against earliest after date.
    ``order='listed'``: the same choice the packed (sorted) wide cell makes —
    the greatest ``(code,timestamp)`` item among before hits against the
    smallest among after hits — so it equals :func:`criteria.codelists_temporal`
    on a cohort built by :func:`records.pack_events`, without building cells."""
    from phenospark.plans.records import cell_item

    if order not in ("date", "listed"):
        raise ValueError("order must be 'date' or 'listed'")
    spark = events.sparkSession
    b = codes_frame(spark, before).select("code").distinct().withColumn("is_before", F.lit(True))
    a = codes_frame(spark, after).select("code").distinct().withColumn("is_after", F.lit(True))
    tags = b.join(a, "code", "full_outer").select(
        "code", F.coalesce("is_before", F.lit(False)).alias("is_before"),
        F.coalesce("is_after", F.lit(False)).alias("is_after"))
    tagged = events.where(F.col("ts").isNotNull()).join(maybe_broadcast(tags), "code")
    if order == "date":
        per = tagged.groupBy("patient_id").agg(
            F.max(F.when(F.col("is_before"), F.col("ts"))).alias("before_ts"),
            F.min(F.when(F.col("is_after"), F.col("ts"))).alias("after_ts"))
    else:
        item = cell_item(F.col("code"), F.col("ts"))
        per = tagged.groupBy("patient_id").agg(
            F.max_by(F.when(F.col("is_before"), F.col("ts")), F.when(F.col("is_before"), item)).alias("before_ts"),
            F.min_by(F.when(F.col("is_after"), F.col("ts")), F.when(F.col("is_after"), item)).alias("after_ts"))
    days = floor_days(F.col("after_ts"), F.col("before_ts"))
    cond = (F.lit(int(min_days)) < days) & (days < F.lit(int(max_days)))
    return (patients.select("patient_id").join(per, "patient_id", "left")
            .select("patient_id", case_flag(cond).alias(f"{category}-{IDENTIFIED}")))


# C11 ------------------------------------------------------------------------
def multi_codelist_long(events: DataFrame, codelists: DataFrame, required: int = 1) -> DataFrame:
    """``(patient_id, category, n_hits)`` for every (patient, category) with
    enough hits: all categories in one join and one aggregate instead of one
    scan per category.  ``codelists`` is ``(category, code)``.  Events are
    de-duplicated by ``(patient, code, ts)`` first (keyed by the triple, so a
    hot patient spreads over tasks); the counts are then plain counts."""
    cl = codelists.select("category", "code").distinct()
    # only listed codes are shuffled
    dev = events.select("patient_id", "code", "ts").join(maybe_broadcast(cl.select("code").distinct()), "code", "left_semi").distinct()
    joined = dev.join(maybe_broadcast(cl), "code")
    return (joined.groupBy("patient_id", "category").agg(F.count(F.lit(1)).alias("n_hits"))
            .where(F.col("n_hits") >= F.lit(int(required))))


def multi_codelist(events: DataFrame, patients: DataFrame, codelists: DataFrame,
                   categories: Sequence[str], required: int = 1) -> DataFrame:
    """One ``<category>-identified`` column per category.  The category list
    is given, so one aggregate keyed by patient computes a conditional count
    per category (map-side combined) — no pivot pass, one shuffle."""
    categories = list(categories)
    if not categories:
        raise ValueError("give the categories")
    cl = codelists.where(F.col("category").isin(categories)).select("category", "code").distinct()
    # only listed codes are shuffled
    dev = events.select("patient_id", "code", "ts").join(maybe_broadcast(cl.select("code").distinct()), "code", "left_semi").distinct()
    joined = dev.join(maybe_broadcast(cl), "code")
    wide = joined.groupBy("patient_id").agg(
        *[F.count(F.when(F.col("category") == F.lit(c), F.lit(1))).alias(f"_n{i}") for i, c in enumerate(categories)])
    flags = [case_flag(F.col(f"_n{i}") >= F.lit(int(required))).alias(f"{c}-{IDENTIFIED}") for i, c in enumerate(categories)]
    return patients.select("patient_id").join(wide, "patient_id", "left").select("patient_id", *flags)


# C12 ------------------------------------------------------------------------
def extend_codelist(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Effective codelist = fixed codes ∪ codes found elsewhere."""
    cols = [c for c in static.columns if c in ("category", "code")]
    return static.select(*cols).unionByName(dynamic.select(*cols)).distinct()


# wide <-> long ----------------------------------------------------------------
def explode_cohort(df: DataFrame, id_col: str = "patient-id", cols: Sequence[str] | None = None) -> DataFrame:
    """Wide potential-cases table -> long ``(patient_id, code, ts)``."""
    cols = [c for c in (cols or df.columns)]
    items = df.select(q(id_col).alias("patient_id"), F.explode(row_dated_codes(cols)).alias("it"))
    return items.select("patient_id", F.col("it.code").alias("code"), F.col("it.ts").alias("ts"))


__all__ = [
    "codes_frame", "codelist_events", "codelist_exclude_events", "codelists_temporal_events",
    "multi_codelist_long", "multi_codelist", "extend_codelist", "explode_cohort", "CASE", "UNK",
]
