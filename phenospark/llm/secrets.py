"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256): equal texts are one
blob.  The ledger is a table in a folder: for each (blob, rule version) that has
been scanned, the spans found, or none.  A scan of a table of versions

1. takes the distinct blobs (copies meet in the task that reads them first),
2. drops the (blob, rule version) pairs that the ledger has,
3. runs only the missing rules, and appends what they find, and
4. joins the findings of the blobs back to all paths and versions.

A new version of a rule rescans every blob by that rule alone; a text that comes
back years later is never scanned again.

Spans are in code points, end exclusive, leftmost and not overlapping for each
rule.  They come from the text between the matches and the matches themselves
(a split and an extraction by the same pattern), so no position is computed by a
row-wise function.

Defined cases: a null text is empty and has no spans; null ids and repeated rows
are rows like others; further columns are ignored; an empty table scans nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from phenospark.llm.common import shared_folder, written


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java pattern.  ``measured``: the group whose length must be
    at least ``least`` (0: the match); shorter matches are dropped after they
    have taken their place."""

    kind: str
    version: int
    pattern: str
    measured: int
    least: int
    #: Every text with a span has a match of this; others needn't be split.
    hint: str = ""


#: Fixed patterns and lengths, in the order of the kinds.
RULES = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of the rule's spans in ``text``."""
    gaps = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured)), F.length) if rule.measured else \
        F.transform(matches, F.length)
    found = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), matches.alias("match"), sizes.alias("size"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    all_spans = F.aggregate(found, start, step, lambda s: s["spans"])
    return F.when(text.rlike(rule.hint), all_spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _ledger(spark, folder: str) -> DataFrame:
    schema = f"kind string, version int, blob string, spans array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` has ``text`` and columns that name the path and version.
    Brings the ledger up to date and returns the columns with ``blob`` and
    ``spans`` (sorted by start, then kind as listed) instead of ``text``.

    What is due is known from hashes; only texts of due blobs are fetched, a copy
    each.  A pair that the ledger holds twice (two scans at once, or an append that
    ran again) counts once."""
    spark = versions.sparkSession
    names = [c for c in versions.columns if c != "text"]
    scratch = shared_folder(spark, "scan")
    addressed = versions.select(F.struct(*names).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("blob", F.sha2("text", 256))
    seen = _ledger(spark, ledger).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    names_of_rules = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    lacking = F.array_except(names_of_rules, F.coalesce("done", F.array().cast("array<string>")))
    due = written(addressed.select("blob").distinct().join(seen, "blob", "left").select("blob", lacking.alias("lacking"))
                  .filter(F.size("lacking") > 0), scratch, "due")
    lacks = lambda r: F.array_contains("lacking", f"{r.kind}:{r.version}")
    # the blobs are few hashes beside the texts: they meet first, then copies of one blob meet in the task that reads them
    texts = addressed.select("blob", "text").join(due, "blob").distinct()
    results = texts.select("blob", F.explode(F.filter(F.array(*[
        F.when(lacks(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                                  spans(F.col("text"), r, i).alias("spans")))
        for i, r in enumerate(rules)]), lambda x: x.isNotNull())).alias("x"))
    results.select("x.kind", "x.version", "blob", "x.spans").write.mode("append").parquet(ledger)

    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    # only findings are joined back, a row a blob with any, however many paths it has; written, so that a hot blob's paths can be split
    found = written(_ledger(spark, ledger).filter(current & (F.size("spans") > 0)).groupBy("blob")
                    .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")), scratch, "found")
    return addressed.select("path", "blob").join(found, "blob", "left").select(
        "path.*", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def spelled(spans_column: str | Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scanned_documents(docs: DataFrame) -> DataFrame:
    """All documents, in two versions against one ledger of this run: as they were
    before their last line came, and as they are.  The second scan reads the
    findings of texts that did not change from the ledger.  Returns the second."""
    ledger = shared_folder(docs.sparkSession, "ledger")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scan(rows.withColumn("text", F.regexp_replace("text", r"(?s)\n[^\n]*\z", "")), ledger)
    return scan(rows, ledger)
