"""Steplist compiler: a phenotype definition -> one DataFrame plan.

A steplist is an ordered table ``(seq, logicType, param)``; its rows are the
query language of a phenotype:

==================  ======================  ===========================================
logicType           param                   criterion
==================  ======================  ===========================================
codelist            ``file:n``              one codelist criterion per category of file
codelistExclude     ``file``                one exclusion per category of file
age                 ``lower:upper``         age exclusion
lastEncounter       ``years``               last-encounter exclusion
codelistsTemporal   ``before:after:lo:hi``  one temporal criterion per *after* category
branch              ``steplist file``       nested steplist, folded by ``nested_cases``
keywordlist         ``file``                one keyword criterion per category
==================  ======================  ===========================================

and the definition ends with :func:`resolve_cases`.  Steplists are tiny
definitions, so they are read on the driver (bounded); the codelists stay
DataFrames.  Two evaluators share the planned steps:

* :func:`evaluate_steplist` runs on the wide table (the table model): the items of
  all cells are extracted once and joined with the same step-code table;
* :func:`evaluate_steplist_events` computes **all** coded steps in one join of
  the events with a step-code table and one aggregate keyed by
  ``(patient, step)``, pivoted on the known step columns; then the same
  projections (age, encounter, branches, resolution) run on one row per patient.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions.cells import q, row_codes, row_dated_codes
from phenospark.functions.dates import floor_days
from phenospark.operators import criteria as C
from phenospark.session import cut_lineage, maybe_broadcast


# --- names ---------------------------------------------------------------------
def clean_name(text: str, spaces: bool = False) -> str:
    """Step-name cleaner: drop '/', parenthesised tails and commas, spell
    '&amp;' as 'and'; spaces become '-' unless kept."""
    text = text.replace("/", "")
    text = re.sub(r"(\s)?\(.*\)", "", text)
    text = text.replace(",", "").replace("&amp;", "and")
    return text if spaces else text.replace(" ", "-")


def clean_name_expr(text: Column) -> Column:
    """:func:`clean_name` as a column expression."""
    text = F.regexp_replace(F.replace(text, F.lit("/"), F.lit("")), r"(\s)?\(.*\)", "")
    for mark, by in ((",", ""), ("&amp;", "and"), (" ", "-")):
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


def name_from_file(file: str) -> str:
    """Title of a codelist file: the part before '_', dashes to spaces, a
    trailing number dropped, first letter capital, no '.csv'."""
    parts = file.split("_")[0].split("-")
    if len(parts) > 1 and re.match(r"0*[1-9]", parts[-1]):
        parts.pop()
    parts[0] = parts[0][:1].upper() + parts[0][1:]
    return " ".join(parts).replace(".csv", "")


def name_from_file_col(file) -> Column:
    """:func:`name_from_file` as a column expression."""
    parts = F.split(F.substring_index(file, "_", 1), "-")
    n = F.size(parts)
    parts = F.when((n > 1) & F.element_at(parts, -1).rlike("^0*[1-9]"), F.slice(parts, 1, n - 1)).otherwise(parts)
    joined = F.array_join(parts, " ")
    cap = F.concat(F.upper(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))
    return F.replace(cap, F.lit(".csv"), F.lit(""))


def steplist_categories(codelists: DataFrame, phenotype: str) -> DataFrame:
    """Raw long codelists ``(filename, row_no, attrs)`` -> ``(file, category,
    code)`` for the compiler: each file is curated under its own title (the
    phenotype name when the title is the phenotype); every raw code is also
    listed with a NULL category, which only temporal "before" lists use."""
    from phenospark.operators import codelists as K

    title = name_from_file_col(F.col("filename"))
    name = F.when(F.lower(title) == F.lit(phenotype.lower()), F.lit(phenotype)).otherwise(title)
    cl = K.clean_headers(codelists).withColumn("name", name)
    cats = K.categories(cl).select(F.col("filename").alias("file"), "category", "code")
    # every row's code, with no category: the "before" list of a temporal
    # step is the whole file (rows marked case_incl = N included)
    raw = cl.select(F.col("filename").alias("file"), F.lit(None).cast("string").alias("category"),
                    K.code_expr(F.col("attrs")).alias("code")).where(F.col("code").isNotNull())
    return cats.unionByName(raw)


# --- planned steps ---------------------------------------------------------------
@dataclass
class Step:
    kind: str                      # codelist | exclude | temporal | age | last_encounter | keywords | branch
    column: str                    # flag column written by the step
    file: str | None = None        # codelist (after-file for temporal)
    category: str | None = None
    required: int = 1
    before_file: str | None = None
    lower: int | None = None
    upper: int | None = None
    years: int | None = None
    item: int = 0                  # steplist row the step came from (groups of a branch)
    branch: list["Step"] = field(default_factory=list)


def _rows(steplist) -> list[tuple[int, str, str]]:
    if isinstance(steplist, DataFrame):
        rows = [(int(r["seq"]), r["logicType"], r["param"]) for r in steplist.collect()]
    else:
        rows = [(int(s), t, p) for s, t, p in steplist]
    return sorted(rows)


def _files(steplist, nested: dict) -> set[str]:
    """The codelist files a steplist names, those of its branches included."""
    out = set()
    for _, kind, param in _rows(steplist):
        p = str(param).split(":")
        if kind == "branch" and p[0] in nested:
            out |= _files(nested[p[0]], nested)
        else:
            out |= set(p[:2] if kind == "codelistsTemporal" else p[:1])
    return out


def plan_steplist(steplist, categories: DataFrame, nested: dict | None = None,
                  file_categories: dict | None = None) -> list[Step]:
    """Expand steplist rows into steps.  ``categories`` is ``(file, category,
    code)``; only the category *names* of the files that the steplist names are
    read here.

    Every step writes a flag of its own.  Where two steps of one list share a
    name, its codelist steps take their file's category
    (``file_categories``: file -> text) into their names; a name that is still
    shared, by another step or by a step of a branch, gets a number: ``-2``,
    ``-3``, ... before its ending."""
    nested = nested or {}
    cat_names = (categories.where(F.col("category").isNotNull() & F.col("file").isin(sorted(_files(steplist, nested))))
                 .select("file", "category").distinct())
    names: dict = {}
    for r in cat_names.collect():
        names.setdefault(r["file"], []).append(r["category"])
    for f in names:
        names[f].sort()
    return _planned(steplist, names, nested, file_categories or {}, set())


def _planned(steplist, names: dict, nested: dict, file_categories: dict, used: set) -> list[Step]:
    def cats(file):
        if file not in names:
            raise ValueError(f"no categories for codelist file {file!r}")
        return names[file]

    steps: list[Step] = []
    for item, (_, kind, param) in enumerate(_rows(steplist)):
        p = str(param).split(":")
        if kind == "codelist":
            req = int(p[1]) if len(p) > 1 and p[1] else 1
            for cat in cats(p[0]):
                steps.append(Step("codelist", clean_name(cat.lower()) + "-identified", p[0], cat, req, item=item))
        elif kind == "codelistExclude":
            for cat in cats(p[0]):
                steps.append(Step("exclude", clean_name(cat.lower() + " exclude") + "-exclusion", p[0], cat, item=item))
        elif kind == "age":
            steps.append(Step("age", "age-exclusion", lower=int(p[0]), upper=int(p[1]), item=item))
        elif kind == "lastEncounter":
            steps.append(Step("last_encounter", "last-encounter-exclusion", years=int(p[0]), item=item))
        elif kind == "codelistsTemporal":
            before, after, lo, hi = p[0], p[1], int(p[2]), int(p[3])
            nb = clean_name(name_from_file(before).lower())
            for cat in cats(after):
                col = clean_name(f"{clean_name(cat.lower())} {lo} to {hi} days after {nb}") + "-identified"
                steps.append(Step("temporal", col, after, cat, before_file=before, lower=lo, upper=hi, item=item))
        elif kind == "keywordlist":
            for cat in cats(p[0]):
                steps.append(Step("keywords", clean_name(cat.lower()) + "-identified", p[0], cat, item=item))
        elif kind == "branch":
            if p[0] not in nested:
                raise ValueError(f"no nested steplist {p[0]!r}")
            name = clean_name(name_from_file(p[0]).lower())
            steps.append(Step("branch", name + "-identified", file=p[0], item=item))
        else:
            raise ValueError(f"unknown logicType {kind!r}")
    if len({s.column for s in steps}) < len(steps):
        for s in steps:
            if s.kind == "codelist" and file_categories.get(s.file):
                stem, end = s.column.rsplit("-", 1)
                s.column = f"{stem}-{clean_name(file_categories[s.file].lower())}-{end}"
    for s in steps:
        stem, end = s.column.rsplit("-", 1)
        count = 1
        while s.column in used:
            count += 1
            s.column = f"{stem}-{count}-{end}"
        used.add(s.column)
    for s in steps:                       # branches last: the names of the list itself come first
        if s.kind == "branch":
            s.branch = _planned(nested[s.file], names, nested, file_categories, used)
    return steps


def branch_groups(steps: list[Step]) -> list[list[str]]:
    """Groups of a branch: one per steplist row that writes ``-identified``
    columns (exclusions, age and encounter rows form no group)."""
    groups: dict[int, list[str]] = {}
    for s in steps:
        if s.kind in ("codelist", "temporal", "keywords", "branch"):
            groups.setdefault(s.item, []).append(s.column)
    return [groups[k] for k in sorted(groups)]


# --- wide evaluation ---------------------------------------------------------------
def _row_digest(df: DataFrame) -> Column:
    """Rows with equal cells have equal flags, so a digest of the cells joins flags to rows."""
    return F.sha2(F.to_json(F.struct(*[q(c).cast("string").alias(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)


#: Code and step of the item that every row has; no cell lists it, as no listed code has a comma.
EACH_ROW = ","


def _cell_hits(keyed: DataFrame, cols: list[str], sc: DataFrame) -> DataFrame:
    """``(_row, code, step, role, ts, at)``: the items of each row's cells that are
    in the step-code table ``sc``, ``at`` being their place in the row, and one item
    ``EACH_ROW`` a row.  Each row is extracted from once, however many steps there are."""
    none = F.lit(None).cast("timestamp")
    one = F.array(F.struct(F.lit(True).alias("counted"), F.lit(EACH_ROW).alias("code"), none.alias("ts"), F.lit(-1).alias("at")))
    marker = sc.sparkSession.range(1).select(F.lit(EACH_ROW).alias("code"), F.lit(EACH_ROW).alias("step"), F.lit("count").alias("role"))
    sc = sc.where(~F.col("code").contains(",")).unionByName(marker)          # no cell lists a code with a comma
    counted = F.transform(row_codes(cols), lambda c, i: F.struct(F.lit(True).alias("counted"), c.alias("code"), none.alias("ts"), i.alias("at")))
    dated = F.transform(row_dated_codes(cols), lambda x, i: F.struct(F.lit(False).alias("counted"), x["code"].alias("code"), x["ts"].alias("ts"), i.alias("at")))
    items = keyed.select("_row", F.explode(F.concat(one, counted, dated)).alias("x")).select("_row", "x.*").where(F.col("counted") | F.col("ts").isNotNull())
    return items.join(maybe_broadcast(sc), "code").where(F.col("counted") == (F.col("role") == "count"))


def _apply_wide(df: DataFrame, steps: list[Step], hidden: dict, as_of) -> DataFrame:
    """Puts each computed flag under its name at its step's place; age, encounter and
    branch steps are projections there."""
    for s in steps:
        if s.column in hidden:
            df = df.select(*[q(c) for c in df.columns if c != hidden[s.column]], q(hidden[s.column]).alias(s.column))
        elif s.kind == "age":
            df = C.age(df, s.lower, s.upper, as_of, name=s.column.rsplit("-", 1)[0])
        elif s.kind == "last_encounter":
            df = C.last_encounter(df, s.years, as_of, name=s.column.rsplit("-", 1)[0])
        elif s.kind == "branch":
            df = _apply_wide(df, s.branch, hidden, as_of)
            df = C.nested_cases(df, branch_groups(s.branch), s.column.rsplit("-", 1)[0])
    return df


def evaluate_steplist(df: DataFrame, steps: list[Step], categories: DataFrame, as_of,
                      keywords: dict | None = None) -> DataFrame:
    """Wide table in, resolved cases out.  Codes stay a table of any length: the items
    of all cells are extracted once, joined with the step-code table and folded back by
    row (counts; the last-listed before and first-listed after date of temporal
    steps).  Keyword steps match through the literal index; their patterns are the codes of
    their file, or those of ``keywords`` ((file, category) -> patterns)."""
    flat = _flat(steps)
    coded = [s for s in flat if s.kind in ("codelist", "exclude", "temporal")]
    worded = [s for s in flat if s.kind == "keywords"]
    keyed, flags, hidden = df.withColumn("_row", _row_digest(df)), [], {}
    wide = None
    if coded:
        # A row's hits lie in one task, which adds them up before they are shuffled; equal
        # rows have equal hits, so that counts are held against the number of such rows.
        hits = _cell_hits(keyed, df.columns, cut_lineage(_step_codes(steps, categories)))
        aggs = [F.count(F.when(F.col("step") == F.lit(EACH_ROW), F.lit(1))).alias("_equal")]
        for i, s in enumerate(coded):
            mine = F.col("step") == F.lit(s.column)
            if s.kind == "temporal":
                before, after = mine & (F.col("role") == "before"), mine & (F.col("role") == "after")
                aggs += [F.max_by(F.when(before, F.col("ts")), F.when(before, F.col("at"))).alias(f"_b{i}"),
                         F.min_by(F.when(after, F.col("ts")), F.when(after, F.col("at"))).alias(f"_a{i}")]
            else:
                aggs.append(F.count(F.when(mine, F.lit(1))).alias(f"_n{i}"))
            hidden[s.column] = f"__step{len(hidden)}"
            days = floor_days(F.col(f"_a{i}"), F.col(f"_b{i}"))
            flags.append({"codelist": lambda i=i, s=s: C.case_flag(F.col(f"_n{i}") >= F.lit(s.required) * F.col("_equal")),
                          "exclude": lambda i=i: C.exclusion_flag(F.col(f"_n{i}") >= F.lit(1)),
                          "temporal": lambda days=days, s=s: C.case_flag((F.lit(s.lower) < days) & (days < F.lit(s.upper)))}[s.kind]().alias(hidden[s.column]))
        wide = hits.groupBy("_row").agg(*aggs)
    if worded:
        from phenospark.operators.keyword_index import keyword_matches

        spark = df.sparkSession
        spec = spark.createDataFrame([(s.column, s.file, s.category) for s in worded], "step string, file string, category string")
        given = categories if keywords is None else spark.createDataFrame(
            [(f, c, p) for (f, c), ps in keywords.items() for p in ps], "file string, category string, code string")
        patterns = spec.join(given.select("file", "category", "code"), ["file", "category"]).select(F.col("step").alias("category"), F.col("code").alias("pattern"))
        met = keyword_matches(keyed, patterns, "_row", df.columns)
        found = met.groupBy("_row").agg(*[F.bool_or(F.col("category") == s.column).alias(f"_k{i}") for i, s in enumerate(worded)])
        wide = found if wide is None else wide.join(found, "_row", "full")
        for i, s in enumerate(worded):
            hidden[s.column] = f"__step{len(hidden)}"
            flags.append(C.case_flag(F.col(f"_k{i}")).alias(hidden[s.column]))
    if wide is not None:
        df = keyed.join(wide, "_row", "left").select(*[q(c) for c in df.columns], *flags)
    return C.resolve_cases(_apply_wide(df, steps, hidden, as_of))


# --- long evaluation -----------------------------------------------------------------
def _flat(steps: list[Step]) -> list[Step]:
    out = []
    for s in steps:
        out.extend(_flat(s.branch) if s.kind == "branch" else [s])
    return out


def _step_codes(steps: list[Step], categories: DataFrame) -> DataFrame:
    """``(code, step, role)`` for every coded step: role ``count`` (codelist,
    exclude), ``before`` / ``after`` (temporal)."""
    spark = categories.sparkSession
    spec = []
    for s in _flat(steps):
        if s.kind in ("codelist", "exclude"):
            spec.append((s.column, s.file, s.category, "count"))
        elif s.kind == "temporal":
            spec.append((s.column, s.before_file, None, "before"))
            spec.append((s.column, s.file, s.category, "after"))
    if not spec:
        return None
    sdf = spark.createDataFrame(spec, "step string, file string, category string, role string")
    cl = categories.select("file", "category", "code")
    by_cat = sdf.where(F.col("category").isNotNull()).join(cl, ["file", "category"])
    by_file = sdf.where(F.col("category").isNull()).drop("category").join(cl.drop("category"), "file")
    return by_cat.select("code", "step", "role").unionByName(by_file.select("code", "step", "role")).distinct()


def evaluate_steplist_events(events: DataFrame, patients: DataFrame, steps: list[Step], categories: DataFrame,
                             as_of, temporal_order: str = "date") -> DataFrame:
    """Long form: ``events (patient_id, code, ts)``, ``patients (patient_id,
    dob, last_ts)`` -> ``(patient_id, <step flags>...)`` resolved.  Temporal
    steps compare the latest before date with the earliest after date, or,
    with ``temporal_order='listed'``, the items the packed wide cell lists
    last / first (equal to :func:`evaluate_steplist` on that cell)."""
    flat = _flat(steps)
    coded = [s for s in flat if s.kind in ("codelist", "exclude", "temporal")]
    base = patients.select("patient_id", F.date_format("dob", "yyyy-MM-dd").alias("dob"),
                           F.date_format("last_ts", "yyyy-MM-dd").alias("last-encounter"))
    if coded:
        sc = _step_codes(steps, categories)
        # Distinct (patient, code, ts) once: keyed by the triple, so a hot
        # patient is spread over tasks; then one aggregate keyed by patient
        # computes every step's count / latest-before / earliest-after as
        # conditional algebraic aggregates (map-side combined, one shuffle).
        # Events of no listed code go before that shuffle.
        listed = maybe_broadcast(sc.select("code").distinct())
        dev = events.select("patient_id", "code", "ts").join(listed, "code", "left_semi").distinct()
        joined = dev.join(maybe_broadcast(sc), "code")
        if temporal_order == "listed":
            from phenospark.plans.records import cell_item
            joined = joined.withColumn("_item", cell_item(F.col("code"), F.col("ts")))
        elif temporal_order != "date":
            raise ValueError("temporal_order must be 'date' or 'listed'")
        aggs = []
        for st in coded:
            mine = F.col("step") == F.lit(st.column)
            if st.kind in ("codelist", "exclude"):
                aggs.append(F.count(F.when(mine & (F.col("role") == "count"), F.lit(1))).alias(f"{st.column}_n"))
            elif temporal_order == "date":
                aggs.append(F.max(F.when(mine & (F.col("role") == "before"), F.col("ts"))).alias(f"{st.column}_b"))
                aggs.append(F.min(F.when(mine & (F.col("role") == "after"), F.col("ts"))).alias(f"{st.column}_a"))
            else:  # "listed": the choice the sorted packed cell makes
                isb, isa = mine & (F.col("role") == "before"), mine & (F.col("role") == "after")
                aggs.append(F.max_by(F.when(isb, F.col("ts")), F.when(isb, F.col("_item"))).alias(f"{st.column}_b"))
                aggs.append(F.min_by(F.when(isa, F.col("ts")), F.when(isa, F.col("_item"))).alias(f"{st.column}_a"))
        wide = joined.groupBy("patient_id").agg(*aggs)
        base = base.join(wide, "patient_id", "left")
    exprs = {}
    for s in coded:
        n, b, a = q(f"{s.column}_n"), q(f"{s.column}_b"), q(f"{s.column}_a")
        if s.kind == "codelist":
            exprs[s.column] = C.case_flag(n >= F.lit(s.required))
        elif s.kind == "exclude":
            exprs[s.column] = C.exclusion_flag(n >= F.lit(1))
        else:
            d = floor_days(a, b)
            exprs[s.column] = C.case_flag((F.lit(s.lower) < d) & (d < F.lit(s.upper)))
    # Flags are computed in one pass above under neutral names; fold() puts
    # each under its real name at its step position (column order carries
    # meaning: resolution and branches only see what lies to the left).
    hidden = {c: f"__step{i}" for i, c in enumerate(exprs)}
    df = base.select("patient_id", "dob", "last-encounter", *[e.alias(hidden[c]) for c, e in exprs.items()])

    def fold(df, steps):
        for s in steps:
            if s.kind in ("codelist", "exclude", "temporal"):
                h = hidden[s.column]
                df = df.select(*[q(c) for c in df.columns if c != h], q(h).alias(s.column))
            elif s.kind == "age":
                df = C.age(df, s.lower, s.upper, as_of, name=s.column.rsplit("-", 1)[0])
            elif s.kind == "last_encounter":
                df = C.last_encounter(df, s.years, as_of, name=s.column.rsplit("-", 1)[0])
            elif s.kind == "branch":
                df = fold(df, s.branch)
                df = C.nested_cases(df, branch_groups(s.branch), s.column.rsplit("-", 1)[0])
            else:
                raise ValueError("keyword steps need the wide table")
        return df

    return C.resolve_cases(fold(df, steps))
