"""Codelist curation: many raw codelist files -> named code categories.

Input is the long codelist table ``(filename, row_no, attrs MAP<STRING,STRING>)``
(see :func:`phenospark.sources.read_codelists`); one phenotype name per file
comes as a column ``name`` or a literal.  Every step is a join or an
aggregate keyed by file, so thousands of codelists are curated in one plan.

Deviation (documented): the table model tags nouns/adjectives with an
English NLP library; here a fixed list of function words and a plain plural
rule stand in for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenospark.functions import text as TX
from phenospark.session import cut_lineage, maybe_broadcast, spread, tasks_for


def _at(arr: Column, i: int) -> Column:
    """Element ``i`` (1-based, negative from the end) or NULL when absent."""
    return F.try_element_at(arr, F.lit(i))


def _with_name(cl: DataFrame, name) -> DataFrame:
    if isinstance(name, str):
        return cl.withColumn("name", F.lit(name))
    if "name" not in cl.columns:
        raise ValueError("give a phenotype name (string) or a 'name' column")
    return cl


# K1 -----------------------------------------------------------------------------
def clean_headers(cl: DataFrame) -> DataFrame:
    """Header keys -> lower case letters and digits; when two keys clean to
    the same name the later one wins.  (One fold over the entries, so the
    expression references its input once.)"""
    ent = F.transform(F.map_entries("attrs"),
                      lambda e: F.struct(TX.full_clean(e["key"]).alias("key"), e["value"].alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    dedup = F.aggregate(ent, empty, lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return cl.withColumn("attrs", F.map_from_entries(dedup))


def included(cl: DataFrame) -> DataFrame:
    """Rows whose ``case_incl`` is absent, empty or not 'N'."""
    return cl.where(F.coalesce(F.col("attrs")["caseincl"], F.lit("")) != "N")


# K2 -----------------------------------------------------------------------------
def code_expr(attrs: Column | None = None) -> Column:
    attrs = F.col("attrs") if attrs is None else attrs
    keys = TX.PRIMARY_CODE_KEYS + TX.SECONDARY_CODE_KEYS
    first = _at(F.filter(F.map_entries(attrs),
                                  lambda e: F.lower(e["key"]).isin(keys) & (F.coalesce(e["value"], F.lit("")) != "")), 1)
    return F.coalesce(F.nullif(attrs["code"], F.lit("")), first["value"])


def resolve_code(cl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``code``; returns (resolved rows, rows without any usable code)."""
    df = cl.withColumn("code", code_expr(F.col("attrs")))
    return df.where(F.col("code").isNotNull()), df.where(F.col("code").isNull())


# K3 -----------------------------------------------------------------------------
def with_description(df: DataFrame, attrs: str = "attrs", out: str = "description") -> DataFrame:
    """Adds the description: the first present of the known description
    headers; '[X]'/'[D]' dropped; a three-word "A of B" becomes "B A"; in
    longer descriptions the ignored words are left out.  Each intermediate
    is referenced once or twice, so the expression stays small even when
    the optimizer inlines it into later filters."""
    a = F.col(attrs)
    keys = F.map_keys(a)
    raw = F.coalesce(*[F.when(F.array_contains(keys, k), F.coalesce(a[k], F.lit(""))) for k in TX.DESCRIPTION_KEYS])
    d = TX.replace_first(TX.replace_first(raw, "[X]"), "[D]")
    swapped = F.regexp_replace(d, TX.A_OF_B, "$2 $1")
    df = df.withColumn("_d", swapped)
    parts = TX.split_terms(F.col("_d"))
    kept = F.array_join(F.filter(parts, lambda w: ~TX.ignored(TX.clean_word(w))), " ")
    df = df.withColumn(out, F.when(F.col("_d") != "", F.when(F.size(parts) > 1, kept).otherwise(F.col("_d"))))
    return df.drop("_d")


def resolve_description(cl: DataFrame) -> DataFrame:
    return with_description(cl)


# K4 -----------------------------------------------------------------------------
def _group_of(first: Column, groups_sys, groups_keys) -> Column:
    sysv = F.coalesce(F.nullif(first["codingsystem"], F.lit("")), F.nullif(first["codetype"], F.lit("")),
                      F.nullif(first["vocabulary"], F.lit("")))
    by_sys = F.coalesce(TX.full_clean(sysv).isin(groups_sys), F.lit(False))
    by_key = F.exists(F.map_keys(first), lambda k: TX.full_clean(k).isin(groups_keys))
    return by_sys | by_key


def coding_system_group(cl: DataFrame) -> DataFrame:
    """``(filename, system_group)``: primary / secondary from the first
    included row (coding-system value or code header), else a known other
    system named by the file-name suffix, else 'undefined'."""
    first = included(cl).groupBy("filename").agg(F.min_by("attrs", "row_no").alias("first"))
    stem = F.substring_index(F.col("filename"), ".", 1)
    suffix = TX.full_clean(F.substring_index(stem, "_", -1))
    other = F.coalesce(*[F.when(suffix == TX.full_clean(F.lit(s)), F.lit(s)) for s in TX.OTHER_SYSTEMS],
                       F.lit("undefined"))
    grp = (F.when(_group_of(F.col("first"), TX.PRIMARY_SYSTEMS, TX.PRIMARY_CODE_KEYS), F.lit("primary"))
           .when(_group_of(F.col("first"), TX.SECONDARY_SYSTEMS, TX.SECONDARY_CODE_KEYS), F.lit("secondary"))
           .otherwise(other))
    return first.select("filename", grp.alias("system_group"))


# K5 -----------------------------------------------------------------------------
def _terms(cl: DataFrame) -> DataFrame:
    """``(filename, name, row_no, pos, term)`` for every description word."""
    d = cl.where(F.col("description").isNotNull())
    ex = d.select("filename", "name", "row_no", F.posexplode(TX.split_terms("description")).alias("pos", "raw"))
    ex = ex.withColumn("_c", TX.full_clean(F.col("raw")))
    return ex.select("filename", "name", "row_no", "pos", TX.singular(F.col("_c")).alias("term"))


def term_counts(cl: DataFrame, name=None, only_included: bool = True) -> DataFrame:
    """``(filename, term, n, first_row, first_pos, rank)``: terms longer than
    four letters, not part of the name, seen more than once; ``rank`` 1 is
    the most frequent (ties: first seen)."""
    cl = _with_name(cl, name) if name is not None else cl
    if "description" not in cl.columns:
        cl = with_description(cl)
    t = _terms(included(cl) if only_included else cl).where(F.length("term") >= TX.MIN_TERM_LENGTH)
    # distinct terms first, so that each meets the name (and is stemmed) once
    t = (t.groupBy("filename", "name", "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_no", "pos")).alias("first"))
         .withColumn("_nw", TX.name_words(F.col("name"))))
    t = t.where(~TX.related_to_name(F.col("term"), F.col("_nw")))
    agg = (t.groupBy("filename", "term")
           .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
           .where(F.col("n") > 1))
    # Ranking inside one file's distinct terms: a file's vocabulary is small.
    from pyspark.sql import Window
    w = Window.partitionBy("filename").orderBy(F.desc("n"), F.col("first.row_no"), F.col("first.pos"))
    return agg.select("filename", "term", "n", F.col("first.row_no").alias("first_row"),
                      F.col("first.pos").alias("first_pos"), F.row_number().over(w).alias("rank"))


# K6 -----------------------------------------------------------------------------
def non_differentiating_terms(tc: DataFrame, cutoff: float = TX.NOT_DIFFERENTIATING_CUTOFF) -> DataFrame:
    """Adds ``frequent`` (share of all counts >= cutoff) and ``excluded``:
    the terms that are shorter forms of a frequent one.  (Frequent terms
    themselves stay in play, as in the table model.)"""
    tc = cut_lineage(tc)  # read for the sum, the frequent terms and their shorter forms
    tot = tc.groupBy("filename").agg(F.sum("n").alias("total"))
    t = tc.join(tot, "filename").withColumn("frequent", F.col("n") / F.col("total") >= F.lit(cutoff))
    fr = t.where("frequent").select("filename", F.col("term").alias("fterm"))
    contained = (t.select("filename", "term").join(fr, "filename")
                 .where((F.col("fterm") != F.col("term")) & F.contains(F.col("fterm"), F.col("term")))
                 .select("filename", "term").distinct().withColumn("excluded", F.lit(True)))
    return (t.join(contained, ["filename", "term"], "left")
            .withColumn("excluded", F.coalesce("excluded", F.lit(False))).drop("total"))


# K7 -----------------------------------------------------------------------------
def file_category(cl: DataFrame, name=None) -> DataFrame:
    """``(filename, file_category)``: the top remaining term when it occurs
    at least once per row of the file, else ''.  (This rule looks at the
    whole file, rows marked ``case_incl = N`` included.)"""
    cl = _with_name(cl, name) if name is not None else cl
    rows = cl.groupBy("filename").agg(F.count(F.lit(1)).alias("rows"))
    tc = non_differentiating_terms(term_counts(cl, only_included=False)).where(~F.col("excluded"))
    top = tc.groupBy("filename").agg(F.min_by(F.struct("term", "n"), "rank").alias("top"))
    j = rows.join(top, "filename", "left")
    return j.select("filename", F.when(F.col("top.n") >= F.col("rows"), F.col("top.term"))
                    .otherwise(F.lit("")).alias("file_category"))


# K8 / K9 ------------------------------------------------------------------------
def _word_term_matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact match relation between description words and candidate terms of
    the same file: similar (bigram Dice >= 0.8) or contained either way.

    Every such pair shares a bigram (or, for one-letter words, a letter), so
    the pairs are found by an equi-join on ``(filename, gram)`` — a blocking
    join, not all word x term pairs — and then verified with bigram
    multisets computed once per word and once per term."""
    def prep(df, col):
        df = df.withColumn("_nb", TX.numbered_bigrams(F.col(col)))
        return df.withColumn("_grams", F.when(F.length(col) >= 2, F.array_distinct(
            F.transform(F.col("_nb"), lambda b: F.substring_index(b, "#", 1)))).otherwise(F.split(F.col(col), "")))

    w = prep(words, "sw").select("filename", "sw", F.col("_nb").alias("wb"), "_grams")
    t = prep(terms, "term").select("filename", "term", F.col("_nb").alias("tb"), "_grams")
    wg = w.select("filename", "sw", F.explode("_grams").alias("gram"))
    tg = t.select("filename", "term", F.explode("_grams").alias("gram"))
    cand = wg.join(tg, ["filename", "gram"]).select("filename", "sw", "term").distinct()
    pairs = cand.join(w.drop("_grams"), ["filename", "sw"]).join(t.drop("_grams"), ["filename", "term"])
    inter = F.size(F.array_intersect("wb", "tb"))
    dice = (F.when(F.col("sw") == F.col("term"), F.lit(1.0))
            .when((F.length("sw") < 2) | (F.length("term") < 2), F.lit(0.0))
            .otherwise(2.0 * inter / (F.length("sw") + F.length("term") - 2)))
    ok = (dice >= F.lit(TX.SIMILARITY_MATCH)) | F.contains(F.col("term"), F.col("sw")) | F.contains(F.col("sw"), F.col("term"))
    return pairs.where(ok).select("filename", "sw", "term")


def categorise(cl: DataFrame, name=None) -> DataFrame:
    """``(filename, row_no, code, category_key, system_group)`` for every
    included row that gets a category:

    * with a description and common terms in its file: the rarest common
      term one of its words matches, else a key term of the description
      (a one-word description itself, else the phenotype name);
    * with a description, one-row file without common terms: the
      description, with the words of the name capitalised;
    * with a description otherwise: the phenotype name;
    * without a description: its ``category`` / ``calibercategory`` column,
      else ``"Use of " + drugsubstance`` for product codes.
    """
    cl = _with_name(cl, name) if name is not None else cl
    cl = cl.withColumn("name", plain_name(F.col("name")))
    # The prepared rows and the candidate terms feed several branches below;
    # each is materialised once (reliable checkpoint) instead of re-derived.
    inc = cut_lineage(with_description(included(cl)).withColumn("code", code_expr(F.col("attrs"))))
    grp = coding_system_group(inc)
    nrows = inc.groupBy("filename").agg(F.count(F.lit(1)).alias("rows"))
    tc = cut_lineage(non_differentiating_terms(term_counts(inc)).where(~F.col("excluded")).select("filename", "term", "rank"))
    has_terms = tc.select("filename").distinct().withColumn("has_terms", F.lit(True))

    described = inc.where(F.col("description").isNotNull() & (F.col("description") != ""))
    words = (described.select("filename", "row_no", F.explode(F.split("description", " ")).alias("w"))
             .withColumn("_c", TX.full_clean(F.col("w")))
             .select("filename", "row_no", TX.singular(F.col("_c")).alias("sw"))
             .where(F.col("sw") != ""))
    matches = _word_term_matches(words.select("filename", "sw").distinct(), tc.select("filename", "term"))
    # rarest first = greatest rank
    best = (words.join(matches, ["filename", "sw"]).join(tc, ["filename", "term"])
            .groupBy("filename", "row_no").agg(F.max_by("term", "rank").alias("matched")))

    d = (described.join(best, ["filename", "row_no"], "left").join(maybe_broadcast(has_terms), "filename", "left")
         .join(maybe_broadcast(nrows), "filename"))
    # files are few and rows many: what takes time runs in tasks of so many rows, not of so many files
    # (checkpointed, so that filters on the key are not pushed below the dealing)
    d = cut_lineage(d.drop("attrs").repartition(tasks_for(inc), "filename", "row_no"))
    d = (d.withColumn("_parts", TX.split_terms(F.col("description")))
         .withColumn("_nw", TX.name_words(F.col("name")))
         .withColumn("_lname", F.split(F.lower(F.col("name")), " ")))
    parts, nw = F.col("_parts"), F.col("_nw")
    unrelated = F.exists(parts, lambda t: ~TX.related_to_name(F.lower(t), nw))
    key_term = (F.when(F.size(parts) == 1, F.col("description"))
                .when(unrelated, F.col("name"))
                .otherwise(_at(F.filter(parts, lambda t: ~TX.ignored(TX.clean_word(t))), 1)))
    capitalised = F.array_join(F.transform(F.split(F.col("description"), " "), lambda w: F.when(
        F.exists(F.col("_lname"), lambda n: F.contains(n, F.lower(w))) & (w != ""),
        F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)), " ")
    d = d.select("filename", "row_no", "code", F.when(F.col("has_terms"), F.coalesce(F.col("matched"), key_term))
                 .when(F.col("rows") == 1, capitalised).otherwise(F.col("name")).alias("category_key"))
    other = inc.where(F.col("description").isNull() | (F.col("description") == ""))
    cat_col = F.coalesce(F.nullif(F.col("attrs")["category"], F.lit("")),
                         F.nullif(F.col("attrs")["calibercategory"], F.lit("")))
    prod = F.nullif(F.col("attrs")["prodcode"], F.lit(""))
    o = other.select("filename", "row_no",
                     F.when(cat_col.isNotNull(), F.col("code")).otherwise(prod).alias("code"),
                     F.when(cat_col.isNotNull(), cat_col)
                     .when(prod.isNotNull(), F.concat(F.lit("Use of "), F.coalesce(F.col("attrs")["drugsubstance"], F.lit("undefined"))))
                     .alias("category_key")).where(F.col("category_key").isNotNull())
    named = d.unionByName(o).where(F.col("code").isNotNull() & F.col("category_key").isNotNull())
    return named.join(maybe_broadcast(grp), "filename", "left")


def rejections(cl: DataFrame, name=None) -> DataFrame:
    """``(filename, row_no, reason)``: included rows that :func:`categorise`
    leaves out, for want of a code (``no code``) or of a category (``no
    category``); and, with a null ``row_no``, files without any category."""
    inc = included(cl).withColumn("code", code_expr(F.col("attrs"))).select("filename", "row_no", "code")
    named = cut_lineage(categorise(cl, name).select("filename", "row_no").distinct())
    rows = inc.join(named, ["filename", "row_no"], "left_anti").select(
        "filename", "row_no", F.when(F.col("code").isNull(), "no code").otherwise("no category").alias("reason"))
    files = cl.select("filename").distinct().join(named.select("filename").distinct(), "filename", "left_anti")
    return rows.unionByName(files.select("filename", F.lit(None).cast(dict(cl.dtypes)["row_no"]).alias("row_no"),
                                         F.lit("no category").alias("reason")))


# K10 ----------------------------------------------------------------------------
def _replace_first(text: Column, find: Column, by: Column) -> Column:
    at = F.position(find, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), by, F.substr(text, at + F.length(find)))).otherwise(text)


def plain_name(name: Column) -> Column:
    """The name without its first opening and first closing bracket."""
    return F.regexp_replace(F.regexp_replace(name, r"^([^(]*)\(", "$1"), r"^([^)]*)\)", "$1")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a one-element array holds it.
    (Named columns would be inlined wherever they are used, again and again.)"""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def label_expr(key: Column, group: Column, name: Column) -> Column:
    """``<key>[ <name>] - <group>``: the name is appended unless one contains
    the other; a two-word key ending in the name puts the name first; the
    first letter is capitalised; a key equal to the name stays as it is.

    A name of several words counts as its last telling word while the key is
    ordered ("asthma Type diabetes" -> "Type diabetes asthma"); such keys are
    in lower case but for the name."""
    def with_name(name: Column) -> Column:
        fk, fn = TX.full_clean(key), TX.full_clean(name)
        appended = F.when(F.contains(fk, fn) | F.contains(fn, fk), key).otherwise(F.concat(key, F.lit(" "), name))
        telling = F.filter(F.split(name, " "), lambda w: ~TX.ignored(TX.clean_word(w)))
        short_of = lambda x: F.when((F.size(F.split(name, " ")) > 1) & (x != name) & F.contains(x, name), F.try_element_at(telling, F.lit(-1)))
        return F.when(key == name, key).otherwise(_let(appended, lambda x: _let(short_of(x), lambda short: told(name, x, short))))

    def told(name: Column, appended: Column, short: Column) -> Column:
        ordered = F.when(short.isNotNull(), _replace_first(appended, name, short)).otherwise(appended)
        full_of = lambda x: F.when(short.isNotNull(), _replace_first(F.lower(x), F.lower(short), name)).otherwise(x)
        capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
        return _let(_let(_let(ordered, lambda x: swapped(name, x, short)), full_of), capital)

    def swapped(name: Column, ordered: Column, short: Column) -> Column:
        ws = F.split(ordered, " ")
        first, second = F.lower(_at(ws, 1)), F.lower(_at(ws, 2))
        turns = (second == F.lower(F.coalesce(short, name))) | F.coalesce(first == F.lower(short), F.lit(False))
        return F.when((F.size(ws) == 2) & turns & ~first.rlike(TX.ADJECTIVE_SUFFIX), F.concat(second, F.lit(" "), first)).otherwise(ordered)

    return F.concat(_let(plain_name(name), with_name), F.lit(" - "), group)


def label_categories(cats: DataFrame, name=None) -> DataFrame:
    cats = _with_name(cats, name) if name is not None else cats
    return cats.withColumn("category", label_expr(F.col("category_key"), F.col("system_group"), F.col("name")))


def categories(cl: DataFrame, name=None) -> DataFrame:
    """K8 + K10 in one plan: ``(category, filename, row_no, code)`` (long:
    a category is never collected into one row)."""
    cl = _with_name(cl, name) if name is not None else cl
    names = cl.select("filename", "name").distinct()
    # the key's long expression is used many times in the label: computed once, not inlined
    cats = cut_lineage(categorise(cl)).join(maybe_broadcast(names), "filename")
    return label_categories(cats).select("category", "filename", "row_no", "code")


# K12 ----------------------------------------------------------------------------
def dedupe_files(cl: DataFrame, upload_col: str = "upload_seq") -> DataFrame:
    """Same file name uploaded twice: the last upload wins."""
    last = cl.groupBy("filename").agg(F.max(upload_col).alias("_last"))
    return cl.join(last, "filename").where(F.col(upload_col) == F.col("_last")).drop("_last")


# K13 / K14 ------------------------------------------------------------------------
def row_text(attrs: Column | None = None) -> Column:
    attrs = F.col("attrs") if attrs is None else attrs
    ent = F.array_sort(F.map_entries(attrs))
    return F.array_join(F.transform(ent, lambda e: F.concat_ws("=", _escaped(e["key"]), _escaped(F.coalesce(e["value"], F.lit(""))))), "|")


def _escaped(c: Column) -> Column:
    """Text whose ``=`` and ``|`` can't be taken for the separators of a row."""
    for mark in ("\\", "=", "|"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def _digest_sum(c: Column) -> Column:
    """Order-free identity of a set of rows: the whole SHA-1 of each, in three
    parts of 14, 14 and 12 hex digits, each summed."""
    parts = [F.sum(F.conv(F.substring(F.sha1(c), at, size), 16, 10).cast("decimal(38,0)")).cast("string")
             for at, size in ((1, 14), (15, 14), (29, 12))]
    return F.concat_ws("-", *parts)


def fingerprint(cl: DataFrame, keys=("filename",)) -> DataFrame:
    """Content identity of each file: the sum over rows of a SHA-1 of
    ``row_no`` and the row's sorted ``key=value`` text.  A sum is an algebraic
    aggregate, so a file is fingerprinted without gathering its rows."""
    text = F.concat_ws("#", F.col("row_no").cast("string"), row_text())
    return cl.groupBy(*keys).agg(_digest_sum(text).alias("fingerprint"))


def steplist_fingerprint(steplists: DataFrame, file_prints: DataFrame) -> DataFrame:
    """``steplists(filename, seq, logicType, param)`` -> ``(filename,
    fingerprint, problem)``: the identity of the set of files the steplist
    names (both files of a temporal row), a branch standing for its nested
    steplist.  Nesting of any depth is resolved level by level until nothing
    is added.  A steplist without files has the fingerprint ``empty``; one that
    names a file nobody holds, or that contains itself, has none and says so
    in ``problem`` (``unknown file`` or ``cycle``), as do those that name it."""
    part = F.split("param", ":")
    files = F.when(F.col("logicType").isin("codelist", "codelistExclude"), F.array(part[0])) \
        .when(F.col("logicType") == "codelistsTemporal", F.array(part[0], F.try_element_at(part, F.lit(2)))) \
        .when(F.col("logicType") == "branch", F.array("param"))
    nested = F.col("logicType") == "branch"
    refs = cut_lineage(steplists.select("filename", nested.alias("nested"), F.explode(files).alias("ref")).distinct())
    names = steplists.select("filename").distinct()
    held = file_prints.select(F.lit(False).alias("nested"), F.col("filename").alias("ref"), F.col("fingerprint").alias("print"))
    empty = names.join(refs, "filename", "left_anti").select("filename", F.lit("empty").alias("fingerprint"))
    done, n_done = cut_lineage(empty), -1
    while (n := done.count()) > n_done:
        n_done = n
        known = held.unionByName(done.select(F.lit(True).alias("nested"), F.col("filename").alias("ref"), F.col("fingerprint").alias("print")))
        open_refs = refs.join(done, "filename", "left_anti").join(known, ["nested", "ref"], "left")
        text = F.concat_ws("#", F.col("nested").cast("string"), F.col("print"))
        new = (open_refs.groupBy("filename").agg(_digest_sum(text).alias("fingerprint"), F.bool_and(F.col("print").isNotNull()).alias("all"))
               .where("all").select("filename", "fingerprint"))
        done = cut_lineage(done.unionByName(new))
    # what is left names an unknown file, directly or below, or only itself
    rest = refs.join(done, "filename", "left_anti")
    lost = (rest.where(~F.col("nested")).join(held, ["nested", "ref"], "left_anti").select("filename")
            .unionByName(rest.where("nested").join(names.withColumnRenamed("filename", "ref"), "ref", "left_anti").select("filename")))
    lost, n_lost = cut_lineage(lost.distinct()), -1
    while (n := lost.count()) > n_lost:
        n_lost = n
        above = rest.where("nested").join(lost.withColumnRenamed("filename", "ref"), "ref").select("filename")
        lost = cut_lineage(lost.unionByName(above).distinct())
    return (names.join(done, "filename", "left").join(lost.withColumn("lost", F.lit(True)), "filename", "left")
            .select("filename", "fingerprint", F.when(F.col("fingerprint").isNotNull(), F.lit(None).cast("string"))
                    .when(F.col("lost"), F.lit("unknown file")).otherwise(F.lit("cycle")).alias("problem")))


# K18 ----------------------------------------------------------------------------
def distinct_step_names(steps: DataFrame) -> DataFrame:
    """``steps(definition, position, name, file_category)``: a name shared by
    two steps of one definition gets the file category appended; still
    shared -> ``rejected``."""
    c1 = steps.groupBy("definition", "name").agg(F.count(F.lit(1)).alias("_n"))
    s = steps.join(c1, ["definition", "name"])
    s = s.withColumn("step_name", F.when((F.col("_n") > 1) & (F.coalesce(F.col("file_category"), F.lit("")) != ""),
                                         F.concat(F.col("name"), F.lit("-"), F.col("file_category"))).otherwise(F.col("name")))
    c2 = s.groupBy("definition", "step_name").agg(F.count(F.lit(1)).alias("_m"))
    return (s.join(c2, ["definition", "step_name"]).withColumn("rejected", F.col("_m") > 1)
            .select("definition", "position", "name", "step_name", "rejected"))


# K19 ----------------------------------------------------------------------------
def group_definitions(meta: DataFrame) -> DataFrame:
    """``meta(name, title, filename)``: definitions with equal name and title
    are imported together -> ``(name, title, files)`` (sorted, distinct)."""
    return meta.groupBy("name", "title").agg(F.sort_array(F.collect_set("filename")).alias("files"))


def group_codelists(meta: DataFrame, cl: DataFrame) -> DataFrame:
    """The codelists of each group of ``meta(name, title, filename)`` as one virtual
    file -> ``(filename, name, title, row_no, source, source_row, attrs)``.

    ``filename`` is the group's identity (its name and title as JSON).  Rows follow
    each other file by file, files by name: a row's number is its own plus those of
    the files before it, a running sum over files, so it is the same in every run and
    no file is gathered.  A file in several groups belongs to each; one named twice in
    a group counts once; files that nobody holds add nothing."""
    files = meta.select(F.to_json(F.array("name", "title")).alias("grp"), "name", "title", F.col("filename").alias("source")).distinct()
    sizes = cl.groupBy(F.col("filename").alias("source")).agg((F.max("row_no") + 1).cast("bigint").alias("size"))
    before = Window.partitionBy("grp").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(files.join(sizes, "source").withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))))
    return cl.select(F.col("filename").alias("source"), F.col("row_no").cast("bigint").alias("source_row"), "attrs").join(placed, "source").select(
        F.col("grp").alias("filename"), "name", "title", (F.col("offset") + F.col("source_row")).alias("row_no"), "source", "source_row", "attrs")


def group_categories(meta: DataFrame, cl: DataFrame) -> DataFrame:
    """The import of each group: K8 and K10 over its virtual file, with the group's
    name as phenotype -> ``(name, title, category, source, source_row, code)``."""
    rows = spread(cut_lineage(group_codelists(meta, clean_headers(cl))), "filename", "row_no")
    found = categories(rows.select("filename", "name", "row_no", "attrs"))
    return found.join(rows.select("filename", "name", "title", "row_no", "source", "source_row"), ["filename", "row_no"]) \
        .select("name", "title", "category", "source", "source_row", "code")
