"""Keyword patterns as a table: which pattern hits which text, for lists of any length.

Running every pattern over every text costs texts x patterns.  Instead each pattern
gives an *anchor*: a run of characters (up to eight) that every match must contain.
Texts are probed with the anchors, and only (text, pattern) pairs that share one can
run the regular expression, so the result is that of ``keywords`` (C5).

* A pair's text must hold the pattern's longest certain literal whole, which is a plain
  search; what is left runs the regular expression.
* Literals come from the pattern's own text, by column expressions.  Whatever may be
  absent from a match is dropped: classes, groups, escapes, and characters before
  ``*``, ``?`` or ``{``; a class of one character and a group of plain ones are what they
  hold.  Alternatives at the top are rows of their own.  A pattern without any certain
  literal has an empty anchor, which every text holds.
* Of a pattern's grams the one that the fewest patterns share is its anchor.
* A pattern that is nothing but up to ``PHRASE`` plain words between ``(?<![^ ])`` and ``(?![^ ])``
  is found by looking up the texts' runs of words alone: they are equal or there is no match.
* What a match of a short pattern without repeats looks at is no longer than the pattern.
  Such patterns meet pieces of the texts, each with so many characters more on both sides,
  and a piece counts the matches that start in its own part; other patterns meet whole texts.
* Matching is case-insensitive (Unicode): anchors are ASCII, and the four other letters
  that fold to ASCII ones are folded in the texts.
* The index is broadcast below a checked size; beyond it texts and patterns meet by
  ids in shuffle joins, whose skewed keys (a frequent anchor) AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions.cells import q
from phenospark.operators.criteria import CASE, IDENTIFIED, UNK
from phenospark.session import cut_lineage

#: Lengths of anchors: a pattern has the longest of them that its literals allow.
GRAMS = (1, 2, 3, 5, 8)
#: Largest index (bytes of patterns and anchors) that is broadcast.
BROADCAST_BYTES = 128 << 20
#: Characters of a text's piece, and the longest pattern that is matched by pieces (no longer than a piece).
PIECE, REACH = 512, 64
#: Words of the longest pattern that is looked up by whole words, and the form of such patterns: plain
#: characters, classes of one and groups of them, as a word or words between spaces.
PHRASE = 4
LONE = r"^\(\?<!\[\^ \]\)(?:[A-Za-z0-9 ]|\[[A-Za-z0-9 ]\]|\((?:\?:)?[A-Za-z0-9 ]+\))+\(\?!\[\^ \]\)\z"
#: Letters outside ASCII that match an ASCII letter when case is ignored, and those letters.
FOLDED = ("ſKıİ", "skii")
_GAP = "\x00"


def _lower(text: Column) -> Column:
    """Lower case, as the regular expression folds ASCII letters."""
    return F.lower(F.translate(text, *FOLDED))


def _fold(text: Column) -> Column:
    """What literals are looked for in: lower case, a space before and after."""
    return F.concat(F.lit(" "), _lower(text), F.lit(" "))


def _alternatives(pattern: Column) -> Column:
    """Top-level alternatives; a pattern with groups, classes or escapes is one."""
    return F.when(pattern.rlike(r"[(\[\\]"), F.array(pattern)).otherwise(F.split(pattern, r"\|"))


def certain_literals(pattern: Column) -> Column:
    """Runs of ASCII characters that every match of a pattern contains (lower case), with the
    space or the text's end (see ``_fold``) that ``(?<![^ ])`` and ``(?![^ ])`` ask for around it.
    Dropping one too many is safe: it only makes the anchor less telling."""
    p = pattern
    # quoting, in-pattern flags and alternatives inside groups change how the rest reads: nothing is certain then
    unsafe = p.rlike(r"\\[QE]") | p.rlike(r"\(\?[a-zA-Z-]+[:)]")
    p = F.regexp_replace(p, r"(?s)\\(?:[xupP]\{[^}]*\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[pP].|c.|0[0-7]{1,3}|k<[^>]*>|.)", _GAP)
    # looks for the end of a word between spaces: texts are searched with a space before and after them
    p = F.regexp_replace(F.regexp_replace(p, r"^\(\?<!\[\^ \]\)", " "), r"\(\?!\[\^ \]\)\z", " ")
    p = F.regexp_replace(p, r"\[([A-Za-z0-9 ])\]", "$1")
    p = F.regexp_replace(p, r"\[\^?\]?[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]", _GAP)
    p = F.regexp_replace(p, r"\((?:\?:)?([A-Za-z0-9 ]+)\)(?![*+?{])", "$1")
    for _ in range(4):  # groups from the innermost out, with what repeats them
        p = F.regexp_replace(p, r"\([^()]*\)(?:[*+?]|\{[^}]*\})*", _GAP)
    p = F.when(p.rlike(r"[()\[\]|]"), F.lit("")).otherwise(p)  # what is left is nested too deep, or alternatives
    p = F.regexp_replace(p, r"(?s).(?:[*?]|\{[^}]*\})[*+?]*", _GAP)
    p = F.regexp_replace(p, r"[+^$.*?{}]", _GAP)
    return F.when(unsafe, F.array().cast("array<string>")).otherwise(
        F.filter(F.split(F.regexp_replace(F.lower(p), "[^ -~]", _GAP), _GAP), lambda x: x != ""))


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` ASCII characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?=([ -~]{%d}))" % size), F.lit(1)))


def _short(pattern: Column) -> Column:
    """Whether all that a match looks at lies within ``REACH`` characters of its start: plain
    characters, classes of them, groups and looks around, none of them repeated."""
    return (F.length(pattern) <= REACH) & pattern.rlike(r"^(?:[A-Za-z0-9 |)]|\[\^?[A-Za-z0-9 ]+\]|\((?!\?)|\(\?(?:[:=!]|<[=!]))*$")


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """``patterns(pattern_id, pattern)`` -> ``(pattern_id, alternative, pattern, short, literal, grams)``:
    the longest certain literal of each alternative, and all literals' grams, of the longest of
    ``GRAMS`` that they allow; '' if it has none."""
    parts = patterns.select("pattern_id", F.posexplode(_alternatives(F.col("pattern"))).alias("alternative", "pattern"))
    runs = parts.withColumn("runs", certain_literals(F.col("pattern")))
    longest = F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0))
    grams = F.array(F.lit(""))
    of = lambda n: lambda run: _grams(run, n)
    for n in GRAMS:
        grams = F.when(longest >= n, F.array_distinct(F.flatten(F.transform("runs", of(n))))).otherwise(grams)
    literal = F.coalesce(F.array_max(F.transform("runs", lambda run: F.struct(F.length(run), run.alias("run"))))["run"], F.lit(""))
    return runs.select("pattern_id", "alternative", "pattern", _short(F.col("pattern")).alias("short"), literal.alias("literal"), grams.alias("grams"))


def text_grams(texts: DataFrame, sizes: Sequence[int], *keep: str) -> DataFrame:
    """Rows of ``texts`` once for each distinct gram (of ``sizes``) of ``folded``."""
    every = [F.array(F.lit("")) if n == 0 else _grams(F.col("folded"), n) for n in sizes]
    return texts.select(*keep, F.explode(F.flatten(F.array(*every))).alias("gram"))


def anchored(patterns: DataFrame) -> DataFrame:
    """``(pattern_id, pattern, short, literal, gram)``, a row an alternative: its gram that the
    fewest alternatives share (ties: the first in order)."""
    parts = cut_lineage(pattern_grams(patterns))
    # patterns meet their grams by their own text alone
    grams = parts.select("pattern", "grams").distinct().select("pattern", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = grams.join(shared, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("x"))
    return cut_lineage(parts.join(best, "pattern").select("pattern_id", "pattern", "short", "literal", F.col("x.gram").alias("gram")))


def _pieces(texts: DataFrame) -> DataFrame:
    """``(key, text, from)``: pieces of ``PIECE`` characters with ``REACH`` more on both sides; ``from``
    of them come before the piece's own first character (the place after the last is a piece's own too)."""
    last = F.floor(F.length("text") / PIECE).cast("int")
    cut = texts.select("key", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.lit(REACH))
    return cut.select("key", F.substring("text", F.col("i") * PIECE - start + 1, start + PIECE + REACH).alias("text"), start.alias("from"))


def _small(df: DataFrame, size: Column) -> bool:
    total = df.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return (total["b"] or 0) + 64 * total["n"] <= BROADCAST_BYTES


def _bounded(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast only below ``BROADCAST_BYTES``."""
    return F.broadcast(df) if _small(df, size) else df


def _hit(pieces: bool) -> Column:
    """Whether the text holds the literal and the pattern; in a piece, the pattern from one of its own characters on.
    No lambda functions: they would keep the join from being compiled, which copies the text for each gram."""
    literal = F.contains(F.col("folded"), F.col("literal"))
    own = F.concat(F.lit("^(?s:.{"), F.col("from"), F.lit(","), F.col("from") + (PIECE - 1), F.lit("}?)(?:"), F.col("pattern"), F.lit(")"))
    return literal & F.regexp_like(F.col("text"), F.concat(F.lit("(?iu)"), own if pieces else F.col("pattern")))


def _meet(texts: DataFrame, index: DataFrame, sizes: Sequence[int], small: bool, pieces: bool) -> DataFrame:
    """``(key, pattern_id)`` of the texts (or pieces) that a pattern of ``index`` hits."""
    folded = _fold(F.col("text"))
    if small:
        pairs = text_grams(texts.withColumn("folded", folded), sizes, "key", "text", "from", "folded").join(F.broadcast(index), "gram")
        return pairs.where(_hit(pieces)).select("key", "pattern_id")
    # texts travel once, by their digest, to the pairs that are left; only grams that are anchors leave their task
    marked = texts.withColumn("digest", F.unhex(F.md5(F.concat_ws(" ", F.col("from"), F.col("text")))))
    known = index.select(F.xxhash64("gram").alias("h")).distinct()
    grams = text_grams(marked.withColumn("folded", folded), sizes, "digest").withColumn("h", F.xxhash64("gram"))
    grams = grams.join(_bounded(known, F.lit(0)), "h", "left_semi").drop("h").distinct()
    pairs = grams.join(index.select("pattern_id", "gram"), "gram").select("digest", "pattern_id").distinct()
    whole = pairs.join(index.drop("gram"), "pattern_id").join(marked, "digest").withColumn("folded", folded)
    return whole.where(_hit(pieces)).select("key", "pattern_id")


def _words(text: Column) -> Column:
    """What stands between single spaces, empty words too."""
    return F.split(text, " ", -1)


def phrase_of(pattern: Column) -> Column:
    """The words of a pattern that is nothing but whole words (lower case, joined by a space); else null."""
    body = F.regexp_replace(pattern, r"^\(\?<!\[\^ \]\)|\(\?!\[\^ \]\)\z", "")
    phrase = F.lower(F.regexp_replace(body, r"\((?:\?:)?|[)\[\]]", ""))
    return F.when(pattern.rlike(LONE) & (F.size(_words(phrase)) <= PHRASE), phrase)


def _phrases_met(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(key, number)`` of the ``phrases(number, phrase)`` that the texts hold: each text's distinct
    runs of words are looked up, a run of words being a match by itself."""
    lengths = [r["n"] for r in phrases.select(F.size(_words(F.col("phrase"))).alias("n")).distinct().collect()]   # at most ``PHRASE``
    if not lengths:
        return texts.limit(0).select("key", F.lit(None).cast("long").alias("number"))
    words = F.col("words")
    runs, every = words, []
    for n in range(1, max(lengths) + 1):
        if n > 1:   # the last words start no run: null
            runs = F.zip_with(runs, F.slice(words, F.lit(n), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        if n in lengths:
            every.append(F.array_distinct(runs))
    held = texts.select("key", _words(_lower(F.col("text"))).alias("words")).select("key", F.explode(F.concat(*every)).alias("phrase"))
    small = _small(phrases, F.octet_length("phrase"))
    if not small:   # only runs that are phrases travel
        known = _bounded(phrases.select(F.xxhash64("phrase").alias("h")).distinct(), F.lit(0))
        held = held.withColumn("h", F.xxhash64("phrase")).join(known, "h", "left_semi").drop("h")
    return held.join(F.broadcast(phrases) if small else phrases, "phrase").select("key", "number")


def _numbered_hits(texts: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, number)``, rows may repeat, and ``(pattern_id, number)``: hits carry a number in place of
    the id, which may be long."""
    texts = texts.where(F.col("text").isNotNull()).select("key", F.col("text").cast("string").alias("text"))
    patterns = patterns.where(F.col("pattern").isNotNull()).select("pattern_id", "pattern")
    ids = cut_lineage(patterns.select("pattern_id").distinct().withColumn("number", F.monotonically_increasing_id()))
    patterns = cut_lineage(patterns.join(ids, patterns.pattern_id.eqNullSafe(ids.pattern_id)).select(
        F.col("number").alias("pattern_id"), "pattern", phrase_of(F.col("pattern")).alias("phrase")))
    found = _phrases_met(texts, patterns.where(F.col("phrase").isNotNull()).select(F.col("pattern_id").alias("number"), "phrase").distinct())
    index = anchored(patterns.where(F.col("phrase").isNull()))
    small = _small(index, 2 * F.octet_length("pattern") + 64)
    sizes = {}
    for r in index.select("short", F.length("gram").alias("n")).distinct().collect():  # a few lengths
        sizes.setdefault(r["short"], []).append(r["n"])
    for short, lengths in sizes.items():
        some = _pieces(texts) if short else texts.withColumn("from", F.lit(0))
        found = found.unionByName(_meet(some, index.where(F.col("short") == F.lit(short)), sorted(lengths), small, short)
                                  .select("key", F.col("pattern_id").alias("number")))
    return found, ids


def pattern_hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``texts(key, text)`` and ``patterns(pattern_id, pattern)`` -> distinct ``(key,
    pattern_id)`` where the pattern is found in a text of the key.  Null texts and
    patterns hit nothing; an empty pattern hits every text.  An invalid pattern
    fails the query, as a regular expression does."""
    found, ids = _numbered_hits(texts, patterns)
    return found.distinct().join(_bounded(ids, F.octet_length(F.col("pattern_id").cast("string"))), "number").select("key", "pattern_id")


def keyword_matches(df: DataFrame, patterns: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``patterns(category, pattern)``, any number of rows -> distinct ``(key,
    category)``: the rows of ``df`` where a pattern of the category hits a column
    (``cols``; default all).  The long form of C5 for many categories."""
    cells = F.array(*[q(c).cast("string") for c in (df.columns if cols is None else cols)])
    texts = df.select(q(key).alias("key"), F.explode(cells).alias("text"))
    named = cut_lineage(patterns.select("category", "pattern").distinct().withColumn("pattern_id", F.sha2(F.col("pattern"), 256)))
    found, ids = _numbered_hits(texts, named.select("pattern_id", "pattern").distinct())
    # hits become categories in their tasks: a row's hits of one category travel as one
    of = named.join(ids, "pattern_id").select("number", "category")
    return found.join(_bounded(cut_lineage(of), F.octet_length("category") + 64), "number") \
        .select(F.col("key").alias(key), "category").distinct()


def keyword_flags(df: DataFrame, matches: DataFrame, categories: Sequence[str], key: str) -> DataFrame:
    """One ``<category>-identified`` column for each of ``categories`` (they are the
    schema, so they are given); every row of ``df`` stays."""
    flag = lambda c: F.max(F.when(F.col("category") == c, F.lit(CASE))).alias(f"{c}-{IDENTIFIED}")
    if not categories:
        return df
    wide = matches.where(F.col("category").isin(list(categories))).groupBy(key).agg(*map(flag, categories)).withColumnRenamed(key, "_key")
    return df.join(wide, q(key).eqNullSafe(F.col("_key")), "left").select(
        *[q(c) for c in df.columns], *[F.coalesce(q(f"{c}-{IDENTIFIED}"), F.lit(UNK)).alias(f"{c}-{IDENTIFIED}") for c in categories])
