"""Line deduplication by content-defined chunks, in DataFrame functions only.

A document's lines are hashed.  A rolling hash runs over ``window`` line hashes;
a chunk ends behind a line where the rolling hash is 0 modulo ``divisor``, and at
the document's end.  A boundary depends on the lines around it alone, so a
passage that was moved or has text before it is cut the same way inside.

A chunk of at least ``least_lines`` lines whose bytes occur more than once, in
any documents, is kept where it occurs first (smallest ``doc_id``, then place)
and removed elsewhere.  Chunks meet by their bytes: the text itself is the
grouping key beside its hash, each task merges its own copies first, and one row
a distinct text is left however often it occurs.  Only places and hashes go back
to the documents; where two texts share a hash the text decides.

Defined cases: a null text has no lines and stays null; an empty one is one empty
line; lines end at ``\\n`` and the last needs none; rows that share ``doc_id`` and
text are one document (all get the same text); a null ``doc_id`` comes after all
others; columns beyond ``doc_id`` and ``text`` come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A character of a word (phenospark.llm.common.WORD, before lower-casing).
A_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"


def line_hash(line: Column) -> Column:
    """First 32 bits of the line's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.encode(line, "UTF-8")), 1, 8), 16, 10).cast("long")


def chunk_places(text: Column, window: int, divisor: int) -> Column:
    """Array of (start, end) line numbers, end exclusive, of the text's chunks."""
    hashes = F.transform(F.split(text, "\n", -1), line_hash)

    def ends(hashes: Column) -> Column:
        rolled = lambda i: sum((F.try_element_at(hashes, (i - k + 1).cast("int")) * (31 ** k) for k in range(1, window)),
                               F.element_at(hashes, (i + 1).cast("int")))
        return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1),
                        lambda i: (i == F.size(hashes) - 1) | ((i >= window - 1) & (F.pmod(rolled(i), F.lit(divisor)) == 0)))

    # one-element arrays hold a value that is used more than once
    cut = F.element_at(F.transform(F.array(hashes), ends), 1)
    return F.element_at(F.transform(F.array(cut), lambda e: F.transform(
        e, lambda x, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(k, F.lit(1)).cast("int")) + 1).alias("start"),
                                 (x + 1).alias("end")))), 1)


def _document_key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b")]


def chunks(docs: DataFrame, window: int, divisor: int, least_lines: int, worded: bool) -> DataFrame:
    """A row a chunk of at least ``least_lines`` lines (``worded``: lines with words)."""
    lines = docs.filter(F.col("text").isNotNull()).select(*_document_key(), F.split("text", "\n", -1).alias("lines"),
                                                         F.explode(chunk_places(F.col("text"), window, divisor)).alias("c"))
    own = F.slice("lines", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    counted = F.size(F.filter(own, lambda x: x.rlike(A_WORD))) if worded else F.col("c.end") - F.col("c.start")
    return lines.filter(counted >= least_lines).select("key_id", "key_a", "key_b", F.col("c.start").alias("start"), F.col("c.end").alias("end"),
                                                       F.array_join(own, "\n").alias("chunk"))


def removals(docs: DataFrame, window: int, divisor: int, least_lines: int, worded: bool) -> DataFrame:
    """Per document with any: ``gone``, the (start, end) lines that go, in order."""
    found = chunks(docs, window, divisor, least_lines, worded).withColumns(
        {"h": F.xxhash64("chunk"), "h2": F.xxhash64(F.lit(1), "chunk")})
    place = F.struct(F.col("key_id").isNull().alias("no_id"), "key_id", "key_a", "key_b", "start")
    # byte comparison: the chunk itself is a key; repeated rows of a document are one occurrence
    texts = found.groupBy("h", "h2", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # two texts that share both hashes would be told apart by nothing below: they are left alone
    verdicts = texts.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("last").alias("last")) \
        .filter((F.col("texts") == 1) & (F.col("first") != F.col("last"))).select("h", "h2", "first")
    later = found.select("h", "h2", place.alias("place"), "end").join(verdicts, ["h", "h2"]).filter(F.col("place") != F.col("first"))
    return later.groupBy("place.key_id", "place.key_a", "place.key_b") \
        .agg(F.array_sort(F.collect_list(F.struct("place.start", "end"))).alias("gone"))


def without_repeated_chunks(docs: DataFrame, window: int = 2, divisor: int = 3, least_lines: int = 2, worded: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks removed from ``text``, and ``chunks_removed``.
    ``worded``: only lines with a word count towards ``least_lines``, so that blank lines alone are no chunk."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("string").alias("text"), "doc_id") \
        .select("doc", "text", *_document_key())
    gone = removals(docs, window, divisor, least_lines, worded).alias("g")
    same = F.col("d.key_id").eqNullSafe(F.col("g.key_id")) & (F.col("d.key_a") == F.col("g.key_a")) & (F.col("d.key_b") == F.col("g.key_b"))
    lines = F.split("text", "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.col("gone.end"))
    stops = F.concat(F.col("gone.start"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a)))
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return keyed.alias("d").join(gone, same, "left").select(
        *[new.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns],
        F.coalesce(F.size("gone"), F.lit(0)).alias("chunks_removed"))


def later_pairs(docs: DataFrame) -> DataFrame:
    """Per document with any: ``gone``, in order, the (first, last) line numbers of two
    lines with words that follow each other at an earlier place too (smallest
    ``doc_id``, then place).  Lines without a word between them belong to the pair, but
    make none of their own: a paragraph break is no passage."""
    lines = docs.filter(F.col("text").isNotNull()).select(*_document_key(), F.split("text", "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    worded = lines.select("key_id", "key_a", "key_b", F.filter(numbered, lambda x: x["line"].rlike(A_WORD)).alias("w")).filter(F.size("w") > 1)
    digest = lambda a, b: F.unhex(F.sha2(F.concat(a, F.lit("\n"), b).cast("binary"), 256))
    pair = lambda a, b: F.struct(a["at"].alias("start"), b["at"].alias("stop"), digest(a["line"], b["line"]).alias("h"))
    count = F.size("w") - 1
    pairs = worded.select("key_id", "key_a", "key_b", F.explode(F.zip_with(F.slice("w", 1, count), F.slice("w", 2, count), pair)).alias("p"))
    found = pairs.select("p.h", F.struct(F.col("key_id").isNull().alias("no_id"), "key_id", "key_a", "key_b", "p.start", "p.stop").alias("place"))
    firsts = found.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last")) \
        .filter(F.col("first") != F.col("last")).select("h", "first")
    # of equal lines in a row the second pair shares a line with the first: that line is the first's
    own = F.col("place").dropFields("start", "stop") == F.col("first").dropFields("start", "stop")
    beside = F.coalesce(own, F.lit(False)) & (F.col("place.start") == F.col("first.stop"))
    later = found.join(firsts, "h").filter((F.col("place") != F.col("first")) & ~beside)
    return later.groupBy("place.key_id", "place.key_a", "place.key_b") \
        .agg(F.array_sort(F.collect_list(F.struct("place.start", "place.stop"))).alias("gone"))


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of passages of two lines or more that occur at an
    earlier place, wherever chunks would end.  Every distinct line stays where it
    occurs first, and lines without words stay outside passages.  Defined cases as
    for chunks."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("string").alias("text"), "doc_id") \
        .select("doc", "text", *_document_key())
    gone = later_pairs(keyed.select(F.col("key_id").alias("doc_id"), "text")).alias("g")
    same = F.col("d.key_id").eqNullSafe(F.col("g.key_id")) & (F.col("d.key_a") == F.col("g.key_a")) & (F.col("d.key_b") == F.col("g.key_b"))

    def kept(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x["stop"] + 1))
        stops = F.concat(F.transform("gone", lambda x: x["start"]), F.array(F.size(lines)))
        return F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))

    # a one-element array holds the lines, which are used more than once
    rest = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), kept), 1)
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return keyed.alias("d").join(gone, same, "left").select(
        *[new.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
