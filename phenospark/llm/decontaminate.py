"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (an item with fewer
words, but not none, is one window).  A document contains a window if the
window's words stand in it in a row; containment is wanted whole, so the prefix
of a window is its one rarest word: a document without that word can't contain
it.

1. Rarity: occurrences of the items' words in all documents, counted.
2. Prefix: the rarest word of each window and its place in the window.
3. Candidates: each occurrence of a prefix word in a document, with the words
   around it, if the places bound leave room for a window there (length and
   position bounds); they are found through a Bloom filter of fixed size, so
   the tasks hold nothing that grows with the benchmark.
4. Join of occurrences and windows on the prefix word; the window must fit
   before the document's end, and its words are compared one by one.

Occurrences of one frequent word are many rows of a join, which Spark splits; no
task sees all of them.  Hit words are the union of the found intervals.

Defined cases: null or wordless texts have no words, hits or windows; null or
repeated item ids are kept (each id counts once in ``n_items``, the null as one
too; ``items`` lists the others); repeated documents are rows of
their own; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.common import WORD, doc_columns, shared_folder, text_key, words_of, written

#: Bits of the Bloom filter (2 MB), whatever the size of the benchmark.
FILTER_BITS = 1 << 24

SCANNED = "doc_id long, key long, n_words long, at array<struct<word:string,place:int,around:array<string>,first:int>>"
WINDOW = "item_id string, words array<string>"


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``item_id`` (as text), ``words``: each distinct window of each item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")),
                                                              "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                                  F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return words.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("i")) \
        .select("item_id", F.slice("w", F.col("i") + 1, size).alias("words")).distinct()


def _filter(words: DataFrame) -> bytes:
    """Bloom filter of fixed size, two bits a word, merged from the partitions' filters."""
    import numpy as np

    def bits(batches) -> Iterator:
        import pyarrow as pa

        mine = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        any_word = False
        for batch in batches:
            for w in batch.column(0).to_pylist():
                any_word = True
                for h in filter_places(w):
                    mine[h >> 3] |= 1 << (h & 7)
        if any_word:
            yield pa.RecordBatch.from_pydict({"bits": [mine.tobytes()]})

    def merge(batches) -> Iterator:
        import pyarrow as pa

        mine = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                mine |= np.frombuffer(b, dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"bits": [mine.tobytes()]})

    parts = words.mapInArrow(bits, "bits binary").coalesce(16).mapInArrow(merge, "bits binary")
    total = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # at most 16 filters of 2 MB
        total |= np.frombuffer(row[0], dtype=np.uint8)
    return total.tobytes()


def filter_places(word: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word.encode())
    return h % FILTER_BITS, (h >> 32) % FILTER_BITS


class _Members:
    """Membership by the filter; words seen are remembered (bounded)."""

    def __init__(self, bits: bytes):
        self.bits, self.seen, self.inside = bits, set(), set()

    def among(self, words: set) -> set:
        """Those of the words that the filter has."""
        if len(self.seen) > 1_000_000:
            self.seen.clear()
            self.inside.clear()
        new = words.difference(self.seen)
        self.inside.update(w for w in new if all(self.bits[h >> 3] >> (h & 7) & 1 for h in filter_places(w)))
        self.seen |= new
        return words & self.inside


def rarity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``word, n``: occurrences in all documents of every word of a window.
    Each task counts its own words before anything is shuffled."""
    spark = docs.sparkSession
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    bits = spark.sparkContext.broadcast(_filter(vocabulary))

    def count(batches) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        members, total, words = _Members(bits.value), Counter(), Counter()

        def settle():
            """Only words of the filter go on; the others are forgotten."""
            for w in members.among(set(words)):
                total[w] += words[w]
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(words_of(text))
                    if len(words) > 300_000:
                        settle()
            if len(total) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})
                total.clear()
        settle()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(total.values(), pa.int64())})

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct window texts with their rarest word and its place: ``word, place, words``."""
    texts = windows.select("words").distinct()
    placed = texts.select("words", F.posexplode("words").alias("place", "word")).join(counts, "word")
    return placed.groupBy("words").agg(F.min(F.struct("n", "word", "place")).alias("x")).select("x.word", "x.place", "words")


def scan_documents(docs: DataFrame, prefix_words: DataFrame, size: int) -> DataFrame:
    """Per document its number of words and the occurrences of prefix words, each
    with the words within ``size - 1`` places around it."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(prefix_words))

    def scan(batches) -> Iterator:
        import pyarrow as pa

        members = _Members(bits.value)
        kind = pa.list_(pa.struct([("word", pa.string()), ("place", pa.int32()), ("around", pa.list_(pa.string())), ("first", pa.int32())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                ids, texts, keys = (c.to_pylist() for c in batch.slice(a, 512).columns)
                counts, at = [], []
                for text in texts:
                    words = words_of(text) if text else []
                    counts.append(len(words))
                    inside = members.among(set(words))
                    at.append([{"word": w, "place": i, "around": words[max(0, i - size + 1):i + size], "first": max(0, i - size + 1)}
                               for i, w in enumerate(words) if w in inside] if inside else [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()),
                                                  pa.array(at, kind)], names=["doc_id", "key", "n_words", "at"])

    return doc_columns(docs).select("doc_id", "text", text_key()).mapInArrow(scan, SCANNED)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row a document: ``row`` (an id of the row), ``doc_id, key`` (a hash
    of the text), ``n_words, n_hit, n_items, items`` (sorted as text)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "decontaminate")
    windows = written(item_windows(benchmark, size), folder, "windows")
    index = written(prefixes(windows, rarity(docs, windows)), folder, "prefixes")
    # written once, so that the row ids hold and the texts aren't scanned again
    scanned = written(scan_documents(docs, index.select("word").distinct(), size)
                      .withColumn("row", F.monotonically_increasing_id()), folder, "scanned")
    places = scanned.filter(F.size("at") > 0).select("row", F.explode("at").alias("o")).select(
        "row", F.col("o.word").alias("word"), F.col("o.place").alias("i"), F.col("o.around").alias("around"), F.col("o.first").alias("first"))
    start = F.col("i") - F.col("place")
    inside = (start >= F.col("first")) & (start - F.col("first") + F.size("words") <= F.size("around"))
    equal = F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    found = places.join(index, "word").filter(inside & equal).select(
        "row", start.alias("a"), (start + F.size("words")).alias("b"), "words")
    found = written(found, folder, "found")
    # union of intervals: what each adds beyond the furthest end before it
    order = Window.partitionBy("row").orderBy("a", "b")
    spans = found.select("row", "a", "b").distinct()
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = spans.withColumn("reach", F.coalesce(reach, F.lit(0))) \
        .groupBy("row").agg(F.sum(F.greatest(F.col("b") - F.greatest("a", "reach"), F.lit(0))).alias("n_hit"))
    items = found.select("row", "words").distinct().join(windows, "words").groupBy("row").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("no_id"))
    return scanned.select("row", "doc_id", "key", "n_words").join(hits.join(items, "row"), "row", "left").select(
        "row", "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items") + F.col("no_id"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
