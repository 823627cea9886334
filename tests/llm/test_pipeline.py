"""The stages of the pipeline, each on its own input."""

import itertools
from collections import Counter

import corpus_pipeline
from phenospark.llm.common import words_of


def test_stages(spark, nasty, nasty_rows, tmp_path):
    import random

    rnd = random.Random(1)
    benchmark = " ".join(words_of(dict((i, t) for i, t, _ in nasty_rows)[13] or "")[:14])
    spark.createDataFrame([(1, benchmark or "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(rnd.random() < 0.1)) for i in range(0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = Counter(r.doc_id for r in out.collect())
        before = Counter(r.doc_id for r in docs.collect())
        assert not kept - before, name
        if name == "line_dedup":
            assert kept == before
        if name == "toxicity":
            alone = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, out, str(tmp_path)).collect())
            assert alone[10] == 1 and not alone[15] and not alone[20] and alone[61] and alone[2]
        if name == "decontamination":
            assert not kept[13] and kept[61]
        docs = out
    tokens = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in tokens.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_empty(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_emptied_copies_leave_one_row(spark, tmp_path):
    """Copies whose chunks line_dedup cuts are one wordless class, through run()."""
    from phenospark.llm.linechunks import without_repeated_chunks

    def emptied(text):
        rows = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        return without_repeated_chunks(rows).filter("doc_id = 2").first().text == ""

    texts = ("\n".join(f"line {k} of text {n} with some words" for k in range(4)) for n in range(200))
    whole = [t for t, _ in zip((t for t in texts if emptied(t)), range(2), strict=False)]
    rows = [(i, whole[i % 2], "a") for i in range(10, 30)] + [(i, f"text number {i} of its own, kept whole", "b") for i in range(30, 40)]
    rows += [(3, None, "a"), (4, None, "a"), (5, " . ", "a"), (6, " . ", "a"), (None, " . ", "a"), (None, "", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    # the first of each text, one emptied copy, one null text, one of the rows without a word
    assert got == {10, 11, 12, 3, 5, *range(30, 40)}


def test_paragraph_breaks_stay(spark, tmp_path):
    rows = [(i, f"first para of {i}\n\n\nsecond para of {i}\n\n\n\n* * *\n\nthird para of {i}\n\n") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == dict(rows)


def test_repeated_passages_go(spark, nasty, nasty_rows, empty, tmp_path):
    """Planted passages of 2 to 15 lines between differing lines: all of the second
    occurrence goes, the first stays; and all rows against brute force."""
    from phenospark.llm.linechunks import without_repeated_passages

    rows, want = [], {}
    for n in range(140):
        passage = [f"passage {n} line {k}" for k in range(2 + n % 14)]
        for i in (n, n + 1000):
            around = [[f"{i} {side} {k}" for k in range(3)] for side in ("before", "after")]
            rows.append((i, "\n".join(around[0] + passage + around[1])))
            want[i] = "\n".join(around[0] + (passage if i == n else []) + around[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == want

    worded = lambda t: [(k, x) for k, x in enumerate(t.split("\n")) if words_of(x)]
    more = [(210, "one\n\n\ntwo\n\nthree", "s"), (211, "zero\none\n--\ntwo\nfour", "s"), (200, "a\na\na\na\na", "s"), (201, "x\ny\nx\ny\nx", "s"), (202, "y\nx", "s"), (203, "p\n\n", "s"), (None, "q\n\n\n", "s")]
    documents = sorted({(i is None, i or 0, t) for i, t, _ in nasty_rows + more if t is not None})
    first, result = {}, {}
    for d in documents:
        for k, pair in enumerate(itertools.pairwise(x for _, x in worded(d[2]))):
            first.setdefault(pair, (d, k))
    for d in documents:
        lines, gone = worded(d[2]), set()
        for k, ((a, x), (b, y)) in enumerate(itertools.pairwise(lines)):
            if first[x, y] not in ((d, k), (d, k - 1)):
                gone |= set(range(a, b + 1))
        result[d] = "\n".join(x for k, x in enumerate(d[2].split("\n")) if k not in gone)
    expected = Counter((i, None if t is None else result[i is None, i or 0, t]) for i, t, _ in nasty_rows + more)
    table = nasty.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string"))
    got = without_repeated_passages(table)
    assert got.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == expected
    assert without_repeated_passages(empty).count() == 0
