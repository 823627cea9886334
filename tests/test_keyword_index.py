"""The literal index of keyword lists against the plain criterion (C5)."""

import random

import pytest
from pyspark.sql import functions as F

from phenospark.operators import criteria as C
from phenospark.operators import keyword_index as I
from phenospark.plans import keywords as P

PATTERNS = ["asthma", r"\basthma\b", "licen[cs]e agreement", "wheez(e|ing)", "a|b1", "diabet.*type", "x?yz+", "ab{2,3}c", "colou?r", "[0-9]+", "", "é", "ſtart",
            "Kelvin", "ISTANBUL", r"\d{3}-\d{4}", "(foo|bar) baz", "((nested (deep)) group)?tail", r"\Qa.b\E", "(?i)Quiet", "(?x) spaced out", "(?<![^ ])lone(?![^ ])",
            "one two", "^start", "end$", r"tab\tbed", r"x\.y", "aa*b", "q", "zq", "(?:non )capturing", "[a-z&&[^b]]cd", r"\p{L}ut", "no such thing at all", "😀?smile", "ii"]
TEXTS = ["Asthma attack", "asthmatic", "LICENCE AGREEMENT", "license  agreement", "wheezing", "a", "b1", "diabetes of type", "xyzz", "yz", "abbc", "abc", "abbbbc", "color colour",
         "7", "", "É", "start", "STart", "kelvin K", "istanbul İstanbul ıstanbul", "555-1234", "bar baz", "tail", "a.b axb", "quiet QUIET", "spacedout spaced out", "a lone word",
         "lonely", "one two", "one\ntwo", "the end", "the end\n", "tab\tbed", "x.y xxy", "ab aab", "q", "zq", "non capturing", "acd bcd", "été", "zut", "smile 😀smile", None, "ii II"]


def _expected(spark, texts, patterns):
    """Every pattern over every text, by the plain expression."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    out = set()
    for p in patterns:
        out |= {(r.key, p) for r in df.where(C.keyword_hit(df, [p], ["text"])).collect()}
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_index_equals_every_pattern_over_every_text(spark, monkeypatch, limit):
    monkeypatch.setattr(I, "BROADCAST_BYTES", limit)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "key long, text string")
    pats = spark.createDataFrame([(p, p) for p in PATTERNS], "pattern_id string, pattern string")
    got = [tuple(r) for r in I.pattern_hits(texts.repartition(4), pats).collect()]
    assert set(got) == _expected(spark, TEXTS, PATTERNS) and len(got) == len(set(got))


def test_random_patterns(spark):
    rnd = random.Random(6)
    atom = lambda: rnd.choice(["a", "b", "c", "ab", "ca", ".", "[ab]", "(a|c)", "(bc)", r"\w", "B", " "]) + rnd.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"])
    patterns = sorted({"".join(atom() for _ in range(rnd.randint(1, 6))) + rnd.choice(["", "", "|abc"]) for _ in range(60)})
    texts = ["".join(rnd.choice("abcABC \n") for _ in range(rnd.randint(0, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    pats = spark.createDataFrame([(p, p) for p in patterns], "pattern_id string, pattern string")
    assert {tuple(r) for r in I.pattern_hits(df, pats).collect()} == _expected(spark, texts, patterns)


def test_literals_are_certain(spark):
    df = spark.createDataFrame([(p,) for p in ("asthma", "licen[cs]e agreement", "x?yz+", "a|b", r"\bword\b x", "(?i)a", "ab{2}c")], "p string")
    got = [list(r[0]) for r in df.select(I.certain_literals(F.col("p"))).collect()]
    assert got == [["asthma"], ["licen", "e agreement"], ["yz"], [], ["word", " x"], [], ["a", "c"]]


def test_empty_sides(spark):
    texts = spark.createDataFrame([(1, "x")], "key long, text string")
    pats = spark.createDataFrame([("p", "x")], "pattern_id string, pattern string")
    assert I.pattern_hits(texts.limit(0), pats).count() == 0 and I.pattern_hits(texts, pats.limit(0)).count() == 0
    assert I.pattern_hits(texts, spark.createDataFrame([("p", None)], "pattern_id string, pattern string")).count() == 0


def test_flags_equal_the_criterion(spark):
    df = spark.createDataFrame([("1", "Asthma", None), ("1", None, "wheeze"), ("2", "", "inhaler of asthma"), ("3", None, None), ("3", "fine", "fine")],
                               "`patient-id` string, note string, `other-note` string")
    cats = {"lung": ["asthma", "wheez[ei]"], "drug": ["inhaler"], "none": ["zzz"]}
    pats = spark.createDataFrame([(c, p) for c, ps in cats.items() for p in ps], "category string, pattern string")
    keyed = df.withColumn("row", F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`"), F.lit("~")) for c in df.columns]))
    found = I.keyword_matches(keyed, pats, "row", ["note", "other-note"])
    got = I.keyword_flags(keyed, found, list(cats), "row").drop("row")
    want = C.keyword_categories(df, cats, None, ["note", "other-note"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_long_keyword_list(spark):
    """No bound on the number of keywords; rows with a key in common keep flags of their own."""
    words = [f"word{i:05d}" for i in range(12_000)]
    kw = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row_no long, keyword string")
    notes = spark.createDataFrame([("1", "Has WORD00007 here"), ("1", "none"), ("2", "word11999x")], ["patient-id", "note"])
    long = P.keyword_list_matches(notes, kw, "Lung", "patient-id", ["note"])
    assert {r["patient-id"] for r in long.collect()} == {"1", "2"}
    wide = P.evaluate_keyword_list(notes, kw.where("row_no < 40"), "Lung")
    flags = [c for c in wide.columns if c.endswith("-identified")]
    rows = [[r[f] for f in flags] for r in wide.where("`patient-id` = '1'").collect()]
    assert sorted("CASE" in r for r in rows) == [False, True]


@pytest.mark.parametrize("limit", [128 << 20, 0])
def test_pieces_equal_whole_texts(spark, monkeypatch, limit):
    """Matches at every place around the ends of pieces; looks around see past them, and no end of a piece is one of the text."""
    monkeypatch.setattr(I, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(I, "PIECE", 40)
    monkeypatch.setattr(I, "REACH", 40)
    fills = ["xfoo bar foo barx ", "é", "a b ", "😀", "foo bar"]
    texts = [(fill * 40)[:n] + body for fill in fills for n in list(range(28, 46)) + list(range(68, 86, 3)) + [0, 120] for body in (" foo BAR", "foo bar ", "lone", "")]
    patterns = ["(?<![^ ])foo BAR(?![^ ])", "(?<![^ ])(?:foo )bar(?![^ ])", "(?<![^ ])foo[ ]bar(?![^ ])", "(?<! )foo", "bar(?! )", "[a-z ]lone", "lone|(foo) bar(?=x)",
                "(?<![a-z])", "foo.*lone", "^foo", "bar$", "(x)", "[a]", "zfoo bar", "(?<=bar (foo|far) )bar"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(4)
    pats = spark.createDataFrame([(p, p) for p in patterns], "pattern_id string, pattern string")
    got = [tuple(r) for r in I.pattern_hits(df, pats).collect()]
    assert set(got) == _expected(spark, texts, patterns) and len(got) == len(set(got))


def test_anchors_tell_patterns_apart(spark):
    """Patterns of two words are met by a run that holds both, not by three characters that many share."""
    pats = spark.createDataFrame([(p, p) for p in ("(?<![^ ])(?:alpha )beta(?![^ ])", "(?<![^ ])alpha[ ]GAMMA(?![^ ])", "(?:alpha )?beta", "x|alphabeta")],
                                 "pattern_id string, pattern string")
    got = {(r["pattern"], r["literal"], len(r["gram"]), r["short"]) for r in I.anchored(pats).collect()}
    assert got == {("(?<![^ ])(?:alpha )beta(?![^ ])", " alpha beta ", 8, True), ("(?<![^ ])alpha[ ]GAMMA(?![^ ])", " alpha gamma ", 8, True),
                   ("(?:alpha )?beta", "beta", 3, False), ("x", "x", 1, True), ("alphabeta", "alphabeta", 8, True)}


LONE = lambda body: f"(?<![^ ]){body}(?![^ ])"


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_whole_words_are_looked_up_without_the_expression(spark, monkeypatch, limit):
    """Patterns of plain words between spaces meet the texts' runs of words; nothing but the runs that match is paired."""
    monkeypatch.setattr(I, "BROADCAST_BYTES", limit)
    bodies = ["ab", "ab cd", "AB  cd", " ab", "ab ", "(?:ab )Cd", "a[b] cd", "(ab) (cd)", "ab cd ef", "ab cd ef ab", "ab cd ef ab cd", "sk", "i", " ", "ab?", "a|b", "[ab]b", "(?:ab )?cd"]
    patterns = [LONE(b) for b in bodies] + ["(?<![^ ])ab", "ab cd(?![^ ])", LONE("ab") + "\n"]
    atoms, rnd = ["ab", "AB", "cd", "Cd", "ef", "abc", "", "\u017fk", "s\u212a", "\u0130", "\u0131", "a\tb", "ab\n", "\n"], random.Random(3)
    texts = [" ".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 7))) for _ in range(150)] + [None, "", " ", "  ", "ab cd ef ab cd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    pats = spark.createDataFrame([(p, p) for p in patterns], "pattern_id string, pattern string")
    got = [tuple(r) for r in I.pattern_hits(df.repartition(3), pats).collect()]
    assert set(got) == _expected(spark, texts, patterns) and len(got) == len(set(got))
    known = {r[0]: r[1] for r in pats.select("pattern", I.phrase_of(F.col("pattern"))).collect()}
    assert [known[LONE(b)] for b in bodies] == ["ab", "ab cd", "ab  cd", " ab", "ab ", "ab cd", "ab cd", "ab cd", "ab cd ef", "ab cd ef ab", None, "sk", "i", " ", None, None, None, None]
    monkeypatch.setattr(I, "_hit", None)   # whole words alone need no search
    assert I.pattern_hits(df, pats.where(I.phrase_of(F.col("pattern")).isNotNull())).count() > 50
