import random

import pytest

from tests.conftest import spark  # noqa: F401

NASTY = [
    (1, "", "a"), (2, None, "a"), (3, "x", None), (None, "no id here, none at all today", "b"),
    (5, "Repeated row of text that stands here twice in this table.\nSecond line.\nThird line.", "a"),
    (5, "Repeated row of text that stands here twice in this table.\nSecond line.\nThird line.", "a"),
    (6, "\n\n\n", "b"), (7, "<|endoftext|> and <|startoftext|>\ttabs and spaces   \n  here", "b"),
    (8, "ÑANDÚ İstanbul ﬁne été 漢字かな 😀👍 ½ ²", "c"),
]


def make_rows(seed=3):
    """Texts with copies, near copies, shared passages and one very long text."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ". ", "\n", ", "]) for _ in range(n))
    rows, base, passage = list(NASTY), prose(120), prose(40)
    for i in range(10, 60):
        kind = i % 5
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = prose(30) + passage + prose(20)
        else:
            text = prose(rnd.randint(1, 80))
        rows.append((i, text, f"s{i % 3}" if i % 7 else "hot"))
    rows.append((61, prose(20_000), "hot"))
    return rows


@pytest.fixture(scope="session")
def nasty_rows():
    return make_rows()


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):  # noqa: F811
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(nasty_rows, "doc_id long, text string, source string")
    return df.repartition(3).withColumns({c: F.lit(None).cast("string") for c in (
        "key", "k", "h", "doc", "row", "part", "size", "start", "n", "data", "file", "blob", "spans", "ids", "gone", "score")})


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return spark.createDataFrame([], "doc_id long, text string, source string")
