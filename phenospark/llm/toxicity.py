"""Toxicity by weak supervision.

Voters: fixed lexicons and patterns, and lexicons mined from labelled rows (words
and word beginnings that are far likelier in toxic texts, dealt to several
voters).  A voter hits a text or not.

1. Mining: counts of every word and word beginning in a bounded sample of the
   labelled rows (``sample_rows``, a documented bound).
2. Votes of all documents, as counts of vote patterns: 16 voters make at most
   65,536 patterns, which is all the driver sees of the corpus.
3. Generative label model: hit rates of every voter for either class and the
   class balance, by expectation-maximization over the patterns; the labels of
   the sample are one more, very accurate, voter on their rows.  Correlations of
   voters within a class are estimated from the same posteriors, and a voter's
   say is divided by one plus what it shares with the others, so two copies of
   one voter count as one.
4. A logistic regression on the mined words and the voters is trained on the
   posterior labels of the sample and scores every whole text.

Scores depend on the text alone: equal texts have equal scores.

Defined cases: null is empty; the empty text gets the score of no hit; labels
that are null are no labels, a document labelled twice is toxic if any label is;
without usable labels the fixed voters alone make the posteriors (of a bounded
sample of documents); repeated documents are scored each; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import doc_columns, shared_folder, text_key, words_of, written

#: Bound of the labelled rows that the lexicons and the classifier are fitted on.
SAMPLE_ROWS = 20_000
#: Words and word beginnings that the classifier weighs.
FEATURES = 4096
#: Mined words that vote, and the voters they are dealt to.
MINED_WORDS, MINED_VOTERS = 96, 8

#: Fixed lexicons, one voter each.
LEXICONS = (
    frozenset("idiot idiots moron morons imbecile cretin fool fools dumb stupid stupidity halfwit dimwit".split()),
    frozenset("loser losers clown clowns pathetic worthless useless failure nobody joke".split()),
    frozenset("scum trash garbage filth vermin parasite disgusting vile repulsive creep pig pigs".split()),
    frozenset("hate despise kill die hurt destroy burn shoot beat threat".split()),
    frozenset("damn hell crap bastard bitch asshole shit fuck fucking bullshit".split()),
    frozenset("idiota imbécil estúpido estúpida basura asqueroso idiote imbécile débile ordure connard crétin "
              "dumm dummkopf idioten trottel abschaum widerlich".split()),
)
#: Fixed patterns, one voter each, over the text as it is.
PATTERNS = (re.compile(r"[!?]{3,}"), re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2,}"))
VOTERS = MINED_VOTERS + len(LEXICONS) + len(PATTERNS)


def features_of(word: str) -> tuple[str, ...]:
    """The word and its beginnings of 4 and 5 letters (of longer words)."""
    return (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n))


class Reader:
    """Known features and voters of a text; words are looked up once."""

    def __init__(self, features: list[str], votes: dict[str, int]):
        self.index = {f: i for i, f in enumerate(features)}
        self.votes = votes  # mined word -> voter
        self.known: dict[str, tuple] = {}

    def _word(self, w: str) -> tuple:
        fs = features_of(w)
        ids = [self.index[f] for f in fs if f in self.index]
        voters = {self.votes[f] for f in fs if f in self.votes} | {MINED_VOTERS + k for k, lexicon in enumerate(LEXICONS) if w in lexicon}
        got = (frozenset(ids), sum(1 << v for v in voters)) if ids or voters else ()
        if len(self.known) >= 500_000:
            self.known.clear()
        self.known[w] = got
        return got

    def read(self, text: str) -> tuple[set, int]:
        """(feature numbers, votes as bits)."""
        ids: set = set()
        bits, get = 0, self.known.get
        for w in set(words_of(text.lower())):
            got = get(w)
            if got is None:
                got = self._word(w)
            if got:
                ids |= got[0]
                bits |= got[1]
        for k, p in enumerate(PATTERNS):
            if p.search(text):
                bits |= 1 << (MINED_VOTERS + len(LEXICONS) + k)
        return ids, bits


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """``text, y`` of at most about ``rows`` usable labelled documents (drawn by a
    hash of their id); of unlabelled ones (y null) if there is no label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")) \
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).filter(usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    table = docs.join(known, "doc_id") if n else docs.filter(usable).select("doc_id", "text", F.lit(None).cast("int").alias("y"))
    share = min(1.0, rows / max(1, n or docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    return table.filter(drawn).select("text", "y")


def mine(sample: DataFrame, features: int) -> list[tuple[str, int, int]]:
    """The ``features`` words and beginnings that tell the labels apart best:
    (feature, toxic rows, other rows), by the size of a two-sample z value."""
    def count(batches) -> Iterator:
        import pyarrow as pa

        total = (Counter(), Counter())

        def table():
            both = sorted(total[0].keys() | total[1].keys())
            return pa.RecordBatch.from_pydict({"f": pa.array(both, pa.string()), "n1": pa.array([total[1][f] for f in both], pa.int64()),
                                               "n0": pa.array([total[0][f] for f in both], pa.int64())})

        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[y > 0].update({f for w in set(words_of(text.lower())) for f in features_of(w)})
                if len(total[0]) + len(total[1]) > 500_000:
                    yield table()
                    total[0].clear()
                    total[1].clear()
        yield table()

    rows = {bool(y): n for y, n in sample.groupBy((F.col("y") > 0).alias("y")).count().collect() if y is not None}
    n1, n0 = rows.get(True, 0), rows.get(False, 0)
    if not n1 or not n0:
        return []
    share = (F.col("n1") + F.col("n0")) / (n1 + n0)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share + 1e-9) * (1 / n1 + 1 / n0))
    counts = sample.filter(F.col("y").isNotNull()).select("text", "y").mapInArrow(count, "f string, n1 long, n0 long") \
        .groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter(F.col("n1") + F.col("n0") >= 5)
    top = counts.withColumn("z", z).orderBy(F.abs("z").desc(), "f").limit(features)
    return [(r.f, r.n1, r.n0) for r in top.collect()]


def mined_voters(found: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, int]:
    """The best toxic words, dealt to the voters in turn."""
    toxic = [f for f, a, b in found if (a + 0.5) / (n1 + 1) > 4 * (b + 0.5) / (n0 + 1)][:MINED_WORDS]
    return {f: k % MINED_VOTERS for k, f in enumerate(toxic)}


def read_all(docs: DataFrame, features: list[str], votes: dict[str, int]) -> Counter:
    """Vote patterns of all documents, counted."""
    def count(batches) -> Iterator:
        import pyarrow as pa

        reader, total = Reader([], votes), Counter()
        for batch in batches:
            total.update(reader.read(t)[1] for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"bits": pa.array(list(total), pa.int64()), "n": pa.array(total.values(), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n"))
    return Counter({r.bits: r.n for r in rows.collect()})  # at most 2 ** VOTERS rows


class LabelModel:
    """Hit rates of voters given the class, class balance, and what voters share."""

    def __init__(self, patterns: Counter, labelled: Counter, rounds: int = 30):
        """``patterns``: votes -> documents; ``labelled``: (votes, label) -> documents."""
        self.rates = np.tile([[0.01], [0.4]], (1, VOTERS))  # [class, voter]
        self.balance, self.say = 0.1, np.ones(VOTERS)
        keys = [(b, None, n) for b, n in patterns.items()] + [(b, y, n) for (b, y), n in labelled.items()]
        if not keys:
            return
        votes = np.array([[b >> v & 1 for v in range(VOTERS)] for b, _, _ in keys], dtype=float)
        self.rates[1, votes.sum(axis=0) == 0] = self.rates[0, 0]  # a voter that never hits says nothing
        gold = np.array([0.0 if y is None else (4.0 if y else -4.0) for _, y, _ in keys])
        n = np.array([k[2] for k in keys], dtype=float)
        is_gold = gold != 0
        # the labels say more about hit rates than as many unlabelled rows
        weight = np.where(is_gold, np.maximum(1.0, n[~is_gold].sum() / max(1.0, n[is_gold].sum())), 1.0) * n
        if is_gold.any():
            self._estimate(votes[is_gold], 1 / (1 + np.exp(-gold[is_gold])), weight[is_gold])
        for _ in range(rounds):
            post = 1 / (1 + np.exp(-(self.logit(votes) + gold)))
            self._estimate(votes, post, weight)
            self.say = 1 / (1 + self._shared(votes, post, weight))

    def _estimate(self, votes, post, weight) -> None:
        for c, p in ((0, (1 - post) * weight), (1, post * weight)):
            self.rates[c] = (p @ votes + (0.5 if c else 0.05)) / (p.sum() + 1)
        self.rates = np.clip(self.rates, 1e-5, 1 - 1e-5)
        self.rates[1] = np.maximum(self.rates[1], self.rates[0])  # a hit never speaks for a clean text
        self.balance = float(np.clip((post * weight).sum() / weight.sum(), 1e-3, 0.5))

    def _shared(self, votes, post, weight) -> np.ndarray:
        """Sum of each voter's positive correlations with the others, within the classes."""
        total, out = weight.sum(), np.zeros(VOTERS)
        for p in ((1 - post) * weight, post * weight):
            if p.sum() < 1:
                continue
            mean = p @ votes / p.sum()
            centred = votes - mean
            cov = (centred * p[:, None]).T @ centred / p.sum()
            sd = np.sqrt(np.diag(cov)) + 1e-9
            corr = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(corr, 0)
            out += corr.sum(axis=1) * p.sum() / total
        return out

    def logit(self, votes: np.ndarray) -> np.ndarray:
        hit = np.log(self.rates[1] / self.rates[0])
        miss = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return np.log(self.balance / (1 - self.balance)) + (votes * (hit * self.say) + (1 - votes) * (miss * self.say)).sum(axis=1)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, penalty: float = 3e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of hit numbers, soft targets; accelerated full-batch gradient."""
    if not len(rows):
        return np.zeros(size), -2.0
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.zeros(size + 1)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(owner, weights=w[at], minlength=len(rows)) + w[-1])))
        error = (p - target) / len(rows)
        grad = np.append(np.bincount(at, weights=error[owner], minlength=size) + penalty * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> DataFrame:
    """Per document ``doc_id, key`` (a hash of the text), ``score`` (0 to 1).  ``usable``: a
    condition on ``doc_id``, which labels may be learnt from."""
    folder = shared_folder(docs.sparkSession, "toxicity")
    texts = doc_columns(docs)
    sample = written(labelled_sample(texts, labels, usable, sample_rows), folder, "sample")
    found = mine(sample, features)
    known = [f for f, _, _ in found]
    counts = Counter({r[0]: r[1] for r in sample.groupBy("y").count().collect()})
    votes = mined_voters(found, counts[1], counts[0])
    patterns = read_all(texts, known, votes)

    def read(batches) -> Iterator:
        import pyarrow as pa

        reader = Reader(known, votes)
        for batch in batches:
            got = [reader.read(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "ids": pa.array([sorted(i) for i, _ in got], pa.list_(pa.int32())),
                                              "bits": pa.array([b for _, b in got], pa.int64())})

    rows = sample.select("text", "y").mapInArrow(read, "y int, ids array<int>, bits long").collect()  # bounded by sample_rows
    model = LabelModel(patterns, Counter((r.bits, r.y > 0) for r in rows if r.y is not None))
    size = len(known) + VOTERS
    hits = [np.array([*r.ids, *(len(known) + v for v in range(VOTERS) if r.bits >> v & 1)], dtype=np.int64) for r in rows]
    if rows:
        said = model.logit(np.array([[r.bits >> v & 1 for v in range(VOTERS)] for r in rows], dtype=float))
        gold = np.array([0.0 if r.y is None else (4.0 if r.y > 0 else -4.0) for r in rows])
        posterior = 1 / (1 + np.exp(-np.clip(said + gold, -30, 30)))
    else:
        posterior = np.empty(0)
    weights, bias = fit_linear(hits, posterior, size)

    def score(batches) -> Iterator:
        import pyarrow as pa

        reader = Reader(known, votes)
        voter = weights[len(known):]
        by_bits: dict[int, float] = {}
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                ids, bits = reader.read(t)
                if bits not in by_bits:
                    by_bits[bits] = float(sum(voter[v] for v in range(VOTERS) if bits >> v & 1))
                x = bias + by_bits[bits] + float(weights[sorted(ids)].sum())
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "key", "score"])

    return texts.select("doc_id", text_key(), "text").mapInArrow(score, "doc_id long, key long, score double")
