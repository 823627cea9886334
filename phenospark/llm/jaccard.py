"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its shingles, ``words`` words in a row (all its words if
it has fewer).  Two documents are linked if the Jaccard similarity of their sets
is ``threshold`` or more.

1. Documents with equal sets form a class; one row stands for it from here on.
   Copies meet in the tasks that read them before anything is shuffled.
2. MinHash values of each class fall into bands.  Classes that share a band are
   in one *cluster* (connected components over the members and their buckets'
   smallest member: a row a membership, never a pair).
3. Inside a cluster, all classes are compared in blocks.  MinHash values are
   compared some at a time; with m of n equal, the posterior probability that the
   similarity reaches the threshold is the tail of a Beta distribution (uniform
   prior), and a pair is dropped when it falls below ``tolerance``.
4. The pairs left are verified exactly on their shingles.

A block pair is one unit of work.  A cluster too large for one unit is split into
blocks, so no task holds a whole cluster; what leaves a unit is a count of linked
documents for each class and a spanning forest of its links, never the pairs.

Defined cases: null and wordless texts have no links and are classes of their own
row each; repeated rows are copies; a null ``doc_id`` is the largest id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import by_key, doc_columns, shared_folder, text_key, words_of, written
from phenospark.llm.components import components

SEED = 7
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**5) ** 25 = 5e-5.
BANDS, ROWS = 25, 5
#: Classes in a block.
BLOCK = 1024

SIGNED = "doc_id long, key long, digest binary, n_shingles int, bands array<long>, signature binary"


def shingle_hashes(words: list[str], n: int, cache: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > 500_000:
        cache.clear()
    get, codes = cache.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        codes.append(h)
    h = np.array(codes, dtype=np.uint64)
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = _mix((out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i:len(h) - k + 1 + i])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit value a hash function: the least of the shingles' values."""
    best = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for a in range(0, len(shingles), 512):  # bounded memory for very long texts
        part = (shingles[a:a + 512, None] ^ _FACTORS[1]) * _FACTORS[0]
        best = np.minimum(best, (part ^ (part >> np.uint64(29))).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """Fewest equal values of ``n`` at which P(similarity >= threshold) is not below ``tolerance``."""
    for m in range(n + 1):
        # 1 - I_t(m + 1, n - m + 1) = P(Binomial(n + 1, t) <= m)
        if sum(comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1)) >= tolerance:
            return m
    return n


def candidates(left: np.ndarray, right: np.ndarray, checks: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) whose MinHash values survive every check
    (from, to, fewest equal so far).  Works through rows of ``left`` in strips."""
    rows, cols = [], []
    for a in range(0, len(left), 64):
        strip = left[a:a + 64]
        lo, hi, least = checks[0]
        equal = np.zeros((len(strip), len(right)), dtype=np.int16)
        for j in range(lo, hi):
            equal += strip[:, j, None] == right[None, :, j]
        i, k = np.nonzero(equal >= least)
        got = equal[i, k].astype(np.int32)
        for lo, hi, least in checks[1:]:
            got = got + (strip[i, lo:hi] == right[k, lo:hi]).sum(axis=1)
            keep = got >= least
            i, k, got = i[keep], k[keep], got[keep]
        rows.append(i + a)
        cols.append(k)
    return np.concatenate(rows), np.concatenate(cols)


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, k: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, by exact intersections."""
    keep = np.zeros(len(i), dtype=bool)
    order = np.argsort(i, kind="stable")
    bounds = np.flatnonzero(np.diff(i[order])) + 1
    for group in np.split(order, bounds):
        if not len(group):
            continue
        own = left[i[group[0]]]
        for a in range(0, len(group), 256):
            part = group[a:a + 256]
            others = [right[x] for x in k[part].tolist()]
            sizes = np.array([len(o) for o in others])
            all_others = np.concatenate(others)
            at = np.minimum(np.searchsorted(own, all_others), len(own) - 1)
            both = np.add.reduceat(own[at] == all_others, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            keep[part] = both >= threshold * (len(own) + sizes - both) - 1e-9
    return keep


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def sign(docs: DataFrame, words: int) -> DataFrame:
    """Per row its set's digest, size, band hashes and MinHash values."""
    def make(batches) -> Iterator:
        import hashlib

        import pyarrow as pa
        import xxhash

        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for i, t, key in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    s = shingle_hashes(words_of(t), words, cache)
                    if not len(s):
                        rows.append((i, key, None, 0, [], None))
                        continue
                    m = minhash(s)
                    bands = [int.from_bytes(xxhash.xxh3_64_digest(m[b * ROWS:(b + 1) * ROWS].tobytes(), b), "little", signed=True)
                             for b in range(BANDS)]
                    rows.append((i, key, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), bands, m.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)],
                    names=["doc_id", "key", "digest", "n_shingles", "bands", "signature"])

    return docs.mapInArrow(make, SIGNED)


def jaccard_links(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """A row a document: ``doc_id, class_id`` (smallest ``doc_id`` of those linked
    to it directly or through others), ``n_links`` (documents linked to it
    directly, copies included), ``n_copies`` (documents with its set, itself
    included), ``leader`` (the one row of the class whose id is ``class_id``), and
    ``key``, a hash of the text."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "jaccard")
    texts = doc_columns(docs).select("doc_id", "text", text_key())
    signed = written(sign(texts, words), folder, "signed")
    sets = signed.filter("n_shingles > 0")
    # the class's number is that of its first document; one row a distinct set
    last = F.lit((1 << 63) - 1)
    order = F.struct(F.coalesce("doc_id", last).alias("doc"), "key", "bands", "signature")
    classes = written(sets.groupBy("digest").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("size"))
                      .select("digest", "x.*", "size").withColumn("c", F.monotonically_increasing_id()), folder, "classes")

    members = classes.select("c", F.posexplode("bands").alias("band", "h"))
    buckets = members.groupBy("band", "h").agg(F.min("c").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = members.join(buckets, ["band", "h"]).filter("c <> a").select("a", F.col("c").alias("b")).distinct()
    clusters = components(written(stars, folder, "stars"), f"{folder}/clusters")

    # clusters are cut into blocks; each pair of blocks is a unit that gets both
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = written(clusters.join(sizes, "component").withColumn("blocks", blocks)
                     .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
                     .select(F.col("id").alias("c"), "component", "blocks", "block"), folder, "placed")
    chosen = classes.join(placed, "c").select("c", "component", "blocks", "block", "size", "signature", "doc", "key")
    with_text = chosen.join(texts.select(F.coalesce("doc_id", last).alias("doc"), "key", "text"), ["doc", "key"])
    units = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "c", "block", "other", "size", "signature", "text")

    steps = list(range(0, BANDS * ROWS + 1, BANDS))
    checks = [(a, b, least_matches(threshold, tolerance, b)) for a, b in zip(steps, steps[1:], strict=False)]

    def compare(batches) -> Iterator:
        import pyarrow as pa

        cache: dict = {}
        for _, held in by_key(batches, "unit"):
            block: dict[int, list] = {}
            seen = set()
            pair = (0, 0)
            for b in held:
                for c, own, other, size, signature, text in zip(*(x.to_pylist() for x in b.columns[1:]), strict=True):
                    if c in seen:  # repeated rows of one document
                        continue
                    seen.add(c)
                    pair = (min(own, other), max(own, other))
                    block.setdefault(own, []).append((c, size, np.frombuffer(signature, np.uint32),
                                                      shingle_hashes(words_of(text), words, cache)))
            if pair[0] not in block or pair[1] not in block:
                continue
            left, right = block[pair[0]], block[pair[1]]
            i, k = candidates(np.array([x[2] for x in left]), np.array([x[2] for x in right]), checks)
            if pair[0] == pair[1]:
                i, k = i[i < k], k[i < k]
            if len(i):
                ok = verified([x[3] for x in left], [x[3] for x in right], i, k, threshold)
                i, k = i[ok], k[ok]
            if not len(i):
                continue
            ids = [np.array([x[0] for x in s]) for s in (left, right)]
            weight = [np.array([x[1] for x in s]) for s in (left, right)]
            linked: dict[int, int] = {}
            for side, own, others in ((0, i, weight[1][k]), (1, k, weight[0][i])):
                total = np.bincount(own, weights=others, minlength=len(ids[side])).astype(np.int64)
                for c, n in zip(ids[side][total > 0].tolist(), total[total > 0].tolist(), strict=True):
                    linked[c] = linked.get(c, 0) + n
            edges = _forest(np.stack([ids[0][i], ids[1][k]], axis=1))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([*linked, *(e[0] for e in edges)], pa.int64()),
                "b": pa.array([*[None] * len(linked), *(e[1] for e in edges)], pa.int64()),
                "n": pa.array([*linked.values(), *[None] * len(edges)], pa.int64())})

    found = written(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long, n long"), folder, "found")
    linked = found.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("linked"))
    groups = components(found.filter("b is not null").select("a", "b"), f"{folder}/groups").select(F.col("id").alias("c"), "component")
    judged = classes.select("c", "digest", "doc", "key", "size").join(groups, "c", "left").join(linked, "c", "left") \
        .withColumn("component", F.coalesce("component", "c"))
    heads = judged.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("head"))
    verdict = judged.join(heads, "component").select(
        "digest", F.col("head.doc").alias("class_id"), F.col("head.key").alias("head_key"), F.col("size").alias("n_copies"),
        (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    verdict = written(verdict, folder, "verdict")
    out = sets.select("doc_id", "key", "digest").join(verdict, "digest").select(
        "doc_id", F.nullif("class_id", last).alias("class_id"), "n_links", "n_copies",
        (F.coalesce("doc_id", last).eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("head_key"))).alias("leader"), "key")
    return out.unionByName(signed.filter("n_shingles = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"),
        F.lit(True).alias("leader"), "key"))
