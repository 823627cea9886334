"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes
have it.  Two fingerprints are linked if at most ``BUDGET`` bits differ.

The 64 bits form a ring of five segments.  If the differences of all segments add
up to at most 4, then from some segment on *every* chain of l consecutive segments
differs in at most 4 l / 5 bits, rounded down: 0, 1, 2, 3, 4 for one to five
segments (the pigeonring principle in its strong form).  So linked fingerprints
have a start where the first segment is equal, the second differs in at most one
bit and the second and third together in at most two.

1. Equal fingerprints become one row with their smallest ``doc_id``, before the
   shuffle and after it.
2. For each start a fingerprint emits its first three segments (38 or 39 bits),
   once as they are and once with each bit of the second and third flipped.  Two
   that differ in at most two of these bits meet at a middle one: no link is lost,
   and chance meetings need 38 equal bits, at any size of the corpus.
3. In a bucket the chains are checked segment by segment, then the full distance.
   A bucket is searched breadth first: each fingerprint is compared with those
   not reached yet, and only the tree's edges leave, never pairs.  A bucket of more
   than ``BLOCK`` members goes on as block pairs, each a unit of its own.
4. Components of these edges; the smallest ``doc_id`` of each names it.

Defined cases: null, empty and wordless texts have fingerprint zero and link like
any other; fewer words than a shingle make one shingle; repeated rows are copies;
a null ``doc_id`` counts after all others (a component of such rows only has a null
name); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import by_key, doc_columns, shared_folder, written
from phenospark.llm.components import components

#: Differing bits of linked fingerprints, and the ring's segments (first bit, end).
BUDGET = 4
SEGMENTS = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
#: Members of a bucket that one task compares.
BLOCK = 4096
#: Hash seed, and shingles whose bits are counted at once.
SEED, STRIP = 42, 4096


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of a whole text; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, STRIP):
        hashes = b"".join([digest(b" ".join(found[i:i + words]), SEED) for i in range(at, min(n, at + STRIP))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row."""
    def make(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return doc_columns(docs).mapInArrow(make, "doc_id long, fp long")


def _mask(start: int, a: int, b: int) -> int:
    """Bits of the ``a``-th to ``b``-th segment of the chain from ``start``."""
    return sum(((1 << (hi - lo)) - 1) << lo for lo, hi in (SEGMENTS[(start + s) % len(SEGMENTS)] for s in range(a, b)))


#: For each start: the bits of the key, those that a key flips, and (bits of the chain, its budget) for two to five segments.
CHAINS = [(_mask(s, 0, 3), [1 << i for i in range(64) if _mask(s, 1, 3) >> i & 1],
           [(_mask(s, 0, n), BUDGET * n // len(SEGMENTS)) for n in range(2, 6)]) for s in range(len(SEGMENTS))]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, their fingerprints): the key's bits turned to bit 0 with the start on
    top, so that equal keys are equal chains of one start."""
    out, own = [], []
    for start, (bits, flips, _) in enumerate(CHAINS):
        base = fps & np.uint64(bits)
        for flip in [0, *flips]:
            key = base ^ np.uint64(flip)
            low = SEGMENTS[start][0]
            turned = key >> np.uint64(low) | (key << np.uint64(64 - low) if low else np.uint64(0))
            out.append(turned | np.uint64(start << 60))
            own.append(fps)
    return np.concatenate(out), np.concatenate(own)


def near(pivot: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Places of ``others`` linked to ``pivot`` by a chain from ``start``: each
    longer chain is judged for those within budget so far, the whole ring last."""
    x = others ^ pivot
    at = np.arange(len(x))
    for bits, budget in CHAINS[start][2]:
        keep = np.bitwise_count(x[at] & np.uint64(bits)) <= budget
        at = at[keep]
        if not len(at):
            break
    return at


def forest(members: np.ndarray, start: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``; with ``across`` (a flag a
    member), of the links between flagged and other ones."""
    left = np.ones(len(members), bool)
    edges = []
    for i in range(len(members)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            p = queue.pop()
            rest = np.flatnonzero(left if across is None else left & (across != across[p]))
            if not len(rest):
                continue
            hit = rest[near(members[p], members[rest], start)]
            left[hit] = False
            edges += [(int(members[p]), int(members[q])) for q in hit]
            queue += hit.tolist()
    return edges


def _edge_batch(edges: list[tuple[int, int]]):
    import pyarrow as pa

    got = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return {"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])}


def bucket_edges(distinct: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges that connect all linked fingerprints of ``distinct`` (``fp``)."""
    def emit(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                k, f = keys(batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], names=["k", "fp"])

    def search(batches) -> Iterator:
        """Buckets in a row; of a large one the members go on as they come (``k``, ``a``)."""
        import pyarrow as pa

        def large(key, members):
            return pa.RecordBatch.from_pydict({"a": pa.array(members.view(np.int64)), "b": pa.nulls(len(members), pa.int64()),
                                               "k": pa.array(np.full(len(members), key).view(np.int64))})

        def judged(k, f, ends):
            starts = np.concatenate([[0], ends[:-1]])
            edges = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                edges += forest(f[a:b], int(k[a] >> np.uint64(60)))
            return pa.RecordBatch.from_pydict(_edge_batch(edges) | {"k": pa.nulls(len(edges), pa.int64())})

        held_k, held_f, over = np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            ends = np.flatnonzero(k[1:] != k[:-1]) + 1
            sizes = np.diff(ends, prepend=0)
            for i in np.flatnonzero((sizes > block) | (k[ends - 1] == (over if over is not None else ~np.uint64(0)))).tolist():
                yield large(k[ends[i] - 1], f[ends[i] - sizes[i]:ends[i]])
                k[ends[i] - sizes[i]:ends[i]] = ~np.uint64(0)  # taken: no start has this key
            ok = np.flatnonzero(k[ends - 1] != ~np.uint64(0)) if len(ends) else ends
            if len(ok):
                take = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in ok]) if len(ok) < len(ends) else slice(0, ends[-1])
                yield judged(k[take], f[take], np.cumsum(sizes[ok]))
            last = ends[-1] if len(ends) else 0
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > block or (over is not None and len(held_k) and held_k[0] == over):
                over = held_k[0]
                yield large(over, held_f)
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield judged(held_k, held_f, np.array([len(held_k)]))

    found = written(distinct.mapInArrow(emit, "k long, fp long").repartition("k").sortWithinPartitions("k")
                    .mapInArrow(search, "a long, b long, k long"), folder, "buckets")
    edges = found.filter("k is null").select("a", "b")
    members = found.filter("k is not null").select("k", F.col("a").alias("fp"))
    sizes = members.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    if not members.limit(1).count():
        return edges
    # a unit is a pair of blocks (or one block); a member goes to one unit a block
    placed = members.join(sizes, "k").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select(F.xxhash64("k", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "k", "block", "other", "fp")

    def compare(batches) -> Iterator:
        import pyarrow as pa

        for _, held in by_key(batches, "unit"):
            t = pa.Table.from_batches(held)
            own, other = t["block"].to_numpy(), t["other"].to_numpy()
            members = t["fp"].to_numpy().view(np.uint64)
            start = int(t["k"][0].as_py() >> 60 & 15)
            yield pa.RecordBatch.from_pydict(_edge_batch(forest(members, start, None if (own == other).all() else own)))

    return edges.unionByName(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """A row a document: ``doc_id, fingerprint`` (16 hex digits) and
    ``component_id``, the smallest ``doc_id`` that links lead to."""
    folder = shared_folder(docs.sparkSession, "simhash")
    signed = written(fingerprints(docs, words), folder, "signed")
    distinct = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "distinct")
    edges = written(bucket_edges(distinct.select("fp"), folder).distinct(), folder, "edges")
    groups = components(edges, f"{folder}/groups")
    named = distinct.join(groups, distinct.fp == groups.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = written(named.groupBy("component").agg(F.min("least").alias("component_id")), folder, "names")
    verdict = written(named.join(names, "component").select("fp", "component_id"), folder, "verdict")
    return signed.join(verdict, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
