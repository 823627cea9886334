"""Document fingerprints by a randomised edit embedding.

A shared random walk spells a text out: at step j it writes the current
character and moves on to the next one or stays, by a bit drawn from j and the
character alone.  Two walks that have come apart at an edit soon meet again, so a
few edits change a few written characters: edit distance becomes Hamming
distance.

A fingerprint keeps one hashed bit of the written character at fixed steps: in
each octave of steps [2^o, 2^(o+1)) the same ``SAMPLES`` steps for all texts, as
far as the walk goes, behind the walk's length.  The *likeness* of two
fingerprints weighs the share of equal bits of an octave by the steps that the
longer walk spends there, counts octaves that the shorter walk doesn't reach as
unequal, and maps chance (half of the bits) to 0.

Near texts are found by banding the sampled bits and verified by likeness
(:func:`near_pairs`).

Defined cases: null is empty; the empty text's fingerprint is its length alone
(likeness 1 to itself, 0 to others); equal texts have equal fingerprints; rows
with equal ids follow each other by their text's hash; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.common import doc_columns, in_doc_order, shared_folder, written

SEED = 20240229
#: Random bits repeat after so many steps; characters fall into so many classes.
PERIOD, CLASSES = 1 << 16, 16
SAMPLES = 64
#: Steps below the first octave count with it.
FIRST_OCTAVE = 5

RESULT = ("kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "next_fingerprint string, near_edited double, near_next double, text string")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    moves = rng.integers(0, 2, size=(CLASSES, PERIOD), dtype=np.uint8)
    moves[:, -1] = 1  # every class moves within a period
    wait = np.empty((CLASSES, PERIOD), dtype=np.int32)  # steps from here until the walk has moved
    steps = np.arange(PERIOD)
    for c in range(CLASSES):
        at = np.flatnonzero(moves[c])
        nxt = at[np.searchsorted(at, steps)]
        wait[c] = nxt - steps + 1
    return moves, wait.reshape(-1)


_WAIT = None


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def octave_steps(o: int) -> np.ndarray:
    """The sampled steps of octave ``o``, ascending."""
    low = 0 if o == FIRST_OCTAVE else 1 << o
    rng = np.random.default_rng(SEED + o)
    return np.sort(rng.integers(low, 1 << (o + 1), size=SAMPLES, dtype=np.int64))


_STEPS: dict[int, np.ndarray] = {}


def _steps(o: int) -> np.ndarray:
    if o not in _STEPS:
        _STEPS[o] = octave_steps(o)
    return _STEPS[o]


def _classes(codes: np.ndarray) -> np.ndarray:
    return (_mix(codes.astype(np.uint64) + np.uint64(SEED)) % np.uint64(CLASSES)).astype(np.int32) * np.int32(PERIOD)


def walk(codes: list[np.ndarray], starts: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text the step at which each of its characters is first written,
    and the walk's length at the end.  All texts of the batch move together,
    longest first, so that those still moving are a slice."""
    global _WAIT
    if _WAIT is None:
        _WAIT = _tables()[1]
    n = np.array([len(c) for c in codes], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    lengths = n[order]
    flat = _classes(np.concatenate([codes[i] for i in order])) if len(codes) else np.empty(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    written_at = np.empty(len(flat), dtype=np.int64)
    at = np.zeros(len(codes), dtype=np.int64) if starts is None else starts[order].astype(np.int64)
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")  # texts longer than i
    for i, a in enumerate(active.tolist()):
        place = begin[:a] + i
        here = at[:a]
        written_at[place] = here
        here += _WAIT[flat[place] + (here & (PERIOD - 1)).astype(np.int32)]
    out: list = [None] * len(codes)
    for k, i in enumerate(order.tolist()):
        out[i] = np.append(written_at[begin[k]:begin[k] + lengths[k]], at[k])
    return out


def fingerprint(codes: np.ndarray, steps: np.ndarray) -> str:
    """Hexadecimal: 8 digits of the walk's length, then 16 for each octave it reaches."""
    length = int(steps[-1])
    if not len(codes):
        return "00000000"
    top = max(FIRST_OCTAVE, (length - 1).bit_length() - 1)
    at = np.concatenate([_steps(o) for o in range(FIRST_OCTAVE, top + 1)])
    inside = at < length
    char = np.searchsorted(steps[:-1], at, side="right") - 1
    value = np.where(inside, codes[char].astype(np.uint64) + np.uint64(1), np.uint64(0))
    bits = (_mix(value * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return f"{length & 0xFFFFFFFF:08x}" + np.packbits(bits).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 (as unrelated texts) to 1 (as equal texts)."""
    if a == b:
        return 1.0
    la, lb = int(a[:8], 16), int(b[:8], 16)
    if not la or not lb:
        return 0.0
    longest, total, same = max(la, lb), 0.0, 0.0
    for k in range(max(len(a), len(b)) // 16):
        o = FIRST_OCTAVE + k
        low, high = (0 if k == 0 else 1 << o), min(1 << (o + 1), longest)
        x, y = a[8 + 16 * k:24 + 16 * k], b[8 + 16 * k:24 + 16 * k]
        total += high - low
        if x and y:
            used = min(SAMPLES, int(np.searchsorted(_steps(o), longest)))
            if used:
                differing = ((int(x, 16) ^ int(y, 16)) >> (SAMPLES - used)).bit_count()
                same += (high - low) * (1 - 2 * differing / used)
    return min(1.0, max(0.0, same / total)) if total else 0.0


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def fingerprints(texts: list[str]) -> list[str]:
    codes = [codes_of(t) for t in texts]
    return [fingerprint(c, s) for c, s in zip(codes, walk(codes), strict=True)]


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the start of the next one, and how much is kept."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter], len(text) - quarter


def _compare(texts: list[str], followings: list[str], next_prints: list[str] | None = None) -> list[tuple]:
    """Per text: n_chars, edited hash, three fingerprints, two likenesses.  An
    edited text's walk goes on from where the kept part ends."""
    import hashlib

    codes = [codes_of(t) for t in texts]
    steps = walk(codes)
    prints = [fingerprint(c, s) for c, s in zip(codes, steps, strict=True)]
    changed = [edited(t, f) for t, f in zip(texts, followings, strict=True)]
    changed_codes = [codes_of(e) for e, _ in changed]
    tails = walk([c[k:] for c, (_, k) in zip(changed_codes, changed, strict=True)],
                 np.array([s[k] for s, (_, k) in zip(steps, changed, strict=True)], dtype=np.int64))
    out = []
    for i, (e, k) in enumerate(changed):
        p = fingerprint(changed_codes[i], np.concatenate([steps[i][:k], tails[i]]))
        nxt = next_prints[i] if next_prints else None
        out.append((len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), prints[i], p, nxt,
                    likeness(prints[i], p), likeness(prints[i], nxt) if nxt else None))
    return out


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and both likenesses.

    Documents lie in ranges of ids, so a document's successor is the next row;
    only the last of each range waits for the first of the next range that has
    any.  Those edges are two rows a range."""
    folder = shared_folder(docs.sparkSession, "fingerprints")

    def compare(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
                 pa.float64(), pa.float64(), pa.string())
        names = [x.split()[0] for x in RESULT.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        ids, texts, size, first = [], [], 0, True

        def flush(last: bool):
            """All rows but the last, whose successor isn't known yet."""
            done = _compare(texts[:-1], texts[1:], None)
            tip = fingerprints(texts[-1:])[0]
            follow = [*[d[2] for d in done[1:]], tip]
            rows = [(0, part, i, n, sha, p, e, f, near, likeness(p, f), None)
                    for i, (n, sha, p, e, _, near, _), f in zip(ids, done, follow, strict=False)]
            if last:
                rows.append((2, part, ids[-1], len(texts[-1]), None, tip, None, None, None, None, texts[-1]))
            return rows

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for i, t in zip(*(c.to_pylist() for c in batch.slice(a, 512).columns), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if first:
                        first = False
                        yield table([(1, part, i, len(t), None, fingerprints([t])[0], None, None, None, None, t)])
                    if size > 12_000_000 and len(ids) > 1:
                        if rows := flush(False):
                            yield table(rows)
                        ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if ids:
            yield table(flush(True))

    def finish(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(batch.num_rows):
                part, doc_id, text, following, print_ = (c[a].as_py() for c in batch.columns)
                n, sha, p, e, f, near, nearest = _compare([text], [following], [print_])[0]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id], pa.int64()), "n_chars": pa.array([n], pa.int64()), "edited_sha256": [sha],
                    "fingerprint": [p], "edited_fingerprint": [e], "next_fingerprint": [f], "near_edited": [near], "near_next": [nearest]})

    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "near_edited", "near_next"]
    rows = written(in_doc_order(doc_columns(docs)).mapInArrow(compare, RESULT), folder, "rows")
    firsts, lasts = rows.filter("kind = 1"), rows.filter("kind = 2")
    # two rows a range of documents; after the last range comes the first
    heads = firsts.select("part", F.col("text").alias("following"), F.col("fingerprint").alias("print"),
                          F.row_number().over(Window.orderBy("part")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    before = heads.select(F.when(F.col("k") == 1, F.col("n")).otherwise(F.col("k") - 1).alias("k"), "following", "print")
    ranks = heads.select("part", "k")
    edges = lasts.join(ranks, "part").join(before, "k").select("part", "doc_id", "text", "following", "print")
    tails = edges.mapInArrow(finish, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                     "next_fingerprint string, near_edited double, near_next double")
    return rows.filter("kind = 0").select(columns).unionByName(tails)


def near_pairs(prints: DataFrame, least: float, bands: int = 16) -> DataFrame:
    """Distinct fingerprints of likeness ``least`` or more: ``a``, ``b`` (a < b),
    ``likeness``.  ``prints`` has ``fingerprint``.

    Bit-sampled banding: the bits of the octave that holds most of the walk are
    dealt into ``bands``; fingerprints that agree in a band meet.  Copies are one
    fingerprint, so a group of copies is one row however large."""
    distinct = prints.select("fingerprint").distinct().filter(F.length("fingerprint") > 8)
    octaves = ((F.length("fingerprint") - 8) / 16).cast("int")
    width = 16 // bands if bands < 16 else 1
    keys = distinct.withColumn("o", F.explode(F.sequence(F.greatest(octaves - 2, F.lit(0)), octaves - 1))) \
        .withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(16 // width - 1)))) \
        .withColumn("bits", F.substring("fingerprint", F.col("o") * 16 + F.col("band") * width + 9, F.lit(width)))
    if width < 4:  # single digits meet by chance: bands of neighbouring pairs of digits in both octaves
        keys = keys.withColumn("bits", F.concat("bits", F.substring("fingerprint", F.col("o") * 16 + (F.col("band") * 7 + 3) % 16 + 9, F.lit(3))))

    def verify(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                                              "likeness": pa.array([likeness(x, y) for x, y in zip(a, b, strict=True)], pa.float64())})

    left, right = keys.alias("l"), keys.alias("r")
    pairs = left.join(right, (F.col("l.o") == F.col("r.o")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.bits") == F.col("r.bits"))
                      & (F.col("l.fingerprint") < F.col("r.fingerprint"))) \
        .select(F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b")).distinct()
    return pairs.mapInArrow(verify, "a string, b string, likeness double").filter(F.col("likeness") >= least)
