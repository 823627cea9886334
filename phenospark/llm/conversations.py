"""Conversation structure repair by Wagner-Fischer alignment to target strings.

A repaired conversation's role initials are ``(s?(ua)+)?``.  Its rows are aligned
to each feasible length of the alternating string; of the cheapest alignments the
ASCII-least audit (the edits' initials in order) stays.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of a blank or
duplicate row), Insert an empty-text user or assistant row 3; a truncated row that
is not deleted adds 3.

1. *Lines.*  Rows become (conversation, turn, role, digest of the text, blank,
   truncated) with their number, before the shuffle; a line's first row is a
   duplicate unless its turn is the first with that role and text.  Texts stay behind.
2. *Fragments.*  Lines are dealt in ranges of (conversation, turn, role, digest), so
   a conversation of any length spreads over tasks.  A task cuts its rows into
   chunks of ``CHUNK`` and aligns each chunk to the continuations of the grammar from
   each state that may lie before it: for every length a table of suffix costs, only
   as wide as the cheapest cost so far allows (a cell off the path's diagonals
   costs 7 a step: one more insertion and one more deletion), then a backtrace that
   takes D, I, K, R in this order.  What a chunk leaves is, for each pair of states
   before and after it, the least (cost, audit).  These combine like matrices:
   costs add, audits follow each other.  An audit can't begin another of the same cost
   (it would need more edits), so the least parts make the least whole.
3. *Conversations.*  The few fragments of a conversation combine; the audit then runs
   along its texts, in order, into the digest: rows pass one by one and are not held.

The audit is one cell and the digest one sequential hash a conversation by contract:
those two alone pass a conversation through one task, the audit at a byte a row.

Defined cases: null conversation ids are one conversation; null roles and texts are
one space, null turns come first; rows of one turn lie by role, then by the text's
digest; repeated rows are duplicates; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import by_key, shared_folder, written

#: Rows that are aligned at once.
CHUNK = 48
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: White space of texts.
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

#: Best alignment from a state to a state: (cost, audit).  States: nothing yet, after s, after u, after a.
Matrix = dict[tuple[int, int], tuple[int, str]]
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (NONE, AFTER_S, AFTER_U, AFTER_A)

FRAGMENT = ("k string, conv_id long, part int, ordinal long, first string, last string, blank long, duplicate long, truncated long, "
            "illegal long, matrix array<struct<s:int,e:int,cost:long,audit:string>>")
REPAIR = "k string, conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

# a row of the alignment: (role initial, truncated, forced deletions in a row; 0: a row that may stay)
Row = tuple[str, bool, int]


def offset_cost(x: int) -> int:
    """Least cost of ``x`` rows more (deletions) or fewer (insertions) than the target has."""
    return DELETE * x if x > 0 else -INSERT * x


def aligned(rows: tuple[Row, ...], target: str, bound: int) -> tuple[int, str] | None:
    """Cheapest alignment of the rows to ``target`` and its ASCII-least audit; None
    if it costs more than ``bound``."""
    n, m = len(rows), len(target)
    free = sum(not r[2] for r in rows)
    forced = DELETE * sum(r[2] for r in rows)
    total = free - m
    slack = bound - forced - offset_cost(total)
    if slack < 0:
        return None
    low, high = min(0, total) - slack // (DELETE + INSERT), max(0, total) + slack // (DELETE + INSERT)
    far = 1 << 60
    costs = [[far] * (m + 2) for _ in range(n + 2)]
    before = free  # free rows before row i
    for i in range(n, -1, -1):
        if i < n and not rows[i][2]:
            before -= 1
        row, below = costs[i], costs[i + 1]
        initial, extra, gone = (rows[i][0], TRUNCATED if rows[i][1] else 0, rows[i][2]) if i < n else ("", 0, 0)
        for j in range(min(m, before - low), max(0, before - high) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            best = far
            if i < n:
                best = below[j] + DELETE * (gone or 1)
                if j < m and not gone and (initial == target[j] or target[j] != "s"):
                    best = min(best, below[j + 1] + extra + (KEEP if initial == target[j] else REROLE))
            if j < m and target[j] != "s":
                best = min(best, row[j + 1] + INSERT)
            row[j] = best
    if costs[0][0] > bound or costs[0][0] >= far:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        cost = costs[i][j]
        initial, extra, gone = (rows[i][0], TRUNCATED if rows[i][1] else 0, rows[i][2]) if i < n else ("", 0, 0)
        if i < n and costs[i + 1][j] + DELETE * (gone or 1) == cost:
            audit.append("D" * (gone or 1))
            i += 1
        elif j < m and target[j] != "s" and costs[i][j + 1] + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if initial == target[j] else "R")
            i, j = i + 1, j + 1
    return costs[0][0], "".join(audit)


def alternating(first: str, length: int) -> str:
    return ("ua" if first == "u" else "au") * (length // 2) + (first if length % 2 else "")


def by_length(rows: tuple[Row, ...], head: str, first: str) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) for targets ``head`` + alternating string of an empty
    (0), odd (1) or even (2) length.  Lengths next to the rows' number come first;
    a length is tried while the rows more or fewer may cost no more than the cheapest so far."""
    free = sum(not r[2] for r in rows)
    forced = DELETE * sum(r[2] for r in rows)
    if head and not any(r[0] == head and not r[2] for r in rows):
        return {}  # s can only be kept
    best: dict[int, tuple[int, str]] = {}

    def attempt(length: int) -> None:
        kind = 0 if not length else 2 - length % 2
        bound = best[kind][0] if kind in best else forced + DELETE * free + INSERT * length + TRUNCATED
        got = aligned(rows, head + alternating(first, length), bound)
        if got:
            best[kind] = min(best.get(kind, got), got)

    attempt(0)
    middle = max(1, free - len(head))
    down, up = middle, middle + 1
    worst = lambda length: (k := 2 - length % 2) not in best or forced + offset_cost(free - len(head) - length) <= best[k][0]
    # the bound rises with the distance: a parity is done once one of its lengths is too far
    while down > 0 and (worst(down) or worst(down - 1)):
        attempt(down)
        down -= 1
    while worst(up) or worst(up + 1):
        attempt(up)
        up += 1
    return best


@lru_cache(maxsize=20_000)
def chunk_matrix(rows: tuple[Row, ...], starts: tuple[int, ...]) -> Matrix:
    """Least (cost, audit) of a chunk from each of ``starts`` to each state."""
    out: Matrix = {}

    def add(start: int, end: int, got: tuple[int, str] | None) -> None:
        if got and (start, end) not in out or got and got < out[start, end]:
            out[start, end] = got

    u = by_length(rows, "", "u")
    for start in starts:
        if start == AFTER_U:
            a = by_length(rows, "", "a")
            for kind, end in ((0, AFTER_U), (1, AFTER_A), (2, AFTER_U)):
                add(start, end, a.get(kind))
            continue
        for kind, end in ((0, start), (1, AFTER_U), (2, AFTER_A)):
            add(start, end, u.get(kind))
        if start == NONE:
            s = by_length(rows, "s", "u")
            for kind, end in ((0, AFTER_S), (1, AFTER_U), (2, AFTER_A)):
                add(start, end, s.get(kind))
    return out


def combined(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = {}
    for (s, q), (cost, audit) in left.items():
        for (p, e), (more, rest) in right.items():
            if p == q and ((s, e) not in out or cost + more <= out[s, e][0]):
                got = (cost + more, audit + rest)
                if (s, e) not in out or got < out[s, e]:
                    out[s, e] = got
    return out


class Fragment:
    """Rows of one conversation, or a part of it, as they come in order; holds a
    chunk of rows and the matrices of the chunks before, combined in pairs."""

    def __init__(self, from_start: bool):
        self.starts = (NONE,) if from_start else STATES
        self.rows: list[Row] = []
        self.stack: list[tuple[int, Matrix]] = []
        self.first: str | None = None
        self.last = ""
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def line(self, role: str, blank: bool, truncated: bool, copies: int, duplicates: int) -> None:
        """``copies`` equal rows, the last ``duplicates`` of them duplicates (of a blank line: none)."""
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1 if initial + initial not in LEGAL else 0
        self.last = initial
        if blank:
            self.blank += copies
            self.forced(copies)
            return
        self.duplicate += duplicates
        if copies > duplicates:
            self.truncated += truncated
            self.row((initial, truncated, 0))
        self.forced(duplicates)

    def forced(self, n: int) -> None:
        if n and self.rows and self.rows[-1][2]:  # one run: insertions inside it are never ASCII-least
            self.rows[-1] = ("", False, self.rows[-1][2] + n)
        elif n:
            self.row(("", False, n))

    def row(self, row: Row) -> None:
        if len(self.rows) >= CHUNK:
            self.close()
        self.rows.append(row)

    def close(self) -> None:
        starts = self.starts if not self.stack else STATES
        self.stack.append((0, chunk_matrix(tuple(self.rows), starts)))
        self.rows = []
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            level, right = self.stack.pop()
            self.stack[-1] = (level + 1, combined(self.stack[-1][1], right))

    def matrix(self) -> Matrix:
        if self.rows or not self.stack:
            self.close()
        while len(self.stack) > 1:
            level, right = self.stack.pop()
            self.stack[-1] = (level, combined(self.stack[-1][1], right))
        return self.stack[0][1]


def repaired(matrix: Matrix) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation: it ends empty or after an assistant."""
    return min(matrix[NONE, e] for e in (NONE, AFTER_A) if (NONE, e) in matrix)


def repaired_rows(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the repaired conversation, from its rows in order."""
    length = len(audit) - audit.count("D")
    odd = length % 2
    rows, at = iter(rows), 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["ua"[(at - odd) % 2]]
        at += 1
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``conv_id, turn, role, text, copies``."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"))
    return rows.filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def conversation_key(conv: Column) -> Column:
    """Never null, and different for different ids."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def lines_of(rows: DataFrame, folder: str) -> DataFrame:
    """Equal rows as one line: ``copies`` of them, the last ``duplicates`` seen earlier."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    own = ["conv_id", "turn", "role", "digest", "blank", "truncated"]
    lines = written(rows.select("conv_id", "turn", "role", "copies", F.md5(F.col("text").cast("binary")).alias("digest"), (bare == "").alias("blank"),
                                (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
                    .groupBy(*own).agg(F.sum("copies").alias("copies")), folder, "lines")
    first = written(lines.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
                    .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")), folder, "firsts")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = (~F.col("turn").eqNullSafe(F.col("first.turn"))).cast("long")
    return lines.join(first, same).select(*own, "copies", (F.col("copies") - 1 + seen).alias("duplicates"))


def fragments(lines: DataFrame) -> DataFrame:
    """A row a conversation and range of lines (``FRAGMENT``)."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select(conversation_key(F.col("conv_id")).alias("k"), "conv_id", F.spark_partition_id().alias("part"),
                "role", "blank", "truncated", "copies", "duplicates")

    def align(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("k", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("ordinal", pa.int64()), ("first", pa.string()),
                            ("last", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                            ("illegal", pa.int64()), ("matrix", pa.list_(pa.struct([
                                ("s", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
        out, held = [], 0
        for ordinal, (k, parts) in enumerate(by_line(batches)):
            fragment, conv, part = Fragment(ordinal > 0), None, 0  # the first may go on from the range before
            for conv, part, *line in parts:
                fragment.line(*line)
            matrix = [{"s": s, "e": e, "cost": c, "audit": a} for (s, e), (c, a) in fragment.matrix().items()]
            out.append({"k": k, "conv_id": conv, "part": part, "ordinal": ordinal, "first": fragment.first, "last": fragment.last,
                        "blank": fragment.blank, "duplicate": fragment.duplicate, "truncated": fragment.truncated,
                        "illegal": fragment.illegal, "matrix": matrix})
            held += sum(len(x["audit"]) + 50 for x in matrix)
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(align, FRAGMENT)


def by_line(batches) -> Iterator[tuple[str, Iterator[tuple]]]:
    """(key, its rows as they come) of a sorted partition; nothing is held."""
    from itertools import groupby

    rows = (r for b in batches for a in range(0, b.num_rows, 1024) for r in zip(*(c.to_pylist() for c in b.slice(a, 1024).columns), strict=True))
    for k, group in groupby(rows, key=lambda r: r[0]):
        yield k, (r[1:] for r in group)


def whole_conversations(parts: DataFrame) -> DataFrame:
    """Fragments combined, a row a conversation (``REPAIR``)."""
    def combine(batches) -> Iterator:
        import pyarrow as pa

        for k, held in by_key(batches, "k"):
            whole, total, last, conv = None, [0] * 4, None, None
            for b in held:
                for r in b.to_pylist():
                    m = {(x["s"], x["e"]): (x["cost"], x["audit"]) for x in r["matrix"]}
                    whole, conv = m if whole is None else combined(whole, m), r["conv_id"]
                    total = [t + r[c] for t, c in zip(total, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                    total[3] += last is not None and last + r["first"] not in LEGAL
                    last = r["last"]
            cost, audit = repaired(whole)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                (k, conv, *total, cost, audit), (pa.string(), *[pa.int64()] * 6, pa.string()), strict=True)],
                names=["k", "conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return parts.repartition("k").sortWithinPartitions("k", "part").mapInArrow(combine, REPAIR)


def digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``k, repaired_sha256``: a conversation's audit, then its rows in order."""
    none = lambda t: F.lit(None).cast(t)
    texts = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        conversation_key(F.col("conv_id")).alias("k"), F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    heads = repairs.select("k", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"),
                           none("string").alias("digest"), F.col("audit").alias("text"))
    order = ["k", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = heads.unionByName(texts).repartition("k").sortWithinPartitions(*order).select("k", "role", "text")

    def digest(batches) -> Iterator:
        import pyarrow as pa

        keys, found = [], []
        for k, parts in by_line(batches):
            _, audit = next(parts)
            state = hashlib.sha256()
            for i, row in enumerate(repaired_rows(audit, parts)):
                state.update((("\n" if i else "") + row).encode("utf-8", "surrogatepass"))
            keys.append(k)
            found.append(state.hexdigest())
        if keys:
            yield pa.RecordBatch.from_pydict({"k": keys, "repaired_sha256": found})

    return dealt.mapInArrow(digest, "k string, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A row for every ``conv_id`` of ``conversations``: ``gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256`` of its ``rows`` (default:
    those that :func:`damaged` leaves)."""
    folder = shared_folder(conversations.sparkSession, "conversations")
    rows = damaged(conversations) if rows is None else rows
    lines = written(lines_of(rows, folder), folder, "judged")
    repairs = written(whole_conversations(written(fragments(lines), folder, "fragments")), folder, "repairs")
    gaps = lines.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")) \
        .select(conversation_key(F.col("conv_id")).alias("k"), "gaps")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("k", conversation_key(F.col("conv_id")))
    found = ids.join(repairs.drop("conv_id"), "k", "left").join(gaps, "k", "left").join(digests(rows, repairs), "k", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
