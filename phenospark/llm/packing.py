"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' token ids (ascending ``doc_id``).  A
window is a run of ``window_sequences`` sequences, W tokens.  In each window the
queues are served in a fixed order; queue k with weight w_k adds its quantum
W * w_k / sum(w) to its deficit and sends as many whole tokens as the deficit
has; the cut-off part of a token is carried to the next window.  So at every
window's end each queue is less than one token behind its target.  Documents are
cut where a quantum or a sequence ends; sequences are therefore full.

At the end of window n, queue k has sent floor(n * W * w_k / sum(w)) tokens: the
round-robin's state in closed form.  A token's place thus follows from its rank
in its queue: partitions need no state of each other but the number of tokens
before them, and the deficits carry across windows and partitions exactly, in
whole numbers of any size.

Weights default to the sources' token counts, so every window has the mixture of
the corpus.  With other weights a queue may run dry; the others then share its
part from there on (a new *phase* with the remaining weights), and nothing is
dropped.  The tokens of the last, partial sequence are cut into sequences whose
lengths are powers of two, so nothing is padded at all.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.common import doc_columns, in_doc_order, shared_folder, written
from phenospark.session import maybe_broadcast

ENCODED = "part int, source string, ordinal long, doc_id long, before long, n_tokens long, ids binary"
PIECES = ("doc_id long, source string, start long, length long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


@dataclass(frozen=True)
class Phase:
    """A stretch of the output in which the same queues have tokens: ``length``
    quanta of one token, shared by the weights."""

    start: int  # in the output
    length: int
    sent: dict  # source -> tokens it sent before
    weights: dict  # of the queues with tokens, in serving order
    total: int

    def quota(self, source, n: int) -> int:
        """What ``source`` has sent after ``n`` quanta."""
        return n * self.weights[source] // self.total

    def window(self, a: int, b: int) -> dict:
        """Place in the output of the first token that each source sends between ``a`` and ``b`` quanta."""
        at, out = self.start + sum(self.quota(s, a) for s in self.weights), {}
        for s in self.weights:
            out[s] = at
            at += self.quota(s, b) - self.quota(s, a)
        return out


def phases(counts: dict, weights: dict) -> list[Phase]:
    """Split the output where queues run dry.  ``counts``: source -> tokens;
    ``weights``: source -> whole number above 0."""
    out, start, sent = [], 0, dict.fromkeys(counts, 0)
    while active := {s: weights[s] for s in counts if counts[s] > sent[s]}:
        total = sum(active.values())
        length = min(-(-(counts[s] - sent[s]) * total // w) for s, w in active.items())
        phase = Phase(start, length, dict(sent), active, total)
        out.append(phase)
        for s in active:
            sent[s] += phase.quota(s, length)
            start += phase.quota(s, length)
    return out


class Layout:
    """Places of tokens in sequences, from their ranks in their queues."""

    def __init__(self, counts: dict, weights: dict, sequence: int, window_sequences: int):
        self.phases = phases(counts, weights)
        self.window = sequence * window_sequences
        self.sequence = sequence
        self.total = sum(counts.values())
        self.at, self.served = None, {}
        self.starts = {s: [p.sent.get(s, 0) for p in self.phases] for s in counts}
        # the partial last sequence, as (first token, sequence id) of each power of two
        self.full = self.total // sequence
        rest, at, self.tail = self.total % sequence, self.full * sequence, []
        while rest:
            size = 1 << (rest.bit_length() - 1)
            self.tail.append(at)
            at, rest = at + size, rest - size
        self.tail_end = at

    def place(self, at: int) -> tuple[int, int, int]:
        """(sequence id, offset, tokens to its end) of output position ``at``."""
        if at < self.full * self.sequence:
            return at // self.sequence, at % self.sequence, self.sequence - at % self.sequence
        k = bisect_right(self.tail, at) - 1
        end = self.tail[k + 1] if k + 1 < len(self.tail) else self.tail_end
        return self.full + k, at - self.tail[k], end - at

    def runs(self, source, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the run of ``n`` tokens from rank ``first``, length, sequence id, offset)."""
        done = 0
        while done < n:
            t = first + done
            k = bisect_right(self.starts[source], t) - 1
            p = self.phases[k]
            t -= p.sent[source]
            w = t * p.total // (p.weights[source] * self.window)  # token t is sent in this window or the next
            while p.quota(source, min((w + 1) * self.window, p.length)) <= t:
                w += 1
            a, b = w * self.window, min((w + 1) * self.window, p.length)
            if (k, w) != self.at:
                self.at, self.served = (k, w), p.window(a, b)
            at = self.served[source] + t - p.quota(source, a)
            length = min(n - done, p.quota(source, b) - t)
            while length:
                sequence_id, offset, room = self.place(at)
                take = min(length, room)
                yield done, take, sequence_id, offset
                done, at, length = done + take, at + take, length - take


def narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits if all of them fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else ids


def widen(data: bytes, n: int) -> bytes:
    return data if len(data) == 4 * n else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def encode_in_queues(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Ids of every document (``end_id`` appended) in ranges of (source, doc_id),
    written to the shared folder; ``before``: tokens of the source before it in
    its range.  A source that fills many ranges is many tasks."""
    def encode(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from phenospark.llm.encoding import encoder

        enc, end, part = encoder(tokenizer_path), struct.pack("<I", end_id), TaskContext.get().partitionId()
        at, before, n = None, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sources, doc_ids, texts = (c.to_pylist() for c in batch.slice(a, 256).columns)
                ids = [x + end for x in enc.ids(texts)]
                befores = []
                for s, x in zip(sources, ids, strict=True):
                    if s != at or n == 0:
                        at, before = s, 0
                    befores.append(before)
                    before, n = before + len(x) // 4, n + 1
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(ids), pa.int32()), "source": pa.array(sources, pa.string()),
                    "ordinal": pa.array(range(n - len(ids), n), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()),
                    "before": pa.array(befores, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array([narrow(x) for x in ids], pa.binary())})

    queued = in_doc_order(doc_columns(docs, "source").select(F.col("source").cast("string").alias("source"), "doc_id", "text"), "source")
    return written(queued.mapInArrow(encode, ENCODED), folder, "ids")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int, weights: dict | None = None,
         window_sequences: int = 64) -> DataFrame:
    """One row a piece, with its ids (``ids`` as little-endian unsigned 32-bit).

    ``weights``: source -> whole number above 0, the target proportions of
    tokens (default: the sources' token counts; a source left out gets 1).
    A null source is a queue of its own; a null or empty text is the end id
    alone; an empty table gives no pieces.  The queues' totals (a row a source)
    are the one thing the driver sees."""
    spark = docs.sparkSession
    ids = encode_in_queues(docs, tokenizer_path, end_id, shared_folder(spark, "packing"))
    ranges = ids.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"))
    by_range = ranges.withColumn("earlier", F.sum("tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("tokens"))
    counts = {r[0]: r[1] for r in ranges.groupBy("source").agg(F.sum("tokens")).orderBy(F.col("source").asc_nulls_last()).collect()}
    shares = {s: (counts[s] if weights is None else weights.get(s, 1)) for s in counts}
    layout = Layout(counts, shares, sequence, window_sequences)

    def cut(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = []
                for source, doc_id, rank, n, packed in zip(*(c.to_pylist() for c in batch.slice(a, 512).columns), strict=True):
                    data = widen(packed, n)
                    rows += [(doc_id, source, start, length, n, sequence_id, offset, data[4 * start:4 * (start + length)])
                             for start, length, sequence_id, offset in layout.runs(source, rank, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a row a (source, range), as many as ranges plus sources: broadcast while that is few, else a shuffled join
    placed = ids.alias("i").join(maybe_broadcast(by_range).alias("r"), F.col("i.source").eqNullSafe(F.col("r.source")) & (F.col("i.part") == F.col("r.part")))
    return placed.select("i.source", "i.doc_id", (F.col("r.earlier") + F.col("i.before")).alias("rank"), "i.n_tokens", "i.ids") \
        .mapInArrow(cut, PIECES)
