"""Cross-tokenizer alignment by external spill counting.

Two tokenizers, A and B, cut the same bytes (a space and the text).  Byte offsets
where tokens of both end cut a text into groups; every A token of a group is
linked with every B token of it.  An id pair's count is the number of documents
that hold it linked.

1. A task encodes its documents and gathers (pair, document, links) records.
   Records over a bound are sorted *side-major* (all pairs of an A id in a row),
   radix-partitioned by the low bits of the A id, and spilled as one run: a file
   of zstd frames, for each radix one of heads (pair, documents) and one of
   bodies (document, links).  A document lies in one run whole.
2. For each radix a heap merges the heads of up to ``FAN`` runs and adds the
   counts; merged runs are merged again until one is left.  In side-major order
   all pairs of an A id pass in a row, so its maximum is known when the next id
   comes; pairs are written with their count and whether it is the maximum.
3. Contributions stream back: a task takes whole runs, reads the counted pairs of
   one radix after another and adds them up for the documents of its runs.

A pair that lies in a third of all documents is one head a run, and its bodies
stay in their runs, so no task holds all its documents.  Counting shuffles names
and offsets of frames only.

A is encoded by pre-tokens, B by units cut before each run of spaces (checked on
load: no piece has a space behind another character, so pieces end there too); both are
looked up in a bounded cache first.  Groups and links of a
batch of texts come from its token ends by array operations.

Defined cases: null and empty texts, and texts that a tokenizer does not give
back (a literal U+2581), have no tokens: zeros and an empty ``groups``.  Repeated
rows are documents of their own; a null ``doc_id`` is kept; an empty table gives
no rows; further columns are ignored.  A run ends with the document that takes it
over the bound, so a very long document makes a longer run.
"""

from __future__ import annotations

import heapq
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import doc_columns, file_system, partition_count, shared_folder, written
from phenospark.llm.encoding import _LETTERS, Encoder

#: Radix partitions: low bits of the A id.
RADIX_BITS = 6
RADIXES = 1 << RADIX_BITS
#: Runs merged at once, and runs whose contributions a task adds up at most (on average).
FAN = 64
#: Links in a run (8 bytes each, before equal ones of a document are counted), and documents.
RUN_LINKS = 6_000_000
RUN_DOCUMENTS = 1 << 20
#: Links that are expanded at once.
STRIP_LINKS = 2_000_000
#: Texts, and their characters, that are aligned at once.
BATCH, BATCH_CHARS = 256, 1 << 20
#: Bits of an id and of a document's place in its run.
ID_BITS, DOC_BITS = 20, 24
#: Bound of the cache of B's units in a Python worker (about 250 bytes an entry).
CACHE_UNITS = 300_000

_UNITS = re.compile(" +[^ ]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
_SPACE = "▁"

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "n_best long, count_sum long")
RUNS = "path string, n_docs long, docs_at array<long>, heads_at array<long>, bodies_at array<long>"
MERGED = "radix int, path string, at long, size long"

_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Tokens, groups and links of texts under a byte-level vocabulary
    (``tokenizers`` file) and a SentencePiece model with byte fallback."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = Encoder(byte_level, cache_entries=CACHE_UNITS)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.a.special = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        n_a, n_b = max(vocabulary.values()) + 1, len(names)
        if any(_SPACE in n.lstrip(_SPACE) for n in names) or max(n_a, n_b) > 1 << ID_BITS:
            raise ValueError("pieces with a space inside, or a vocabulary over 2**20, can't be aligned")
        if not {chr(c) for c in _LETTERS.values()} <= vocabulary.keys() or self.a.tokenizer.normalizer:
            raise ValueError("the first vocabulary does not keep every byte")
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.match(n)) else n.replace(_SPACE, " ").encode()
                        for i, n in enumerate(names)]
        letters = {chr(c): b for b, c in _LETTERS.items()}
        self.a_bytes = [b""] * n_a
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # a token's id as it is spelled before a comma, and at its group's end on its side
        self.spelled = [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for end in ends]
        self.packed = packed_ids(np.arange(n_a, dtype=np.uint64)) << np.uint64(ID_BITS)
        self.lone_space = [self.b.piece_to_id(_SPACE)]
        self.cache: dict[str, bytes | None] = {}

    def b_ids(self, texts: list[str]) -> list[bytes | None]:
        """B's ids of each text (which is not empty), unsigned 32-bit; None where
        they don't give its bytes back."""
        cuts = [[u[1:] for u in _UNITS.findall(" " + t)] if "  " in t or t[0] == " " else t.split(" ") for t in texts]
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        new = list(set().union(*cuts) - self.cache.keys())
        for u, ids in zip(new, self.b.encode(new, num_threads=1), strict=True):
            ids = ids if u else self.lone_space
            whole = b"".join([self.b_bytes[i] for i in ids]) == (" " + u).encode()
            self.cache[u] = array("I", ids).tobytes() if whole else None
        get = self.cache.__getitem__
        found = [list(map(get, cut)) for cut in cuts]
        return [None if None in ids else b"".join(ids) for ids in found]

    def aligned(self, texts: list[str]) -> Aligned:
        """Tokens, groups and links of a batch of texts."""
        full = [i for i, t in enumerate(texts) if t]
        right = dict(zip(full, self.b_ids([texts[i] for i in full]), strict=True))
        places = [i for i in full if right[i] is not None]
        left = self.a.ids([" " + texts[i] for i in places])
        a, b = ([np.frombuffer(x, np.uint32) for x in ids] for ids in (left, [right[i] for i in places]))
        # B's bytes are the text's; A's tokens keep every byte they read, so equal lengths say that they read all
        same = [k for k in range(len(places)) if self.a_sizes[a[k]].sum() == self.b_sizes[b[k]].sum()]
        return Aligned(self, len(texts), [places[k] for k in same], [a[k] for k in same], [b[k] for k in same])


class Aligned:
    """A batch of ``n`` texts; ``places`` are those that have tokens, with their ids ``a`` and ``b``."""

    def __init__(self, of: Aligner, n: int, places: list[int], a: list[np.ndarray], b: list[np.ndarray]):
        self.of, self.n = of, n
        counts = np.zeros((2, n), np.int64)
        counts[0, places], counts[1, places] = [len(x) for x in a], [len(x) for x in b]
        self.n_a, self.n_b = counts
        self.a, self.b = (np.concatenate(x) if x else np.empty(0, np.uint32) for x in (a, b))
        # ends count on through the batch: a text's bytes are the same on both sides
        ends_a, ends_b = np.cumsum(of.a_sizes[self.a]), np.cumsum(of.b_sizes[self.b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 0
        both = np.zeros(size, np.uint8)
        both[ends_a] += 1
        both[ends_b] += 1
        common = np.flatnonzero(both == 2)
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(common)) for g in (self.group_a, self.group_b))
        last = np.cumsum(self.in_a) - 1  # each group's last A token tells its text
        self.doc_a = np.repeat(np.arange(n), self.n_a)
        self.group_doc = self.doc_a[last]
        self.n_groups = np.bincount(self.group_doc, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.group_doc, self.in_a * self.in_b)

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text; '' without tokens."""
        import hashlib

        ends_group = [np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (self.group_a, self.group_b)]
        out = np.empty(len(self.a) + len(self.b), np.int64)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]
        out[at_a] = 2 * self.a.astype(np.int64) + ends_group[0]
        out[at_b] = 2 * len(self.of.a_bytes) + 2 * self.b.astype(np.int64) + ends_group[1]
        found, start, table = [], 0, self.of.spelled.__getitem__
        for size in (self.n_a + self.n_b).tolist():
            state = hashlib.sha256()
            for at in range(start, start + size, 1 << 18):  # a very long text is spelled in parts
                end = min(at + (1 << 18), start + size)
                text = "".join(map(table, out[at:end].tolist()))
                state.update((text[:-1] if end == start + size else text).encode())
            found.append(state.hexdigest() if size else "")
            start += size
        return found

    def links(self, first: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(pair and document, packed; how often, None for once each) of all links,
        in strips; documents are numbered from ``first``."""
        sizes = self.in_a * self.in_b
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        docs = (self.group_doc + first).astype(np.uint64)
        reach, at = np.cumsum(sizes), 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + STRIP_LINKS, "right")))
            a0, a1 = start_a[at], start_a[end - 1] + self.in_a[end - 1]
            if end == at + 1 and sizes[at] > STRIP_LINKS:  # one group without common ends for long: distinct ids only
                (x, n), (y, m) = (np.unique(t[s:s + k], return_counts=True) for t, s, k in (
                    (self.a, start_a[at], self.in_a[at]), (self.b, start_b[at], self.in_b[at])))
                for i in range(0, len(x), max(1, STRIP_LINKS // len(y))):
                    part = slice(i, i + max(1, STRIP_LINKS // len(y)))
                    pairs = self.of.packed[x[part]][:, None] | y[None, :].astype(np.uint64)
                    yield (pairs << np.uint64(DOC_BITS) | docs[at]).ravel(), (n[part][:, None] * m[None, :]).astype(np.uint64).ravel()
            else:
                group = self.group_a[a0:a1]
                times = self.in_b[group]
                # each A token beside every B token of its group
                b = np.arange(times.sum()) + np.repeat(start_b[group] - (np.cumsum(times) - times), times)
                pairs = np.repeat(self.of.packed[self.a[a0:a1]], times) | self.b[b].astype(np.uint64)
                yield pairs << np.uint64(DOC_BITS) | np.repeat(docs[group], times), None
            at = end


def packed_ids(a: np.ndarray) -> np.ndarray:
    """A ids with their radix on top, so that packed pairs sort radix-major and, within a radix, side-major."""
    return (a & np.uint64(RADIXES - 1)) << np.uint64(ID_BITS - RADIX_BITS) | a >> np.uint64(RADIX_BITS)


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The worker's aligner of two vocabularies; kept between tasks."""
    if (byte_level, pieces) not in _ALIGNERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


class Frames:
    """A file of zstd frames, written in sequence."""

    def __init__(self, folder: str, name: str):
        import zstandard

        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        # a fresh name an attempt: what a lost attempt wrote is never read
        self.uri = f"{folder}/{name}-{uuid.uuid4().hex}"
        self.out = store.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}")
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.at = 0

    def add(self, *columns: np.ndarray | bytes) -> int:
        """Writes one frame; returns where it ends."""
        data = self.zstd.compress(b"".join(c if isinstance(c, bytes) else c.tobytes() for c in columns))
        self.out.write(data)
        self.at += len(data)
        return self.at


def read_frame(uri: str, at: int, size: int) -> bytes:
    import zstandard

    store, path = file_system(uri)
    with store.open_input_file(path) as f:
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


def heads_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of a frame of heads."""
    n = len(data) // 16
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint64, n, 8 * n)


class Run:
    """Links of the documents read so far, spilled as one file."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.once: list[np.ndarray] = []
        self.many: list[tuple[np.ndarray, np.ndarray]] = []
        self.links = 0

    def add(self, doc_ids: list[int | None], batch: Aligned) -> None:
        for packed, times in batch.links(len(self.docs)):
            self.links += len(packed)
            if times is None:
                self.once.append(packed)
            else:
                self.many.append((packed, times))
        self.docs += zip(doc_ids, *[x.tolist() for x in (batch.n_a, batch.n_b, batch.n_groups, batch.n_links)], batch.digests(), strict=True)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair and document, its links), ascending, once each."""
        sort = np.concatenate(self.once) if self.once else np.empty(0, np.uint64)
        self.once = []
        sort.sort()
        first = np.flatnonzero(np.diff(sort, prepend=sort[:1] ^ np.uint64(1)))
        links, sort = np.diff(first, append=len(sort)).astype(np.uint64), sort[first]
        if self.many:
            sort, links = np.concatenate([sort, *[x[0] for x in self.many]]), np.concatenate([links, *[x[1] for x in self.many]])
            order = np.argsort(sort, kind="stable")
            sort, links = sort[order], links[order]
            first = np.flatnonzero(np.diff(sort, prepend=sort[:1] ^ np.uint64(1)))
            sort, links = sort[first], np.add.reduceat(links, first)
        return sort, links

    def spill(self, folder: str) -> tuple:
        """Sorts and writes the run; returns its row of ``RUNS``."""
        import pyarrow as pa

        sort, links = self.counted()
        pairs = sort >> np.uint64(DOC_BITS)
        docs = (sort & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
        heads = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] ^ np.uint64(1)))
        n_docs = np.diff(heads, append=len(pairs)).astype(np.uint64)
        bounds = np.searchsorted(pairs[heads], np.arange(RADIXES + 1, dtype=np.uint64) << np.uint64(2 * ID_BITS - RADIX_BITS))
        files = Frames(folder, "run")
        with files.out:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*self.docs, strict=True), [*[pa.int64()] * 5, pa.string()], strict=True)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            docs_at, heads_at, bodies_at = [0, files.add(sink.getvalue().to_pybytes())], [], []
            heads_at.append(files.at)
            for a, b in zip(bounds, bounds[1:], strict=False):
                heads_at.append(files.add(pairs[heads[a:b]], n_docs[a:b]))
            bodies_at.append(files.at)
            for a, b in zip(bounds, bounds[1:], strict=False):
                lo, hi = (heads[i] if i < len(heads) else len(pairs) for i in (a, b))
                bodies_at.append(files.add(docs[lo:hi], links[lo:hi]))
        return files.uri, len(self.docs), docs_at, heads_at, bodies_at


def spilled(docs: DataFrame, byte_level: str, pieces: str, folder: str, run_links: int) -> DataFrame:
    """A row a run that the tasks wrote to ``folder``."""
    def make(batches) -> Iterator:
        import pyarrow as pa

        align = aligner(byte_level, pieces)
        row = lambda run: pa.RecordBatch.from_pylist(
            [dict(zip(("path", "n_docs", "docs_at", "heads_at", "bodies_at"), run.spill(folder), strict=True))])
        run = Run()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < BATCH and size < BATCH_CHARS:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1])
                run.add(batch.column(0).slice(at, len(texts)).to_pylist(), align.aligned(texts))
                at += len(texts)
                if run.links >= run_links or len(run.docs) >= RUN_DOCUMENTS:
                    yield row(run)
                    run = Run()
        if run.docs:
            yield row(run)

    return doc_columns(docs).mapInArrow(make, RUNS)


def merged_heads(frames: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """Heap merge of frames of heads: (pair, count), ascending, counts of equal pairs added."""
    def items(data: bytes) -> Iterator[tuple[int, int]]:
        pairs, counts = heads_of(data)
        for a in range(0, len(pairs), 1024):
            yield from zip(pairs[a:a + 1024].tolist(), counts[a:a + 1024].tolist(), strict=True)

    at, total = -1, 0
    for pair, n in heapq.merge(*map(items, frames)):
        if pair != at:
            if total:
                yield at, total
            at, total = pair, 0
        total += n
    if total:
        yield at, total


def with_maxima(counted: Iterable[tuple[int, int]]) -> tuple[list[int], list[int], list[bool]]:
    """Pairs, counts and whether a count is the highest of the pair's A id, which is known once the next id comes."""
    pairs, counts, best = [], [], []
    side, start = -1, 0
    for pair, n in counted:
        if pair >> ID_BITS != side:
            top = max(counts[start:], default=0)
            best += [c == top for c in counts[start:]]
            side, start = pair >> ID_BITS, len(counts)
        pairs.append(pair)
        counts.append(n)
    top = max(counts[start:], default=0)
    best += [c == top for c in counts[start:]]
    return pairs, counts, best


def merge_level(frames: DataFrame, groups: int, folder: str) -> DataFrame:
    """Merges the frames (``MERGED``) of each radix in ``groups`` groups, a task each; the last level marks maxima."""
    last = groups == 1

    def merge(batches) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for radix, group, path, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault((radix, group), []).append((path, at, size))
        for (radix, _), parts in sorted(held.items()):
            counted = merged_heads(read_frame(*p) for p in parts)
            columns = with_maxima(counted) if last else tuple(zip(*counted, strict=True)) or ((), ())
            files = Frames(folder, f"counts-{radix}")
            with files.out:
                size = files.add(*(np.array(c, t) for c, t in zip(columns, (np.uint64, np.uint64, np.uint8), strict=False)))
            yield pa.RecordBatch.from_pydict({"radix": pa.array([radix], pa.int32()), "path": [files.uri],
                                              "at": pa.array([0], pa.int64()), "size": pa.array([size], pa.int64())})

    dealt = frames.select("radix", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int").alias("grp"), "path", "at", "size")
    return dealt.repartition(min(RADIXES * groups, 20_000), "radix", "grp").mapInArrow(merge, MERGED)


def token_alignment(docs: DataFrame, byte_level: str, pieces: str, run_links: int = RUN_LINKS, fan: int = FAN) -> DataFrame:
    """A row a document: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256``
    (of ``a1,a2|b1;a3|b2,b3``), ``n_best`` (links whose pair has the highest count
    of its A id) and ``count_sum`` (over links).  ``byte_level`` and ``pieces`` are
    paths that every executor can read."""
    folder = shared_folder(docs.sparkSession, "alignment")
    runs = written(spilled(docs, byte_level, pieces, f"{folder}/runs", run_links), folder, "index")
    n_runs = runs.count()
    ends = F.arrays_zip(F.slice("heads_at", 1, RADIXES).alias("at"), F.slice("heads_at", 2, RADIXES).alias("end"))
    level = runs.select("path", F.posexplode(ends).alias("radix", "x")).select(
        "radix", "path", F.col("x.at").alias("at"), (F.col("x.end") - F.col("x.at")).alias("size"))
    groups, step = n_runs, 0
    while groups > 1 or not step:
        groups, step = max(1, -(-groups // fan)), step + 1
        level = written(merge_level(level, groups, f"{folder}/merged-{step}"), folder, f"level-{step}")
    counted = {r.radix: (r.path, r.at, r.size) for r in level.collect()}  # a row a radix: 64 at most

    def stream_back(batches) -> Iterator:
        import pyarrow as pa

        held = [r for b in batches for r in b.to_pylist()]  # names and offsets of some ``fan`` runs
        sums = [np.zeros((2, r["n_docs"]), np.uint64) for r in held]
        for radix in range(RADIXES if held else 0):
            data = read_frame(*counted[radix])
            pairs, counts = (np.frombuffer(data, np.uint64, len(data) // 17, k * (len(data) // 17 * 8)) for k in (0, 1))
            best = np.frombuffer(data, np.uint8, len(pairs), 16 * len(pairs))
            for r, total in zip(held, sums, strict=True):
                own, n_docs = heads_of(read_frame(r["path"], r["heads_at"][radix], r["heads_at"][radix + 1] - r["heads_at"][radix]))
                if not len(own):
                    continue
                body = read_frame(r["path"], r["bodies_at"][radix], r["bodies_at"][radix + 1] - r["bodies_at"][radix])
                n = len(body) // 12
                doc, links = np.frombuffer(body, np.uint32, n), np.frombuffer(body[4 * n:], np.uint64)
                at = np.repeat(np.searchsorted(pairs, own), n_docs.astype(np.int64))
                # sums of one document: exact in integers, so not by weighted float counts
                order = np.argsort(doc, kind="stable")
                doc, links, at = doc[order], links[order], at[order]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                total[0, doc[first]] += np.add.reduceat(links * best[at], first)
                total[1, doc[first]] += np.add.reduceat(links * counts[at], first)
        for r, total in zip(held, sums, strict=True):
            data = read_frame(r["path"], r["docs_at"][0], r["docs_at"][1])
            batch = pa.ipc.open_stream(data).read_all().combine_chunks()
            n_best, count_sum = (pa.array(t.astype(np.int64)) for t in total)
            table = batch.append_column("n_best", n_best).append_column("count_sum", count_sum)
            yield from table.to_batches()

    tasks = max(1, -(-n_runs // fan), min(n_runs, partition_count(docs)))
    return runs.repartition(tasks).mapInArrow(stream_back, ALIGNED)
