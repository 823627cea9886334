"""Removal of repeated byte strings by column-wise suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts in a document
with a smaller ``doc_id`` is removed; strings are judged on the input.

1. The documents are written once as files of the shared folder; a byte's address
   is (file, place in the file's stream of texts).  All later passes read these
   files in sequence, and no text is ever shuffled.
2. Anchors: of every ``length`` bytes, the ``gram``-byte string with the least hash
   is an anchor; equal strings have equal anchors at equal places.  Anchors meet
   by hash, as packed arrays; an anchor seen once is done with.
3. A collection is the surroundings of all anchors of a range of hashes: every
   string of ``length`` bytes around an anchor lies in its *piece* of
   2 * length - gram bytes.  Each file sends a distinct piece once, with the
   smallest document that has it, so a passage that a third of all documents
   share is one row a file.
4. Column-wise construction: from the last column to the first, one symbol of
   each piece is inserted, which updates the collection's sorted order of
   suffixes (the order behind its Burrows-Wheeler transform: a stable sort by the
   inserted symbols) and its longest common prefixes (one more than the least
   prefix between the same neighbours before).  Wherever the prefixes reach
   ``length``, neighbours start with the same string; the smallest document among
   them is the answer for that column.
5. The answers go back to the files, which mark and cut the bytes.

Lost tasks are repeated from the files.  Buckets are as many as the shared
anchors need, so a task holds a bounded part.

Defined cases: a null text is empty; a null ``doc_id`` is larger than all others;
documents with one id don't count for each other; texts shorter than ``length``
are kept; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import by_key, doc_columns, file_system, partition_count, shared_folder, written

GRAM = 16
#: Bytes of text worked on at once; shared anchors in a bucket.
CHUNK, BUCKET = 1 << 20, 40_000
#: Documents in a file: what a task holds of one at a time.
FILE_DOCUMENTS = 4096
LAST = (1 << 63) - 1
#: Not a byte of UTF-8: stands between documents and beyond their ends.
OUTSIDE = 0xFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place (len - GRAM + 1 of them)."""
    n = len(data) - 7
    words = np.empty(n, dtype=np.uint64)
    for i in range(min(8, n)):  # the eight bytes from each place, as one number
        part = data[i:i + (n - i + 7) // 8 * 8]
        words[i::8] = part[:len(part) // 8 * 8].view("<u8")[:len(words[i::8])]
    return _mix(_mix(words[:-8]) + words[8:])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over ``width`` values from each place."""
    have, step = x, 1
    while step * 2 <= width:
        have = of(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return of(have[:-rest], have[rest:]) if rest else have


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a stream of texts with OUTSIDE between them."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data)
    width = length - GRAM + 1
    least = _sliding(h, width, np.minimum)  # of each string of `length` bytes
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = h == _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    outside = np.flatnonzero(data == OUTSIDE)
    if len(outside):
        beyond = (outside[:, None] - np.arange(GRAM)[None, :]).reshape(-1)
        chosen[beyond[(beyond >= 0) & (beyond < len(chosen))]] = False
    at = np.flatnonzero(chosen)
    return at, h[at]


def column_insertion(pieces: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """For each piece and each of its strings of ``length`` bytes, the smallest
    ``first`` of the pieces that have the string at the same column.

    ``order`` is the sorted order of the suffixes that start in the current
    column, ``lcp`` their common prefix with the one before."""
    n, columns = pieces.shape
    out = np.empty((n, columns - length + 1), dtype=np.int64)
    order = np.arange(n)
    lcp = np.zeros(n, dtype=np.int32)
    by_column = np.ascontiguousarray(pieces.T)  # one column a round, read in sequence
    for column in range(columns - 1, -1, -1):
        symbols = by_column[column][order]
        rank = np.argsort(symbols, kind="stable")  # insertion: by symbol, then by the order so far
        sorted_symbols = symbols[rank]
        same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        new = np.zeros(n, dtype=np.int32)
        if column == columns - 1:
            new[same] = 1
        elif len(same):
            low, high = rank[same - 1] + 1, rank[same] + 1
            bounds = np.empty(2 * len(same), dtype=np.int64)
            bounds[::2], bounds[1::2] = low, high
            # segments [low, high); a bound of n would lie outside: one value more at the end
            new[same] = np.minimum.reduceat(np.append(lcp, 0), bounds)[::2] + 1
        order, lcp = order[rank], new
        if column <= columns - length:
            starts = np.concatenate([[0], np.flatnonzero(lcp[1:] < length) + 1]) if n else np.empty(0, np.int64)
            least = np.minimum.reduceat(first[order], starts)
            sizes = np.diff(np.append(starts, n))
            out[order, column] = np.repeat(least, sizes)
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, by byte planes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += n * size
    return out


def _stream(file: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A file in chunks: (place of the chunk, its bytes, starts and ends of its
    documents, their ids).  A document is never cut."""
    import pyarrow.parquet as pq

    store, path = file_system(file)
    base, held, size, ids = 0, [], 0, []

    def chunk():
        data = np.frombuffer(b"\xff".join([*held, b""]), dtype=np.uint8)
        n = np.array([len(x) for x in held], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
        return base, data, starts, starts + n, np.array([LAST if i is None else i for i in ids], dtype=np.int64)

    with store.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=["doc_id", "data"]):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(t)
                ids.append(i)
                size += len(t) + 1
                if size >= CHUNK:
                    yield chunk()
                    base, held, size, ids = base + size, [], 0, []
    if held:
        yield chunk()


def _chunk_pieces(data, starts, ends, ids, at, length):
    """Pieces around the anchors ``at``: (bytes, document rows, first valid string, last valid string)."""
    reach = length - GRAM
    doc = np.searchsorted(starts, at, side="right") - 1
    first = at - reach
    low = np.maximum(0, starts[doc] - first)
    high = np.minimum(reach, ends[doc] - length - first)
    fits = low <= high
    at, doc, first, low, high = at[fits], doc[fits], first[fits], low[fits], high[fits]
    where = first[:, None] + np.arange(length + reach)[None, :]
    inside = (where >= starts[doc][:, None]) & (where < ends[doc][:, None])
    pieces = np.where(inside, data[np.clip(where, 0, len(data) - 1)], np.uint8(OUTSIDE)).astype(np.uint8)
    return pieces, doc, first, low, high


def _distinct(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows' first occurrences in sorted order, and each row's number."""
    rows = np.ascontiguousarray(pieces).view(np.dtype((np.void, pieces.shape[1]))).reshape(-1)
    _, index, inverse = np.unique(rows, return_index=True, return_inverse=True)
    return index, inverse.reshape(-1)


def _bucket(pieces: np.ndarray, reach: int, bits: int) -> np.ndarray:
    """The bucket of a piece: the first bits of its anchor's hash."""
    words = np.ascontiguousarray(pieces[:, reach:reach + GRAM]).view("<u8")
    h = _mix(_mix(words[:, 0]) + words[:, 1])
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def _file_pieces(file: str, places: np.ndarray, length: int):
    """All pieces of a file around the anchors ``places`` (ascending): per chunk
    what :func:`_chunk_pieces` gives, with the chunk itself."""
    done = 0
    for base, data, starts, ends, ids in _stream(file):
        stop = int(np.searchsorted(places, base + len(data)))
        yield (data, starts, ends, ids), _chunk_pieces(data, starts, ends, ids, (places[done:stop] - base).astype(np.int64), length)
        done = stop


def _table(columns: dict, kinds: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left) of every document."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = shared_folder(spark, "substrings")
    reach = length - GRAM
    texts = doc_columns(docs).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    texts.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_DOCUMENTS).parquet(f"{folder}/documents")
    files = written(spark.read.schema(texts.schema).parquet(f"{folder}/documents")
                    .groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("documents")), folder, "files")
    n_files = max(1, files.count())
    split = partition_count(docs)
    bits = max(4, (4 * split - 1).bit_length())
    packed = {"file": pa.string(), "bucket": pa.int64(), "n": pa.int64(), "data": pa.binary()}
    packed_sql = "file string, bucket long, n long, data binary"

    def find(batches) -> Iterator:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                at, hashes, n = [], [], 0
                for base, data, *_ in _stream(file):
                    a, h = anchors(data, length)
                    at.append(a.astype(np.uint64) + np.uint64(base))
                    hashes.append(h)
                    n += len(a)
                    if n > 2_000_000:
                        yield from parts(file, np.concatenate(at), np.concatenate(hashes))
                        at, hashes, n = [], [], 0
                if n:
                    yield from parts(file, np.concatenate(at), np.concatenate(hashes))

    def parts(file, at, hashes) -> Iterator:
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        for k in range(0, len(spans), 64):
            some = spans[k:k + 64]
            yield _table({"file": [file] * len(some), "bucket": [int(bucket[a]) for a, _ in some], "n": [b - a for a, b in some],
                          "data": [_pack(np.diff(hashes[a:b], prepend=np.uint64(0)), at[a:b]) for a, b in some]}, packed)

    def shared(batches) -> Iterator:
        for bucket, held in by_key(batches, "bucket"):
            hashes, places, owner, names = [], [], [], []
            for b in held:
                for file, n, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    steps, at = _unpack(data, n, "<u8", "<u8")
                    hashes.append(np.cumsum(steps, dtype=np.uint64))
                    places.append(at)
                    owner.append(np.full(n, len(names), dtype=np.int32))
                    names.append(file)
            h, at, own = np.concatenate(hashes), np.concatenate(places), np.concatenate(owner)
            order = np.argsort(h, kind="stable")
            equal = h[order][1:] == h[order][:-1]
            keep = np.zeros(len(h), dtype=bool)
            keep[order[1:][equal]] = True
            keep[order[:-1][equal]] = True
            cols: dict = {"file": [], "bucket": [], "n": [], "data": []}
            for k, file in enumerate(names):
                rows = slice(int(np.searchsorted(own, k)), int(np.searchsorted(own, k, side="right")))  # owners lie in order
                mine = np.sort(at[rows][keep[rows]])
                if len(mine):
                    cols["file"].append(file)
                    cols["bucket"].append(bucket)
                    cols["n"].append(len(mine))
                    cols["data"].append(_pack(np.diff(mine, prepend=np.uint64(0))))
            if cols["n"]:
                yield _table(cols, packed)

    found = files.select("file").repartition(n_files).mapInArrow(find, packed_sql)
    candidates = written(found.repartition(split, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, packed_sql), folder, "candidates")
    total = candidates.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fine = max(4, (max(total // BUCKET, 4 * split) - 1).bit_length())

    def places_of(held) -> np.ndarray:
        got = [np.cumsum(_unpack(data, n, "<u8")[0], dtype=np.uint64) for b in held
               for kind, n, data in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if kind == 1]
        return np.unique(np.concatenate(got)) if got else np.empty(0, np.uint64)

    def collection(file: str, places: np.ndarray):
        """The file's distinct pieces by (bucket, bytes), and each occurrence's number among them."""
        all_pieces, docs_at = [], []
        for (_, _, _, ids), (pieces, doc, *_) in _file_pieces(file, places, length):
            all_pieces.append(pieces)
            docs_at.append(ids[doc])
        if not all_pieces or not sum(map(len, all_pieces)):
            return None
        pieces, owners = np.concatenate(all_pieces), np.concatenate(docs_at)
        index, inverse = _distinct(pieces)
        first = np.full(len(index), LAST, dtype=np.int64)
        np.minimum.at(first, inverse, owners)
        bucket = _bucket(pieces[index], reach, fine)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return pieces[index[order]], first[order], bucket[order], place[inverse]

    def send(batches) -> Iterator:
        for file, held in by_key(batches, "file"):
            made = collection(file, places_of(held))
            if made is None:
                continue
            pieces, first, bucket, _ = made
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            for k in range(0, len(spans), 64):
                some = spans[k:k + 64]
                import zstandard

                packer = zstandard.ZstdCompressor(level=1)
                yield _table({"file": [file] * len(some), "bucket": [int(bucket[a]) for a, _ in some], "n": [b - a for a, b in some],
                              "data": [packer.compress(first[a:b].tobytes() + pieces[a:b].tobytes()) for a, b in some]}, packed)

    def construct(batches) -> Iterator:
        import zstandard

        unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for bucket, held in by_key(batches, "bucket"):
            names, sizes, firsts, pieces = [], [], [], []
            for b in held:
                for file, n, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    raw = unpacker.decompress(data)
                    names.append(file)
                    sizes.append(n)
                    firsts.append(np.frombuffer(raw, np.int64, n))
                    pieces.append(np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, -1))
            answer = column_insertion(np.concatenate(pieces), np.concatenate(firsts), length)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            yield _table({"file": names, "bucket": [bucket] * len(names), "n": sizes,
                          "data": [packer.compress(np.ascontiguousarray(answer[a:b].T).tobytes())
                                   for a, b in zip(cuts, cuts[1:], strict=False)]}, packed)

    tagged = lambda df, kind: df.select("file", F.lit(kind).alias("kind"), "bucket", "n", "data")
    asked = tagged(candidates, 1).repartition(n_files, "file").sortWithinPartitions("file")
    answers = written(asked.mapInArrow(send, packed_sql).repartition(split, "bucket").sortWithinPartitions("bucket")
                      .mapInArrow(construct, packed_sql), folder, "answers")

    def cut(batches) -> Iterator:
        import zstandard

        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        unpacker = zstandard.ZstdDecompressor()
        for file, held in by_key(batches, "file"):
            places = places_of(held)
            replies = sorted((bucket, n, data) for b in held for kind, bucket, n, data in zip(
                *(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True) if kind == 2)
            made = collection(file, places) if replies else None
            number = made[3] if made else None
            least = np.concatenate([np.frombuffer(unpacker.decompress(data), np.int64).reshape(-1, n).T
                                    for _, n, data in replies]) if replies else None
            done = 0
            for (data, starts, ends, ids), (pieces, doc, first, low, high) in _file_pieces(file, places, length):
                begins = np.zeros(len(data) + 1, dtype=bool)
                if len(pieces):
                    mine = least[number[done:done + len(pieces)]]
                    done += len(pieces)
                    for o in range(reach + 1):
                        hit = (mine[:, o] < ids[doc]) & (low <= o) & (o <= high)
                        begins[first[hit] + o] = True
                reached = np.cumsum(begins[:-1], dtype=np.int64)
                covered = reached.copy()
                covered[length:] -= reached[:-length] if len(reached) > length else 0
                covered = covered > 0
                rows: dict = {k: [] for k in kinds}
                for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    gone = covered[a:b]
                    rows["doc_id"].append(None if i == LAST else i)
                    rows["n_bytes"].append(b - a)
                    rows["n_removed"].append(int(gone.sum()))
                    rows["n_spans"].append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
                    rows["kept"].append(data[a:b][~gone].tobytes())
                yield _table(rows, kinds)

    every = files.select("file", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"),
                         F.lit(None).cast("binary").alias("data"))
    return every.unionByName(tagged(candidates, 1)).unionByName(tagged(answers, 2)) \
        .repartition(n_files, "file").sortWithinPartitions("file") \
        .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
