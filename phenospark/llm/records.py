"""Token ids in length-delimited binary records, with a separate offset index.

A data file is a run of records, each framed as

    8 bytes  length of the payload, little-endian
    4 bytes  masked CRC-32 of those 8 bytes
    payload
    4 bytes  masked CRC-32 of the payload

so that a reader finds damage before it trusts a length.  A payload is one
sequence: 1 byte (bytes of a token id, 2 or 4; plus 128 if the document id is
null), 8 bytes signed document id, then its token ids, little-endian unsigned.
Sequences whose ids all fit take 2 bytes an id.  The index file beside it holds the offset
of every record as little-endian unsigned 64-bit: a shuffled read draws entries
of the index and reads single records.

The checksum is the CRC-32 of :mod:`zlib` under the usual mask of such files
(rotate right by 15, add a constant), because that is the one the standard
library computes in native code.

Each task writes files under names of its own (range number and a random part);
only the files named in the manifest count.  What a lost task attempt has left
is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.common import doc_columns, file_system, in_doc_order, shared_folder, written

#: Fixed value of the masking rule.
MASK_DELTA = 0xA282EAD8

MANIFEST = "part int, file string, index string, n_records long, n_tokens long, n_bytes long"
SEQUENCE = "part int, ordinal long, doc_id long, start long, n_tokens long, ids binary"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))])


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; damage raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("damaged record")
    return body[:n]


def to_payload(doc_id: int | None, ids: bytes) -> bytes:
    """``ids``: little-endian unsigned 32-bit."""
    import numpy as np

    wide = np.frombuffer(ids, dtype="<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    return struct.pack("<Bq", width + 128 * (doc_id is None), doc_id or 0) + wide.astype(f"<u{width}").tobytes()


def from_payload(payload: bytes) -> tuple[int | None, bytes]:
    import numpy as np

    kind, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, dtype=f"<u{kind & 127}", offset=9).astype("<u4")
    return (None if kind & 128 else doc_id), ids.tobytes()


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the sequences in
    ascending ``doc_id`` order; returns the manifest (one row a file, ``part``
    in that order).

    Null texts are empty (only the end id); null ids come last; rows that share
    an id follow each other; an empty table gives an empty manifest."""
    def write(batches) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from phenospark.llm.encoding import encoder

        enc, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        out, offsets, tokens, at = None, [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                for doc_id, ids in zip(rows.column(0).to_pylist(), enc.ids(rows.column(1).to_pylist()), strict=True):
                    if out is None:
                        store, path = file_system(name + ".rec")
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path)
                    record = frame(to_payload(doc_id, ids + end))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(ids) // 4 + 1
        if out is not None:
            out.close()
            with store.open_output_stream(path[:-4] + ".idx") as index:
                index.write(struct.pack(f"<{len(offsets)}Q", *offsets))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name + ".rec"], "index": [name + ".idx"],
                                              "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})

    return written(in_doc_order(doc_columns(docs)).mapInArrow(write, MANIFEST), folder, "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """All sequences of the manifest's files: rank of the file, rank in it,
    ``start`` (tokens before it in all files) and ids.  Every checksum is verified."""
    def read(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                            ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for part, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = file_system(file)
                held = n = 0
                rows: list[tuple] = []
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = from_payload(payload)
                        rows.append((part, n, doc_id, start, len(ids) // 4, ids))
                        start, n, held = start + len(ids) // 4, n + 1, held + len(ids)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # one row a file: the running sum is over files, never over documents
    files = manifest.select("part", "file", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("start"))
    return _dealt(files).mapInArrow(read, SEQUENCE)


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """The same sequences in an order drawn by ``seed``, through the index files:
    entries are dealt and sorted by a hash, records are read singly by offset."""
    def entries(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = file_system(index)
                with store.open_input_stream(path) as stream:
                    offsets = np.frombuffer(stream.read(), dtype="<u8").astype("int64")
                for a in range(0, len(offsets), 1 << 16):
                    x = offsets[a:a + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(x), pa.string()), "offset": pa.array(x, pa.int64())})

    def read(batches) -> Iterator:
        import pyarrow as pa

        opened: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ranks, got = [], []
                for rank, file, offset in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    if file not in opened:
                        while len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        store, path = file_system(file)
                        opened[file] = store.open_input_file(path)
                    opened[file].seek(offset)
                    ranks.append(rank)
                    got.append(from_payload(read_frame(opened[file])))
                yield pa.RecordBatch.from_pydict({"rank": pa.array(ranks, pa.int64()), "doc_id": pa.array([x[0] for x in got], pa.int64()),
                                                  "ids": pa.array([x[1] for x in got], pa.binary())})
        for f in opened.values():
            f.close()

    index = _dealt(manifest.select("file", "index")).mapInArrow(entries, "file string, offset long")
    drawn = index.withColumn("rank", F.xxhash64(F.lit(seed), "file", "offset"))
    return drawn.repartitionByRange("rank").sortWithinPartitions("rank", "file", "offset") \
        .select("rank", "file", "offset").mapInArrow(read, "rank long, doc_id long, ids binary")


def _dealt(files: DataFrame) -> DataFrame:
    """One file a task, as far as there are tasks: rows name files, so they
    weigh more than their bytes tell."""
    n = max(1, files.count())
    return files.repartition(n)


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write and read back; per document ``doc_id``, ``start`` (ids before it in
    ascending id order), ``n_tokens`` and ``ids``."""
    folder = shared_folder(docs.sparkSession, "records")
    return read_records(write_records(docs, tokenizer_path, folder, end_id)).select("doc_id", "start", "n_tokens", "ids")
