"""WARC archives in seekable Zstandard bundles.

Pages are grouped into bundles (one file a task and size bound).  In a bundle,
records lie in frames of about ``frame_bytes``, each an independent Zstandard
frame, and a skippable frame at the end holds the seek table of the public
seekable format: per frame its compressed and decompressed size, then the number
of frames, a descriptor byte and a magic number.  A reader takes the last 9
bytes, then the table, and from there any frame alone.  The index maps a record
to (bundle, frame, offset in the decompressed frame).

Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
largest id is a *response*; the others are *revisits* that name it and hold no
payload.  Equality is that of SHA-1, length and a 64-bit hash.

Task attempts write under names of their own and only bundles in the index
count, so a lost executor leaves nothing that is read.

Defined cases: a null payload is empty; a null id is an id of its own, smaller
than all others; pages that share both the payload and the largest id are all
responses; further columns are ignored; an empty table gives no bundles.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import file_system, shared_folder, written

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Extension field with the length of the full payload; archive readers skip fields they don't know.
LENGTH_FIELD = "X-Payload-Length"

#: Decompressed bytes that a task reads back.
TASK_BYTES = 16 << 20

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, url, payload, digest, n_bytes, refers_to`` (null: a response).

    Copies are found on digests alone, counted before they are shuffled.  What a
    page refers to goes back by its own id, so a payload with any number of copies
    is never the key that payloads are dealt by."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = base.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"),
                        F.xxhash64("payload").alias("hash"))
    content = ["digest", "n_bytes", "hash"]
    bare = keyed.select("page_id", *content).filter(F.col("n_bytes") >= least_bytes)
    same = bare.groupBy(*content).agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("refers_to")).filter("copies > 1").drop("copies")
    later = bare.join(same, content).filter(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))) < F.col("refers_to")) \
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("hash").alias("h"), "refers_to").distinct()
    return keyed.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("hash") == F.col("h")), "left") \
        .select("page_id", "url", "payload", "digest", "n_bytes", "refers_to")


def to_record(date: str, page_id, url, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record.  A revisit has no block; its digest is in the header, and its
    full length in an extension field."""
    clean = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}",
            f"WARC-Payload-Digest: sha1:{digest}", f"{LENGTH_FIELD}: {n_bytes}"]
    if url is None:
        del head[4]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def from_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(header fields, block, where the record ends)."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(line.split(": ", 1) for line in lines)
    start, n = end + 4, int(fields["Content-Length"])
    if data[start + n:start + n + 4] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return fields, data[start:start + n], start + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, decompressed) sizes of all frames."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of an open bundle."""
    stream.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC or descriptor & 0x80:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", stream.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    if at + 8 + 8 * n + 9 != size:
        raise ValueError("damaged seek table")
    return out


def write_bundles(pages: DataFrame, folder: str, least_bytes: int, frame_bytes: int = 1 << 18,
                  bundle_bytes: int = 1 << 28, level: int = 3, date: str | None = None) -> DataFrame:
    """Write all pages; returns the index (a row a record).  ``date`` (default: the
    time of the call) is the records' ``WARC-Date``."""
    from datetime import UTC, datetime

    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches) -> Iterator:
        import uuid

        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        packer = zstandard.ZstdCompressor(level=level)
        part, index = TaskContext.get().partitionId(), []
        out, name, frames, held, n, size = None, "", [], [], 0, 0

        def frame() -> int:
            data = b"".join(held)
            packed = packer.compress(data)
            out.write(packed)
            frames.append((len(packed), len(data)))
            held.clear()
            return len(packed)

        def close() -> None:
            if held:
                frame()
            out.write(seek_table(frames))
            out.close()

        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, 128).columns), strict=True):
                    if out is None:
                        name = f"{folder}/bundle-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                        store, path = file_system(name)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out, frames, size = store.open_output_stream(path, compression=None), [], 0
                    record = to_record(date, *row)
                    index.append((row[0], name, len(frames), n, len(record)))
                    held.append(record)
                    n += len(record)
                    if n >= frame_bytes:
                        size, n = size + frame(), 0
                        if size >= bundle_bytes:
                            close()
                            out = None
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*index, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                        names=["page_id", "bundle", "frame", "offset", "length"])
                    index = []
        if out is not None:
            close()

    return written(roles(pages, least_bytes).mapInArrow(write, INDEX), folder, "index")


def read_bundles(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """All records of the index, each by its place: frames are dealt to as many tasks
    as their bytes ask for, neighbours together; a task reads a bundle's seek table
    once and from there its frames, and takes each record at its offset."""
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "page_id"))).alias("records"),
                                                  F.sum("length").alias("plain"))  # records of one frame: bounded by its size
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))

    def read(batches) -> Iterator:
        import hashlib

        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None  # noqa: E731  <urn:page:N>
        opened, table, f = None, [], None
        for batch in batches:
            for a in range(batch.num_rows):
                bundle, frame, records = (batch.column(i)[a].as_py() for i in range(3))
                if bundle != opened:
                    if f:
                        f.close()
                    store, path = file_system(bundle)
                    f, opened = store.open_input_file(path), bundle
                    table = read_seek_table(f, f.size())
                start, packed, plain = table[frame]
                f.seek(start)
                data = unpacker.decompress(f.read(packed), max_output_size=plain)
                rows = []
                for r in records:
                    h, block, end = from_record(data, r["offset"])
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h[LENGTH_FIELD])
                    full = h["WARC-Type"] == "response"
                    page_id = number(h["WARC-Record-ID"])
                    if full and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
                        raise ValueError("damaged payload")
                    if page_id != r["page_id"] or end - r["offset"] != r["length"]:
                        raise ValueError("the index names another record")
                    rows.append((page_id, h.get("WARC-Target-URI"), h["WARC-Type"], digest, n, number(h.get("WARC-Refers-To")), block if full else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if f:
            f.close()

    dealt = frames.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return dealt.select("bundle", "frame", "records").mapInArrow(read, RECORD)


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record by its index entry: seek table, one frame, one record."""
    import zstandard

    store, path = file_system(bundle)
    with store.open_input_file(path) as f:
        start, packed, plain = read_seek_table(f, f.size())[frame]
        f.seek(start)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    return from_record(data, offset)[:2]


def archived(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Write and read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, least_bytes))
