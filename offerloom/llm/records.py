"""Token-ID files: length-delimited records with masked checksums, and an offset index.

A record is ``length (8 bytes) | masked checksum of the length | payload | masked checksum
of the payload``, all numbers little-endian. The checksum is CRC-32, turned right by
15 bits with a constant added, so that a checksum of data that holds checksums is safe.
A payload is a flag (1: a doc_id follows, 0: it is null), the doc_id in 8 bytes and the
ids in 2 bytes each. The index beside a file holds the 8-byte offset of each record, so
a reader can fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerloom.llm.common import new_folder, staged
from offerloom.llm.encode import crc_of_ids, encoder, slices

END_ID = 0
_HEAD, _CRC = "<QI", "<I"
_HEAD_SIZE, _CRC_SIZE = 12, 4
_MASK_DELTA = 0xA282EAD8
_READ = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack(_CRC, masked(length)), payload, struct.pack(_CRC, masked(payload))])


def unframe(buffer: bytes, at: int) -> tuple[bytes, int]:
    """The payload at ``at`` and the place after it; a wrong checksum is an error."""
    length, crc = struct.unpack_from(_HEAD, buffer, at)
    if masked(buffer[at : at + 8]) != crc:
        raise ValueError("a record's length is damaged")
    begin = at + _HEAD_SIZE
    payload = buffer[begin : begin + length]
    if len(payload) != length or masked(payload) != struct.unpack_from(_CRC, buffer, begin + length)[0]:
        raise ValueError("a record is damaged")
    return payload, begin + length + _CRC_SIZE


def to_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids.astype("<u2").tobytes()


def from_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id = struct.unpack_from("<Bq", payload)
    return (doc_id if known else None), np.frombuffer(payload, "<u2", offset=9)


def read_records(path: str, order: Iterable[int] | None = None) -> Iterator[tuple]:
    """``(doc_id, ids)`` of a file in its own order or in the order of given places."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{name}.idx") as index:
        offsets = np.frombuffer(index.read(), "<u8")
    with system.open_input_file(name) as data:
        if order is not None:
            for place in order:
                data.seek(int(offsets[place]))
                head = data.read(_HEAD_SIZE)
                rest = data.read(struct.unpack(_HEAD, head)[0] + _CRC_SIZE)
                yield from_payload(unframe(head + rest, 0)[0])
            return
        ends = np.append(offsets[1:], data.size()).astype(np.int64)
        at = 0
        while at < len(ends):
            base = int(offsets[at])
            to = max(at + 1, int(np.searchsorted(ends, base + _READ, "right")))
            data.seek(base)
            buffer, place = data.read(int(ends[to - 1]) - base), 0
            for _ in range(at, to):
                payload, place = unframe(buffer, place)
                yield from_payload(payload)
            at = to


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, keeps_spaces: bool) -> DataFrame:
    """Encode ``text`` of all rows and write one file per range of ``doc_id``.

    Returns ``(shard, path, records, tokens)``. Rows are ordered by doc_id over all files,
    null ids first and equal ids in the order of their texts; a null text counts as
    empty, and every row gets the end id. A task writes under a name of its own and
    renames at the end, so a task that runs twice leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, data, offsets, at, tokens = encoder(tokenizer, keeps_spaces), None, [], 0, 0
        context = TaskContext.get()
        shard = context.partitionId()
        path = f"{folder}/tokens-{shard:06d}.rec"
        system, name = fs.FileSystem.from_uri(path)
        own = f"{name}.{context.taskAttemptId()}"
        end = np.array([END_ID], np.uint16)
        for batch in batches:
            for part in slices(batch, "text"):
                if part.num_rows == 0:
                    continue
                if data is None:
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    data = system.open_output_stream(own)
                ids, bounds = tool.encode(part.column("text"))
                out = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own_ids = np.concatenate([ids[bounds[i] : bounds[i + 1]], end])
                    out.append(frame(to_payload(doc_id, own_ids)))
                    offsets.append(at)
                    at += len(out[-1])
                    tokens += len(own_ids)
                data.write(b"".join(out))
        if data is None:
            return
        data.close()
        with system.open_output_stream(f"{own}.idx") as index:
            index.write(np.array(offsets, "<u8").tobytes())
        system.move(f"{own}.idx", f"{name}.idx")
        system.move(own, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [path], "records": [len(offsets)], "tokens": [tokens]}
        )

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(write, "shard long, path string, records long, tokens long")


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all files that ``write_token_files`` named.

    ``start`` counts the ids of all documents before. One row per file passes through the
    ordered window, one task reads one file.
    """
    order = Window.orderBy("shard")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select(
        (F.row_number().over(order) - 1).alias("place"),
        "path",
        F.coalesce(before, F.lit(0)).alias("first"),
    )
    count = max(1, files.count())
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, rows, held = row["first"], [], 0
                for doc_id, ids in read_records(row["path"]):
                    rows.append((doc_id, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    held += 2 * len(ids)
                    if held > _READ or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                        )
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                    )

    dealt = placed.repartitionById(count, F.col("place").cast("int"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def with_crc(sequences: DataFrame) -> DataFrame:
    """Replace ``ids`` (2 bytes each) by the CRC-32 of the same ids in 4 bytes each."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [crc_of_ids(np.frombuffer(x, "<u2")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("doc_id", "start", "n_tokens")], pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return sequences.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, keeps_spaces: bool) -> DataFrame:
    """Write all documents, read the files back and describe each document's record."""
    folder = new_folder(spark, "token-files")
    files = staged(write_token_files(docs, folder, tokenizer, keeps_spaces), "token-shards")
    return with_crc(read_token_files(files))
