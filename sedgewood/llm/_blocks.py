"""Packing documents into compressed blocks, and the exchange of block digests.

A block holds consecutive rows of one input task, all columns, as one compressed Arrow stream.  Operators that must
compare every document with every other exchange sorted digests of blocks, not text: each block sends one run per
bucket, a bucket's task merges the runs of all blocks, and each block gets an answer.  Equal entries of one block are
sent once, so a passage that fills a third of the corpus costs a bucket one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgewood.llm._text import buffers

BLOCK_BYTES = 2 << 20


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_table(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return squeeze(sink.getvalue().to_pybytes())


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(unsqueeze(data))).read_all()


def packed(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block_id, payload): the rows of df in blocks of about block_bytes of text, dealt evenly by block_id.

    A block also ends after 20,000 rows; a longer text is a block of its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, rows, seq
            table = pa.Table.from_batches(held).combine_chunks()
            out = pa.record_batch({"block_id": pa.array([base + seq], pa.int64()), "payload": pa.array([pack_table(table)], pa.binary())})
            held, size, rows, seq = [], 0, 0, seq + 1
            return out

        for batch in batches:
            _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
            i, n = 0, batch.num_rows
            while i < n:
                room = block_bytes - size
                j = int(np.searchsorted(offsets, offsets[i] + room, "right")) - 1
                j = min(max(j, i + (size == 0)), n, i + 20_000 - rows)
                if j > i:
                    held.append(batch.slice(i, j - i))
                    size, rows, i = size + int(offsets[j] - offsets[i]), rows + j - i, j
                if i < n or size >= block_bytes or rows >= 20_000:
                    yield flush()
        if held:
            yield flush()

    n = partitions(df.sparkSession)
    return df.mapInArrow(pack, "block_id long, payload binary").repartition(n, "block_id")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; the number of buckets follows it, so a bucket's size is steady."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n buckets that Spark's hash partitioning deals to a partition of its own."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    rows = spark.range(64 * n).groupBy(place.alias("p")).agg(F.min("id").alias("label")).collect()
    label = {r["p"]: r["label"] for r in rows}
    # a partition that none of 64 n numbers goes to shares one; nothing depends on it but balance
    return [label.get(p, 64 * n + p) for p in range(n)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, front-coded: their differences, byte planes apart."""
    gaps = np.diff(values, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return squeeze(len(values).to_bytes(8, "little") + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as one compressed value."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), a.tobytes()]
    return squeeze(b"".join(parts), 1)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw, at, out = unsqueeze(data), 0, []
    while at < len(raw):
        dtype = np.dtype(raw[at : at + 8].strip().decode())
        n = int.from_bytes(raw[at + 8 : at + 16], "little")
        out.append(np.frombuffer(raw, dtype, n, at + 16))
        at += 16 + n * dtype.itemsize
    return out


def rows(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)
