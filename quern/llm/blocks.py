"""Blocks of documents, blobs of numbers and the exchange between blocks and buckets.

Several operators must compare every document with every other one by hash.  Shuffling one row
per hash would cost tens of bytes for each, so they send *blobs*: a task packs its documents into
blocks of bounded size, sorts the hashes of a block and sends compressed arrays of them (:mod:`quern.llm.exchange`).
A bucket's reducer answers each block by position in what the block sent.  A block is bounded by bytes, and a hash
that a block holds a thousand times is sent once.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.order import kept
from quern.sources.corpus import spread

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_GOLD = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors cost nothing."""
    return kept(df)


# ---------------------------------------------------------------- hashes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(30))) * _GOLD
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


#: A random 64-bit number for each byte, so that polynomial hashes modulo 2**64 have no short relations.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
#: The same with A-Z taken as a-z.
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for i, b in enumerate((_BASE, inverse)):
            a = np.full(m, b, U64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


class PrefixHash:
    """Polynomial prefix hashes of a byte string: the hash of any substring in constant time.

    ``phase`` gives each byte its exponent where the string is made of short parts, so that no more powers are needed
    than the longest part has bytes; substrings then lie within a part.
    """

    def __init__(self, data: np.ndarray, code: np.ndarray = BYTE_CODE, phase: np.ndarray | None = None):
        n = len(data)
        self.phase = phase
        p, self.inv = powers(n + 1 if phase is None else int(phase.max(initial=0)) + 2)
        self.pre = np.zeros(n + 1, U64)
        for i in range(0, n, 1 << 18):  # a piece at a time, so that only the sums are as long as the text
            j = min(n, i + (1 << 18))
            np.cumsum(code[data[i:j]] * (p[i:j] if phase is None else p[phase[i:j]]), out=self.pre[i + 1 : j + 1])
            self.pre[i + 1 : j + 1] += self.pre[i]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.pre[start + length] - self.pre[start]) * self.inv[start if self.phase is None else self.phase[start]]


# ---------------------------------------------------------------- blobs


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; bytes of equal weight stand together."""
    out = [len(arrays).to_bytes(2, "little")]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        size = a.dtype.itemsize
        kind = a.dtype.str.encode()
        raw = a.view(np.uint8).reshape(-1, size).T.tobytes() if size > 1 and len(a) else a.tobytes()
        out.append(len(kind).to_bytes(1, "little") + kind + len(a).to_bytes(8, "little"))
        body.append(raw)
    return zstandard.compress(b"".join(out) + b"".join(body), level)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, kinds = int.from_bytes(raw[:2], "little"), 2, []
    for _ in range(n):
        k = raw[at]
        kinds.append((np.dtype(raw[at + 1 : at + 1 + k].decode()), int.from_bytes(raw[at + 1 + k : at + 9 + k], "little")))
        at += 9 + k
    out = []
    for dtype, m in kinds:
        size = dtype.itemsize
        a = np.frombuffer(raw, np.uint8, m * size, at)
        out.append(a.reshape(size, m).T.copy().view(dtype).reshape(-1) if size > 1 and m else a.view(dtype))
        at += m * size
    return out


# ---------------------------------------------------------------- documents


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES, most_rows: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text and ``most_rows`` rows at most (ranks in a block have 20 bits), a row at least."""
    off, _ = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + most_rows, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``, dealt out if it comes in fewer parts than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


class Block:
    """Documents of a block in ascending order of id; a missing id stands after all others."""

    NO_ID = np.iinfo(np.int64).max

    def __init__(self, ids: np.ndarray, has_id: np.ndarray, has_text: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.ids, self.has_id, self.has_text, self.offsets, self.data = ids, has_id, has_text, offsets, data

    @classmethod
    def of(cls, ids: pa.Array, text: pa.Array) -> Block:
        has = np.asarray(ids.is_valid())
        values = np.where(has, np.asarray(ids.cast(pa.int64()).fill_null(cls.NO_ID)), cls.NO_ID).astype(np.int64)
        order = np.argsort(values, kind="stable")
        off, data = text_buffers(text.take(pa.array(order)) if len(order) else text)
        block = cls(values[order], has[order], np.asarray(text.is_valid())[order], off, data)
        block.order = order
        return block

    def blob(self) -> bytes:
        return pack(self.ids, self.has_id, self.has_text, self.offsets, self.data, level=5)

    @classmethod
    def from_blob(cls, blob: bytes) -> Block:
        return cls(*unpack(blob))

    def texts(self, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
        """Texts of the block's documents, null where they were."""
        valid = np.packbits(self.has_text, bitorder="little")
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ids), [pa.py_buffer(valid), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        return binary.cast(pa.large_string()).cast(pa.string())


BLOCKS = "block long, n_bytes long, payload binary, others binary"


def _written(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def read_others(raw: bytes) -> pa.Table:
    """The other columns of a block's documents."""
    return pa.ipc.open_stream(zstandard.decompress(raw)).read_all()


def to_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Documents as a durable table of blocks: ``block, n_bytes, payload``, and if asked the ``others`` of their columns."""
    rest = [c for c in docs.columns if c not in (doc_id, text)] if carry else []

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1, block_bytes):
                b = Block.of(piece.column(0), piece.column(1))
                others = _written(piece.select(range(2, piece.num_columns)).take(pa.array(b.order))) if carry else None
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([len(b.data)], pa.int64()), pa.array([b.blob()], pa.binary()), pa.array([others], pa.binary())], ["block", "n_bytes", "payload", "others"])
                seq += 1

    return durable(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"other_{i}") for i, c in enumerate(rest)]).mapInArrow(pack_blocks, BLOCKS))


def restored(out: DataFrame, like: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns that blocks carried (``doc_id, text, other_0`` ..) under the names, types and order of ``like``."""
    rest = iter([c for c in like.columns if c not in (doc_id, text)])
    names = {doc_id: "doc_id", text: "text"} | {c: f"other_{i}" for i, c in enumerate(rest)}
    return out.select([F.col(names[f.name]).cast(f.dataType).alias(f.name) for f in like.schema])


def carried_schema(like: DataFrame, doc_id: str = "doc_id", text: str = "text") -> str:
    rest = [f for f in like.schema if f.name not in (doc_id, text)]
    return ", ".join(["doc_id long", "text string", *(f"other_{i} {f.dataType.simpleString()}" for i, f in enumerate(rest))])


def bucket_count(n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return int(max(16, -(-int(n_bytes) // bucket_bytes)))


def give_back() -> None:
    """Lets the operating system have what earlier groups have freed; workers are used again and again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def rows(batch_or_table) -> Iterator[dict]:
    """Rows of an Arrow batch one after the other."""
    give_back()
    columns = batch_or_table.schema.names
    for i in range(batch_or_table.num_rows):
        yield {c: batch_or_table.column(j)[i].as_py() for j, c in enumerate(columns)}


def batch(schema: pa.Schema, found: list[tuple]) -> pa.RecordBatch:
    """Tuples as an Arrow batch."""
    columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(schema: pa.Schema, found: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(schema, found)], schema)
