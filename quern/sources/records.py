"""TFRecord files of text features, as a table: framed records of length, checksums and a serialised example."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 0x7F) << shift
        i += 1
        if b[i - 1] < 0x80:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a message's fields."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def _first_bytes(feature: bytes) -> str | None:
    for number, value in _fields(feature):
        if number == 1:  # a list of byte strings
            for _, v in _fields(value):
                return v.decode()
    return None


def example_features(record: bytes) -> dict[str, str | None]:
    """The first byte string of each feature of a serialised example."""
    out = {}
    for _, features in _fields(record):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            out[parts[1].decode()] = _first_bytes(parts.get(2, b""))
    return out


def records(path: str) -> Iterator[bytes]:
    """The records of a file, one after the other; a file that ends within a record is an error."""
    with open(path, "rb") as f:
        while head := f.read(12):
            (n,) = struct.unpack("<Q", head[:8])
            body = f.read(n + 4)
            if len(body) < n + 4:
                raise ValueError(f"{path} ends within a record")
            yield body[:n]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], pattern: str):
        self.names, self.pattern = names, pattern

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob(self.pattern))]

    def read(self, partition: _File) -> Iterator[tuple]:
        for r in records(partition.path):
            features = example_features(r)
            yield tuple(features.get(n) for n in self.names)


class TextRecords(DataSource):
    """``format("text_records").load(pattern)`` on a file system that all workers mount: a part for each file, read record by record."""

    @classmethod
    def name(cls) -> str:
        return "text_records"

    def schema(self) -> str:
        return "id string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema.fieldNames(), self.options["path"])


def read_records(spark: SparkSession, pattern: str, schema: str = "id string, text string") -> DataFrame:
    spark.dataSource.register(TextRecords)
    return spark.read.format("text_records").schema(schema).load(pattern)
