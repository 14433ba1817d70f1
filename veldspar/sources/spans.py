"""Reading span files, the single-file storage of collections that came before.

A file is a row of spans, each with a length and a CRC-32:

    magic (4 bytes)  length (4)  sequence (varint)  size of the id (varint)  id
    number of streams (1)  {stream number (1)  size (varint)  bytes}  padding  CRC-32 (4)

Numbers are big-endian; a varint has seven bits a byte, the high ones first, and a set top
bit where more follow. Stream 0 is metadata, stream 1 the packed vector. The record with
the empty id has the collection's options. Of spans with one id the highest sequence
counts; those with the magic FREE are gone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..collection import Collection, CollectionOptions
from ..functions import quantization, vectors
from ..operators import records

ACTIVE, FREE = 0x5350414E, 0x46524545
LEAST = 12
SCHEMA = "file string, position long, sequence long, record_id string, metadata binary, vector binary, error string"


def write_varint(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it); ValueError if the bytes end first."""
    n = 0
    while at < len(data):
        n, more = n << 7 | data[at] & 0x7F, data[at] & 0x80
        at += 1
        if not more:
            return n, at
    raise ValueError("a number is cut off")


def write_span(record_id: str, streams: dict[int, bytes], sequence: int, padding: int = 0, magic: int = ACTIVE) -> bytes:
    name = record_id.encode()
    body = write_varint(sequence) + write_varint(len(name)) + name + bytes([len(streams)])
    body += b"".join(bytes([k]) + write_varint(len(v)) + v for k, v in streams.items()) + bytes(padding)
    head = struct.pack(">II", magic, len(body) + 12) + body
    return head + struct.pack(">I", zlib.crc32(head))


def write_file(uri: str, data: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_span(data: bytes) -> tuple[str, int, dict[int, bytes]]:
    """(id, sequence, streams) of an active span; ValueError if it isn't as it should be."""
    if struct.unpack(">I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("the checksum differs")
    data = data[:-4]
    sequence, at = read_varint(data, 8)
    size, at = read_varint(data, at)
    name, at = data[at : at + size].decode("utf-8", "replace"), at + size
    if at >= len(data):
        raise ValueError("the span is cut off")
    streams, count, at = {}, data[at], at + 1
    for _ in range(count):
        if at >= len(data):
            raise ValueError("a stream is missing")
        size, begin = read_varint(data, at + 1)
        if begin + size > len(data):
            raise ValueError("a stream is cut off")
        streams[data[at]], at = data[begin : begin + size], begin + size
    return name, sequence, streams


def spans(stream: BinaryIO) -> Iterator[tuple[int, tuple[str, int, dict[int, bytes]] | None, str | None]]:
    """(position, span, what is wrong) of a file's active spans. One that is damaged is passed
    by its length; where that can't be, the file has no further spans."""
    position = 0
    while len(head := stream.read(8)) == 8:
        magic, length = struct.unpack(">II", head)
        if magic not in (ACTIVE, FREE) or length < LEAST:
            if magic:  # zeros are room that was never used
                yield position, None, "no span begins here"
            return
        rest = stream.read(length - 8)
        if magic == ACTIVE:
            try:
                if len(rest) < length - 8:
                    raise ValueError("the file ends within the span")
                yield position, read_span(head + rest), None
            except ValueError as problem:
                yield position, None, str(problem)
        position += length


class _File(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(self.path)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):
            return
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        rows, size = [], 0
        with fs.open_input_stream(path, compression=None) as stream:
            for position, span, error in spans(stream):
                name, sequence, streams = span or (None, None, {})
                rows.append((partition.uri, position, sequence, name, streams.get(0), streams.get(1), error))
                size += 100 + sum(map(len, streams.values()))
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


class SpanFile(DataSource):
    """spark.read.format("span_file").load(uri): a row for each active span of a file."""

    @classmethod
    def name(cls) -> str:
        return "span_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_spans(spark: SparkSession, uri: str) -> DataFrame:
    """The rows of a span file; ``uri`` with its scheme, or an absolute local path."""
    spark.dataSource.register(SpanFile)
    return spark.read.format("span_file").load(uri if "://" in uri else f"file://{uri}")


def import_spans(spark: SparkSession, root: str, name: str, uri: str, **kwargs) -> Collection:
    """A collection of a span file's records. Damaged spans are left out; without a readable
    header, or with an id that is no number, nothing is imported."""
    found = records.latest(read_spans(spark, uri).where("error IS NULL").withColumnRenamed("record_id", "id"), "sequence")
    header = found.where("id = ''").select("metadata").first()
    if header is None:
        raise ValueError(f"{uri} has no header")
    asked = json.loads(bytes(header.metadata))
    method = asked["distance_method"]
    options = CollectionOptions(name, method if isinstance(method, str) else vectors.METHODS[method], asked["dimension_count"], asked.get("quantization", 64))
    d, bits = options.dimension_count, options.quantization

    @F.pandas_udf("array<double>")
    def codes(packed: pd.Series) -> pd.Series:
        return pd.Series([quantization.unpack(bytes(p), d, bits).astype(float).tolist() if p is not None else None for p in packed], dtype="object")

    vector = quantization.dequantize(codes(F.col("vector")), bits)
    made = Collection.open(spark, root, options, "create_and_overwrite", **kwargs)
    made.upsert(found.where("id <> ''").select(F.col("id").cast("long").alias("id"), vector.alias("vector"), F.col("metadata").cast("string").alias("metadata")))
    return made
