"""Archives of typed entries (type, length, value), readable and writable as Spark data sources.

A file is a run of entries: a type of two bytes, a length of four, two reserved bytes, all
little-endian, then the value. The writer makes one file for each partition, committed by renaming, and ends
it with an index: the place of each entry, then their number. The reader cuts files at multiples of a size; a
part finds the entries that begin in its range by the index and reads those bytes only, so many tasks read one
file and an entry across a cut is read once. A file without an index is read by the part with its beginning. With the option framing=snappy,
values (but for those of the version and the index) are framed snappy streams in the file and plain in rows.
"""

from __future__ import annotations

import os
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .framing import framed, unframed

HEAD = struct.Struct("<HIH")
# Entry types.
VERSION, INDEX, HEADER, BODY, RECEIPTS = 0x3265, 0x3266, 0x03, 0x04, 0x05
#: Bytes of a part of a file.
SPLIT = 16 << 20
SCHEMA = "file string, position long, kind int, value binary"


def entries(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(position, type, value) of each entry; data that ends within one is an error."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"entry at {at} has no full head")
        kind, length, reserved = HEAD.unpack_from(data, at)
        if reserved or at + HEAD.size + length > len(data):
            raise ValueError(f"entry at {at} is broken")
        yield at, kind, data[at + HEAD.size : at + HEAD.size + length]
        at += HEAD.size + length


def entry(kind: int, value: bytes) -> bytes:
    return HEAD.pack(kind, len(value), 0) + value


def index(positions: list[int]) -> bytes:
    """The last entry of a file: where each other one begins, and how many they are."""
    return entry(INDEX, struct.pack(f"<{len(positions) + 1}q", *positions, len(positions)))


def bounds(file, size: int, start: int, end: int) -> tuple[int, int]:
    """The bytes of the entries that begin within a range of a file; a file without an index lies in its first range."""
    if size >= HEAD.size + 8:
        count = struct.unpack("<q", file.read_at(8, size - 8))[0]
        at = size - HEAD.size - 8 * (count + 1)
        if 0 <= at and 0 <= count and HEAD.unpack(file.read_at(HEAD.size, at)) == (INDEX, 8 * (count + 1), 0):
            places = [*struct.unpack(f"<{count}q", file.read_at(8 * count, at + HEAD.size)), at]
            return places[min(bisect_left(places, start), count)], places[min(bisect_left(places, end), count)]
    return (0, size) if start == 0 else (0, 0)


def _known(framing: str) -> str:
    if framing not in ("", "snappy"):
        raise ValueError(f"unknown framing {framing!r}")
    return framing


class Part(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT, framing: str = ""):
        self.path, self.split, self.framing = path, split, _known(framing)

    def partitions(self):
        fs, base = pafs.FileSystem.from_uri(self.path)
        files = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and f.path.endswith(".tlv")]
        return [Part(f.path, f.size, at, at + self.split) for f in files for at in range(0, f.size, self.split)] or [Part("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            first, last = bounds(file, partition.size, partition.start, partition.end)
            for at, kind, value in entries(file.read_at(last - first, first)):
                yield os.path.basename(partition.path), first + at, kind, unframed(value) if self.framing and kind not in (VERSION, INDEX) else value


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, framing: str = ""):
        self.path, self.framing = path, _known(framing)

    def write(self, iterator):
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        with fs.open_output_stream(name + ".part") as out:
            places, at = [], 0
            for kind, value in chain([(VERSION, b"")], ((row["kind"], bytes(row["value"])) for row in iterator)):
                places.append(at)
                at += out.write(entry(kind, framed(value) if self.framing and kind not in (VERSION, INDEX) else value))
            out.write(index(places))
        return Written([name])

    def commit(self, messages):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(name + ".part", name + ".tlv")

    def abort(self, messages):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(name + ".part")


class ArchiveSource(DataSource):
    """spark.dataSource.register(ArchiveSource); then format("archive") with a folder's URI."""

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("framing", ""))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], self.options.get("framing", ""))


def export_headers(headers: DataFrame, path: str, blocks_per_file: int = 8192, framing: str = "") -> None:
    """Headers as JSON entries, so many blocks to a file at most, each file in block order."""
    headers.sparkSession.dataSource.register(ArchiveSource)
    value = F.encode(F.to_json(F.struct(*headers.columns)), "UTF-8")
    files = F.floor(F.col("number") / blocks_per_file)
    n = headers.agg(F.max("number")).first()[0]
    parts = headers.repartitionByRange(max(1, (n or 0) // blocks_per_file + 1), files).sortWithinPartitions("number")
    parts.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("position"), F.lit(HEADER).alias("kind"), value.alias("value")).write.format("archive").option("framing", framing).mode("append").save(path)


def import_headers(spark, path: str, schema: str, framing: str = "") -> DataFrame:
    """Back from such an archive."""
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive").option("framing", framing).load(path).where(F.col("kind") == HEADER)
    return rows.select(F.from_json(F.decode("value", "UTF-8"), schema).alias("h")).select("h.*")
