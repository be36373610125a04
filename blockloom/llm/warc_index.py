"""WARC archives with a two-level capture index.

Writing: each task appends its records, one gzip member each, to archives of its own in the shared
folder and reports where each record lies; only the archives that a finished task reports are read,
so a task that is run again does no harm. Index: entries (reversed-host URL key, page, archive,
offset, length) are sorted by range partitioning and written as compressed blocks; the sparse
directory holds one row per block with its first and last key, and the part (task) that wrote it.

Looking up any number of URLs is a Spark job: their distinct keys are dealt to the parts of the index by
bisecting the parts' key ranges (as many as tasks wrote the index), the keys of a part meet its
directory rows sorted, each key bisects the directory, the block's byte range is read once for all keys
in it, and each key bisects the block's entries. Records are then read by byte ranges, neighbours in an
archive together. Blocks without a wanted key are not opened.

Of records with equal payloads of at least `least` bytes the one with the largest page id is a
response and the others revisit it. Defined results: null html is an empty payload, a null url an
empty key; null ids rank below every other id, and a group with no id at all has only responses;
rows that repeat the id of the response are responses too; html of any length is one record; URLs with one
and the same key share their captures, and a key that is asked for several times gives them once; an
empty table gives no archives, and look-ups in an empty directory find nothing; other columns, whatever
they are called, are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_dir, text_or_empty, written

LEAST_BYTES, ENTRIES_PER_BLOCK, ARCHIVE_BYTES, RANGE_GAP, RANGE_BYTES = 1000, 1000, 256 << 20, 64 << 10, 8 << 20

ENTRY = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
DIRECTORY = T.StructType([
    T.StructField("first_key", T.StringType()), T.StructField("last_key", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("entries", T.LongType()), T.StructField("part", T.IntegerType()),
])
CAPTURE = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.Example.org:80/A?q -> org,example)/a?q."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:  # no URL at all: sorted by what stands there
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return (key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared location: local or mounted folders, or any URI that Arrow opens."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Files:
    """Append-only files of one task attempt, each closed at about so many bytes."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.fs, self.base = _store(folder)
        self.folder, self.suffix, self.limit, self.out, self.name, self.at = folder, suffix, limit, None, "", 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            file = uuid.uuid4().hex + self.suffix
            self.fs.create_dir(self.base, recursive=True)
            self.out, self.name, self.at = self.fs.open_output_stream(f"{self.base}/{file}", compression=None), f"{self.folder}/{file}", 0
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member; a revisit has no block."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest.hex()]))}>", "WARC-Date": date,
        "WARC-Target-URI": "".join((url or "").split()), "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(), "X-Payload-Length": str(len(payload)),
        "X-Page-ID": "" if page_id is None else str(page_id), **({"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)} if refers_to is not None else {}),
        "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block)),
    }
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 3, mtime=0)


def parsed(member: bytes) -> dict:
    """Back from a gzip member; the digest of a response's payload is worked out again and compared."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and hashlib.sha1(block).digest() != digest:
        raise ValueError(f"the payload of page {fields['X-Page-ID']} doesn't match its digest")
    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
    return {
        "page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None, "payload": block,
    }


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per page below folder; returns the entries (materialised).

    Payloads are compared by length and SHA-256. The largest id of each is found by a partial
    aggregation; only payloads that occur twice or more come to the join with the pages, and
    adaptive execution splits the partition of a payload with very many copies.
    """
    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    # Small payloads get a key of their own (16 bytes, not 32), so that they don't meet in the partition of null.
    own = F.unhex(F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url")))
    slim = slim.withColumn("same", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))).otherwise(own))
    groups = slim.where(F.length("payload") >= least).groupBy("same").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "response")
    chosen = slim.join(groups, "same", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz", ARCHIVE_BYTES)
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                member = record(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to, date)
                rows.append((url_key(url), page_id, *files.append(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=ENTRY.names)
        files.close()

    return written(chosen.mapInArrow(write, ENTRY))


def build_index(entries: DataFrame, folder: str, per_block: int = ENTRIES_PER_BLOCK) -> DataFrame:
    """Writes the sorted, compressed blocks below folder; returns their directory (materialised)."""
    ordered = entries.repartitionByRange("key", F.xxhash64("archive", "offset")).sortWithinPartitions("key", "page_id", "archive", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, rows, part = _Files(folder, ".cdx", ARCHIVE_BYTES), [], [], TaskContext.get().partitionId()

        def block() -> None:
            data = zlib.compress(json.dumps(held).encode(), 6)
            rows.append((held[0][0], held[-1][0], *files.append(data), len(data), len(held), part))
            held.clear()

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(entry)
                if len(held) == per_block:
                    block()
        if held:
            block()
        files.close()
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=DIRECTORY.names)

    return written(ordered.mapInArrow(write, DIRECTORY))


def _range(path: str, offset: int, length: int) -> bytes:
    fs, at = _store(path)
    with fs.open_input_file(at) as file:
        file.seek(offset)
        return file.read(length)


def read_block(file: str, offset: int, length: int) -> list[list]:
    """The entries of one block, read by its byte range."""
    return json.loads(zlib.decompress(_range(file, offset, length)))


_ENTRY_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def _dealt(directory: DataFrame, urls: DataFrame, url_col: str) -> DataFrame:
    """part, key: the distinct keys of the URLs, each with the parts of the index whose range holds it (materialised)."""
    schema = T.StructType([T.StructField("key", T.StringType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column(0).to_pylist()), pa.string())], names=["key"])

    ranges = sorted(map(tuple, directory.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).select("lo", "hi", "part").collect()))  # a row for each task of the index
    lows, highs, parts = ([r[k] for r in ranges] for k in range(3))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(parts[k], key) for key in batch["key"].to_pylist() for k in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["part", "key"])

    keys = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keyed, schema).distinct()
    return written(keys.mapInArrow(deal, T.StructType([T.StructField("part", T.IntegerType()), *schema.fields])))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of wanted keys, from rows that come sorted: a part's directory, then the keys wanted of it."""
    part, firsts, lasts, spots = None, [], [], []
    at, entries, found = -1, [], []
    for batch in batches:
        for p, wanted, key, last, *spot in zip(*(batch[c].to_pylist() for c in ("part", "wanted", "key", "last_key", "file", "offset", "length"))):
            if p != part:
                part, firsts, lasts, spots, at = p, [], [], [], -1
            if not wanted:
                firsts.append(key)
                lasts.append(last)
                spots.append(spot)
                continue
            for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                if k != at:
                    at, entries = k, read_block(*spots[k])
                begin = bisect.bisect_left(entries, key, key=lambda e: e[0])
                while begin < len(entries) and entries[begin][0] == key:
                    found.append(entries[begin])
                    begin += 1
                if len(found) >= 5000:
                    yield _entry_batch(found)
                    found = []
    yield _entry_batch(found)


def _entry_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _ENTRY_TYPES)], names=ENTRY.names)


def look_up(directory: DataFrame, urls: DataFrame, url_col: str = "url", payloads: bool = True) -> DataFrame:
    """The captures of all URLs of a table, one row each.

    payloads=False leaves the (checked) payloads out of the result.
    """
    dealt = _dealt(directory, urls, url_col)
    mine = directory.join(dealt.select("part").distinct(), "part", "left_semi")
    blank = lambda kind: F.lit(None).cast(kind)
    rows = mine.select("part", F.lit(False).alias("wanted"), F.col("first_key").alias("key"), "last_key", "file", "offset", "length").unionByName(
        dealt.select("part", F.lit(True).alias("wanted"), "key", blank("string").alias("last_key"), blank("string").alias("file"), blank("long").alias("offset"), blank("long").alias("length"))
    )
    found = rows.repartition("part").sortWithinPartitions("part", "wanted", "key", "last_key").mapInArrow(_search, ENTRY)
    stripe = (F.col("offset") / F.lit(16 << 20)).cast("long")
    near = found.repartition("archive", stripe).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(lambda batches: _read_records(batches, payloads), CAPTURE)


def _read_records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records of entries that come sorted by archive and offset."""
    for batch in batches:
        archives, offsets, lengths = (batch[c].to_pylist() for c in ("archive", "offset", "length"))
        begin = 0
        while begin < len(archives):
            end, stop = begin + 1, offsets[begin] + lengths[begin]
            while end < len(archives) and archives[end] == archives[begin] and 0 <= offsets[end] - stop <= RANGE_GAP and offsets[end] + lengths[end] - offsets[begin] <= RANGE_BYTES:
                stop, end = offsets[end] + lengths[end], end + 1
            data = _range(archives[begin], offsets[begin], stop - offsets[begin])
            rows = [parsed(data[o - offsets[begin] : o - offsets[begin] + n]) for o, n in zip(offsets[begin:end], lengths[begin:end])]
            if not payloads:
                rows = [r | {"payload": None} for r in rows]
            yield pa.RecordBatch.from_pylist(rows, schema=_CAPTURE_ARROW)
            begin = end


_CAPTURE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Writes archives and index below folder and returns the directory."""
    folder = folder or os.path.join(shared_dir(spark), "warc")
    return build_index(write_archives(pages, f"{folder}/archives", least), f"{folder}/index")
