"""Exact deduplication by Grace hashing.

Texts are equal when they are identical after each run of ASCII white space is replaced by one
space. Every map task first folds its own rows, so a text with any number of copies leaves a task
about once; what is left is shuffled by a 64-bit content hash, and each reduce task partitions its
records recursively into spill files until the distinct contents of a bucket fit an open-addressing
table that compares complete contents.

Defined results: a null text is the empty text; a null id ranks after every other id; of rows that
repeat both id and text one stays (that with the smallest other columns, so the choice doesn't depend on
the order of rows); texts of any length are compared whole; empty input gives empty output; other columns,
whatever they are called, pass through `keep` untouched.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_or_empty, written

_TO_SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: Bytes of batches that a task folds at a time, and the spill files of one level.
MEMORY, FANOUT_BITS = 48 << 20, 4


def _spill_root() -> str | None:
    """One of the folders that Spark gives the executor for its own spills; None where it names none."""
    named = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return named[os.getpid() % len(named)] if named else None


def normalised(text: str | None) -> bytes:
    """UTF-8 of text with each run of ASCII white space made one space."""
    b = (text or "").encode().translate(_TO_SPACE)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    return b


def content_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (SHA-256 of the normalised text, 32 bytes) for every row; no shuffle."""
    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("key", T.BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([sha256_of(x) for x in batch["text"].to_pylist()], pa.binary())], names=schema.names)

    return slim.mapInArrow(keyed, schema)


def sha256_of(text: str | None) -> bytes:
    return hashlib.sha256(normalised(text)).digest()


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, expected: int):
        size = 16
        while size < 2 * expected:
            size *= 2
        self.slots, self.mask = [-1] * size, size - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry's number and whether it is new."""
        slot = h & self.mask
        while (at := self.slots[slot]) >= 0:
            if self.hashes[at] == h and self.contents[at] == content:
                return at, False
            slot = (slot + 1) & self.mask
        self.slots[slot] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        return len(self.contents) - 1, True


def _row_rank(batch: pa.RecordBatch, i: int) -> str:
    return repr([c[i].as_py() for c in batch.columns])


def fold(batch: pa.RecordBatch, id_col: str, text_col: str) -> pa.RecordBatch:
    """One row per distinct content: that of the smallest id, with `_n` summed."""
    ids, counts = batch[id_col].to_pylist(), batch["_n"].to_pylist()
    hashes, texts = batch["_h"].to_pylist(), batch[text_col].to_pylist()
    table = ContentTable(len(ids))
    best: list[int] = []
    total: list[int] = []
    for i, h in enumerate(hashes):
        at, new = table.entry(h, normalised(texts[i]))
        if new:
            best.append(i)
            total.append(counts[i])
            continue
        total[at] += counts[i]
        j = best[at]
        if ids[i] == ids[j]:
            if _row_rank(batch, i) < _row_rank(batch, j):
                best[at] = i
        elif ids[j] is None or (ids[i] is not None and ids[i] < ids[j]):
            best[at] = i
    out = batch.take(pa.array(best, pa.int64()))
    return out.set_column(out.schema.get_field_index("_n"), "_n", pa.array(total, pa.int64()))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def hashed(batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    """batch with `_h`, the 64-bit hash of the content, and `_n`, 1."""
    hs = [xxhash.xxh3_64_intdigest(normalised(x)) for x in batch[text_col].to_pylist()]
    signed = pa.array([h - (1 << 64) if h >> 63 else h for h in hs], pa.int64())
    return batch.append_column("_h", signed).append_column("_n", pa.array([1] * len(hs), pa.int64()))


def combine(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, memory: int) -> Iterator[pa.RecordBatch]:
    """Map side: folds the rows of windows of so many bytes; a content leaves a window once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        small = fold(hashed(batch, text_col), id_col, text_col)
        held.append(small)
        size += small.nbytes
        if size > memory:
            small = fold(_joined(held), id_col, text_col)
            held, size = [small], small.nbytes
            if size > memory // 2:
                yield small
                held, size = [], 0
    if held:
        yield fold(_joined(held), id_col, text_col)


def grace(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, memory: int, level: int = 0) -> Iterator[pa.RecordBatch]:
    """Reduce side: folds in memory while the distinct contents fit, else partitions to spill files.

    Level k deals by the k-th group of hash bits from the top, so buckets shrink at each level; when
    the bits are used up (contents with one and the same hash), what is left is folded together.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    source = iter(batches)
    for batch in source:
        held.append(batch)
        size += batch.nbytes
        if size > memory:
            small = fold(_joined(held), id_col, text_col)
            held, size = [small], small.nbytes
            if size > memory // 2 and (level + 1) * FANOUT_BITS <= 64:
                break
    else:
        if held:
            yield fold(_joined(held), id_col, text_col)
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=_spill_root()) as folder:  # gone with the task
        writers: dict[int, tuple[pa.OSFile, pa.ipc.RecordBatchStreamWriter]] = {}
        shift = 64 - (level + 1) * FANOUT_BITS

        def spill(batch: pa.RecordBatch) -> None:
            buckets: dict[int, list[int]] = {}
            for i, h in enumerate(batch["_h"].to_pylist()):
                buckets.setdefault((h >> shift) & ((1 << FANOUT_BITS) - 1), []).append(i)
            for b, rows in buckets.items():
                if b not in writers:
                    file = pa.OSFile(os.path.join(folder, str(b)), "wb")
                    writers[b] = (file, pa.ipc.new_stream(file, batch.schema))
                writers[b][1].write_batch(batch.take(pa.array(rows, pa.int64())))

        spill(held.pop())
        for batch in source:
            if batch.num_rows:
                spill(batch)
        for file, writer in writers.values():
            writer.close()
            file.close()
        for b in sorted(writers):
            path = os.path.join(folder, str(b))
            with pa.OSFile(path) as file:
                yield from grace(pa.ipc.open_stream(file), id_col, text_col, memory, level + 1)
            os.unlink(path)


def _folded(df: DataFrame, id_col: str, text_col: str, memory: int) -> DataFrame:
    """df's rows of smallest id, one per distinct content, with `_h` and `_n` (its rows in df)."""
    schema = T.StructType([*df.schema.fields, T.StructField("_h", T.LongType()), T.StructField("_n", T.LongType())])
    local = df.mapInArrow(lambda batches: combine(batches, id_col, text_col, memory), schema)
    return local.repartition("_h").mapInArrow(lambda batches: grace(batches, id_col, text_col, memory), schema)


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The rows of df that stay, with all their columns and no others. One shuffle of the texts."""
    safe = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])  # any names may clash
    at_id, at_text = df.columns.index(id_col), df.columns.index(text_col)
    kept = _folded(safe, f"c{at_id}", f"c{at_text}", memory)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per distinct content: key (SHA-256, 32 bytes), keep_id, group_size."""
    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kept = _folded(slim, "id", "text", memory)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("keep_id", slim.schema["id"].dataType), T.StructField("group_size", T.LongType())])

    def keyed(batches):
        for b in batches:
            keys = pa.array([sha256_of(x) for x in b["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, b["id"], b["_n"]], ["key", "keep_id", "group_size"])

    return kept.mapInArrow(keyed, schema)


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Which contents are equal, the smallest id and the size of each group come from the table that
    compares complete contents; rows then find their group by the SHA-256 of their normalised text, so
    the second pass moves ids and keys only. Rows that repeat id and key are counted before that join;
    adaptive execution splits the partition of a hot key.
    """
    found = written(groups(df, id_col, text_col, memory))
    rows = content_keys(df, id_col, text_col).withColumnRenamed("id", "doc_id").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(found, "key").select(
        "doc_id", "keep_id", "group_size", F.hex("key").alias("h"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower("h").alias("text_sha256"))
