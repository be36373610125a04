"""Packing of documents into training sequences by minimum bin slack.

A document's ids and an end id are cut into pieces of `capacity` ids, the first piece shorter where
they don't come out even. The plan needs only how many pieces there are of each length (at most
`capacity` numbers, whatever the corpus): per bin it takes the longest length left, finds by subset
sums kept as bits the fullest combination of the lengths left beside it, and removes it, as often
as the counts allow in one go. Several orders of the lengths are tried, as they decide which of equally
full combinations is taken, and the plan with the fewest bins is kept. Pieces then find their place by their rank among those of equal
length; ranks come from counts per task and length, so no task sees more than its share of rows.

Defined results: a null text is the empty text (a piece with only the end id); null ids and repeated
rows are packed like any other row; pieces of equal length are told apart only by where their task met
them, so ties are settled by the plan; a text of any length is cut, never shortened; an empty table gives
no rows; other columns, whatever they are called, are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import word_bpe
from .shared import text_or_empty, written

CAPACITY, END_ID, ATTEMPTS = 1024, 2, 12


def fullest(counts: list[int], room: int, order: Sequence[int] | None = None) -> dict[int, int]:
    """{length: times} of the combination with the largest sum up to room; counts[l] of l are left.

    reach[k] has bit s set if the first k lengths of the order can sum to s. Lengths are added in the
    order given (the longest first by default) until the room can be filled, so among combinations
    that are equally full the order decides which lengths are spent and which are left for later bins.
    """
    wanted, full = 1 << room, (2 << room) - 1
    reach, lengths, bits = [], [], 1
    for length in order or range(room, 0, -1):
        if length > room or not counts[length]:
            continue
        reach.append(bits)
        lengths.append(length)
        for _ in range(min(counts[length], room // length)):
            grown = bits | (bits << length) & full
            if grown == bits:
                break
            bits = grown
        if bits & wanted:
            break
    left, chosen = bits.bit_length() - 1, {}
    for length, before in zip(reversed(lengths), reversed(reach)):
        times = 0
        while not before >> left & 1:
            left -= length
            times += 1
        if times:
            chosen[length] = times
    return chosen


def _orders(capacity: int, attempts: int) -> Iterator[list[int]]:
    """Orders of the lengths to try: longest first, shortest first, nearest to a share of the capacity, then shuffles."""
    lengths = list(range(1, capacity + 1))
    yield lengths[::-1]
    yield lengths
    for share in (5, 3):
        yield sorted(lengths, key=lambda n: abs(share * n - capacity))
    for seed in range(attempts):
        random.Random(seed).shuffle(lengths)
        yield list(lengths)


def bin_plan(histogram: dict[int, int], capacity: int = CAPACITY, attempts: int = ATTEMPTS) -> list[tuple[dict[int, int], int]]:
    """[(times of each length in the bin, bins of this kind)] that use up the histogram.

    The plan with the fewest bins over several orders of the lengths (`attempts` to try, at least one); the
    work of each depends on the number of lengths only.
    """
    best: tuple[int, list] | None = None
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    for order in islice(_orders(capacity, attempts), max(1, attempts)):
        plan = _plan(histogram, capacity, order)
        bins = sum(n for _, n in plan)
        if best is None or bins < best[0]:
            best = bins, plan
        if bins == least:
            break
    return best[1]


def _plan(histogram: dict[int, int], capacity: int, order: list[int]) -> list[tuple[dict[int, int], int]]:
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    plan, longest = [], capacity
    order = [n for n in order if counts[n]]
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan
        counts[longest] -= 1
        chosen = fullest(counts, capacity - longest, order) if longest < capacity else {}
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(counts[length] // times for length, times in chosen.items())
        for length, times in chosen.items():
            counts[length] -= bins * times
        plan.append((chosen, bins))


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces of this length in a bin, offset of the first)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for chosen, bins in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            times = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _piece_fields(id_type: T.DataType, ids: bool) -> list[T.StructField]:
    return [
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if ids else []), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
    ]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """The pieces of every document; with ids=True also their ids (little-endian, 32 bits each).

    part and rank number the pieces of equal length within a task.
    """
    slim = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType(_piece_fields(slim.schema["doc_id"].dataType, ids))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = word_bpe(ranks_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            found, bounds = bpe.encode(batch["text"].to_pylist())
            found = found.astype("<u4", copy=False)
            at, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                data = found[bounds[i] : bounds[i + 1]].tobytes() + end
                n = len(data) >> 2
                a, b, k = 0, n % capacity or min(n, capacity), 0
                while a < n:
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    bits = data[4 * a : 4 * b]
                    crc.append(zlib.crc32(bits))
                    if ids:
                        kept.append(bits)
                    rank.append(seen.get(b - a, 0))
                    seen[b - a] = rank[-1] + 1
                    a, b, k = b, b + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(kept, pa.binary())] if ids else []), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64())],
                names=schema.names,
            )

    return slim.mapInArrow(cut, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """Pieces with their sequence_id and their offset there."""
    cut = written(pieces(df, id_col, text_col, capacity, end_id, ids, ranks_path))
    by_task = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(bin_plan(histogram, capacity))
    ranked = cut.join(firsts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")
    fields = [f for f in cut.schema.fields if f.name not in ("part", "rank")]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            kinds, begins = np.unique(lengths[order], return_index=True)
            for length, mine in zip(kinds.tolist(), np.split(order, begins[1:])):
                rows = table[length]
                r = ranks[mine]
                first, base, times, at = rows[np.searchsorted(rows[:, 0], r, "right") - 1].T
                sequence[mine] = base + (r - first) // times
                offset[mine] = at + (r - first) % times * length
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(place, schema)
