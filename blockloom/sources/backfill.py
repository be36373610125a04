"""A streaming source of the blocks of a range, batch by batch: what a consumer that starts late has to read.

Batches are worked out by Spark (stages.batches) and handed over as cuts. Offsets are block numbers, so a
stream goes on where its checkpoint says, whatever cuts it is given then; consecutive batches share a partition
where there are many. A range of more cuts than a source takes is read by several runs (`in_runs`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.ranks import positions
from .shared import written

#: Cuts that a source takes, and partitions of a run at most; a longer range is read by several runs.
MOST, PARTITIONS = 100_000, 256
#: Blocks of a row batch at most.
ROWS = 65_536
SCHEMA = "batch long, number long"


class Batches(InputPartition):
    """Consecutive batches: (batch, first, last) each."""

    def __init__(self, batches: list[tuple[int, int, int]]):
        self.batches = batches


class BackfillReader(DataSourceStreamReader):
    def __init__(self, cuts: list[list[int]]):
        self.cuts = cuts

    def initialOffset(self) -> dict:
        return {"number": self.cuts[0][0] if self.cuts else 0}

    def latestOffset(self) -> dict:
        return {"number": self.cuts[-1][1] + 1} if self.cuts else {"number": 0}

    def partitions(self, start: dict, end: dict):
        """The batches between two offsets; one that an earlier run has begun is read from where that ended."""
        lo, hi = start["number"], end["number"] - 1
        found = [(a, max(a, lo), min(b, hi)) for a, b in self.cuts if b >= lo and a <= hi]
        each = -(-len(found) // PARTITIONS) or 1
        return [Batches(found[k : k + each]) for k in range(0, len(found), each)]

    def read(self, partition):
        for batch, first, last in partition.batches:
            for at in range(first, last + 1, ROWS):
                numbers = pa.array(range(at, min(at + ROWS, last + 1)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(numbers), pa.int64()), numbers], names=["batch", "number"])

    def commit(self, end: dict) -> None:
        pass


class BackfillSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "backfill"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BackfillReader:
        return BackfillReader(json.loads(self.options["cuts"]))


def stream(spark: SparkSession, cuts: DataFrame) -> DataFrame:
    """Streaming: batch (its first block), number of the blocks of cuts (first, last)."""
    rows = sorted((r["first"], r["last"]) for r in cuts.limit(MOST + 1).collect())
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} batches; end the range at block {rows[MOST - 1][1]}")
    spark.dataSource.register(BackfillSource)
    return spark.readStream.format("backfill").option("cuts", json.dumps(rows)).load()


def in_runs(spark: SparkSession, cuts: DataFrame, most: int | None = None) -> Iterator[DataFrame]:
    """The streams of so many cuts each, in the order of blocks, that together read all of cuts (first, last).

    Run one after another over one checkpoint, each goes on where the one before ended.
    """
    most = most or MOST
    placed = written(positions(cuts.select("first", "last"), "first", "place"))
    for k in range(-(-placed.count() // most) or 1):
        yield stream(spark, placed.where(F.floor(F.col("place") / most) == k).select("first", "last"))
