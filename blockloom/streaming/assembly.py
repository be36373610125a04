"""Downloads that arrive in any order, twice or never, put together again without gaps.

A stream of received blocks is keyed by range of numbers. Each range keeps the next number that it waits for
and the blocks beyond it, and hands on a run as soon as it is contiguous; what it has handed on is dropped, so
its state is what lies beyond its gap. A range that has waited asks again for what is missing, by a timer.
The time is that of the batch that brings a block, so no block is ever late. Ranges are independent tasks; `gapless` then takes the rows up to the first gap of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Blocks of a range, and the time in milliseconds that a range waits before it asks again.
RANGE, PATIENCE_MS = 1024, 60_000
RELEASED = "bucket long, kind string, number long, last long, hash string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Assembler(StatefulProcessor):
    """Rows (kind block: number, hash; kind request: number to last, missing) of one range."""

    def __init__(self, width: int = RANGE, patience_ms: int = PATIENCE_MS):
        self.width, self.patience = width, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next long, numbers array<long>, hashes array<string>")  # at most `width` held
        self.timer = handle.getValueState("timer", "at long")

    def _held(self, bucket: int) -> tuple[int, dict[int, str]]:
        row = self.state.get() if self.state.exists() else (bucket * self.width, [], [])
        return int(row[0]), dict(zip((int(n) for n in row[1]), row[2]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket, out = int(key[0]), []
        at, held = self._held(bucket)
        for part in rows:
            for number, hash_ in zip(part["number"].tolist(), part["hash"].tolist()):
                if number >= at:
                    held.setdefault(number, hash_)
        while at in held:
            out.append((bucket, "block", at, at, held.pop(at)))
            at += 1
        self.state.update((at, list(held), list(held.values())))
        self._wait(at, bucket, timerValues)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Asks for each gap below a block that is held, or for the rest of the range where none is, once a timer."""
        bucket = int(key[0])
        at, held = self._held(bucket)
        self.timer.clear()
        out = []
        for number in sorted(held) or [(bucket + 1) * self.width]:
            if number > at:
                out.append((bucket, "request", at, number - 1, None))
            at = number + 1
        yield _frame(out)

    def _wait(self, at: int, bucket: int, timerValues) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(int(self.timer.get()[0]))
            self.timer.clear()
        if at < (bucket + 1) * self.width:
            due = max(0, timerValues.getCurrentWatermarkInMs()) + self.patience
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["bucket", "kind", "number", "last", "hash"]
    return pd.DataFrame(rows, columns=names).astype({"bucket": "int64", "kind": object, "number": "int64", "last": "int64", "hash": object})


def assembled(received: DataFrame, width: int = RANGE, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """Streaming: bucket, kind, number, last, hash from a stream of number, hash."""
    received.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = received.select("number", "hash", F.current_timestamp().alias("at"), F.floor(F.col("number") / width).alias("bucket")).withWatermark("at", "0 seconds")
    return keyed.groupBy("bucket").transformWithStateInPandas(Assembler(width, patience_ms), RELEASED, "append", "eventTime")


def gapless(released: DataFrame, first: int = 0, width: int = RANGE) -> DataFrame:
    """number, hash of released blocks from `first` up to the first gap of all; a duplicate counts once."""
    blocks = released.where("kind = 'block'").select("number", "hash").distinct().where(F.col("number") >= first)
    counts = blocks.groupBy(F.floor(F.col("number") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("top"))
    # A range is whole if its run reaches its end; one row for each range meets in a window by ranges of ranges.
    ends = counts.withColumn("whole", F.col("top") == (F.col("bucket") + 1) * width - 1)
    follows = F.col("bucket") - F.lag("bucket").over(Window.partitionBy(F.floor(F.col("bucket") / 4096)).orderBy("bucket")) == 1
    broken = ends.withColumn("follows", F.coalesce(follows, F.lit(True))).where("NOT whole OR NOT follows").agg(F.min(F.when(F.col("follows"), F.col("top")).otherwise(F.col("bucket") * width - 1))).first()[0]
    return blocks if broken is None else blocks.where(F.col("number") <= broken)
