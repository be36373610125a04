"""Bloom filters of logs: 2048 bits for each block and each segment, tested before segments are opened.

A value sets three bits, taken from its digest. Filters are built and joined as bitmaps by Spark's own
aggregates; a filter that misses a bit proves that no log of its block holds the value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, and those that a value sets.
BITS, EACH = 2048, 3


def bits(value: Column) -> Column:
    """The places of a value's bits: eleven bits of each of the first words of its digest."""
    digest = F.md5(value.cast("string"))
    return F.array(*[F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int") % BITS for k in range(EACH)])


def of_blocks(logs: DataFrame, columns: Sequence[str], block: str = "block") -> DataFrame:
    """block, bloom of the logs' columns; a value counts with its column's name."""
    marks = F.flatten(F.array(*[F.when(F.col(c).isNotNull(), bits(F.concat(F.lit(f"{c}="), F.col(c).cast("string")))).otherwise(F.array().cast("array<int>")) for c in columns]))
    each = logs.select(block, F.explode(marks).alias("bit"))
    return each.groupBy(block).agg(F.substring(F.bitmap_construct_agg(F.col("bit").cast("long")), 1, BITS // 8).alias("bloom"))


def merged(blooms: DataFrame, size: int, block: str = "block") -> DataFrame:
    """bucket, bloom of segments of `size` blocks."""
    return blooms.groupBy(F.floor(F.col(block) / size).alias("bucket")).agg(F.substring(F.bitmap_or_agg("bloom"), 1, BITS // 8).alias("bloom"))


def may_hold(bloom: Column, wanted: dict[str, Sequence | None]) -> Column:
    """Whether a filter leaves it open that a log has, in each of the columns, one of the wanted values (None: any)."""
    out = F.lit(True)
    for column, values in wanted.items():
        if values:
            mine = F.lit(False)
            for v in values:
                places = bits(F.lit(f"{column}={v}"))
                mine = mine | F.forall(places, lambda p: F.getbit(F.conv(F.hex(bloom.substr(F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), p % 8) == 1)
            out = out & mine
    return out


def opened(segments: DataFrame, wanted: dict[str, Sequence | None]) -> list[int]:
    """The segments that may hold a wanted log; a row for each segment comes to the driver at most."""
    return sorted(r["bucket"] for r in segments.where(may_hold(F.col("bloom"), wanted)).select("bucket").collect())


def candidates(blooms: DataFrame, wanted: dict[str, Sequence | None], block: str = "block") -> DataFrame:
    """The blocks that may hold a wanted log."""
    return blooms.where(may_hold(F.col("bloom"), wanted)).select(block)
