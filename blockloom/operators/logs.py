"""Log search: address sets and positional topics over a block range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blooms

MAX_BLOCKS, MAX_LOGS = 100_000, 20_000


class RangeError(ValueError):
    """A block range that cannot be served."""


def block_range(start: int | None, end: int | None, head: int, earliest: int = 0, max_blocks: int = MAX_BLOCKS) -> tuple[int, int] | None:
    """Bounds of a search; missing ones are the head. None if the range begins beyond the head."""
    first, last = head if start is None else start, head if end is None else end
    if last > head and end is not None:
        raise RangeError(f"block {last} is beyond the head {head}")
    if first > head:
        return None
    if first > last:
        raise RangeError(f"range begins at {first} and ends at {last}")
    if first < earliest:
        raise RangeError(f"blocks below {earliest} are pruned")
    if last - first > max_blocks:
        raise RangeError(f"more than {max_blocks} blocks")
    return first, last


def matches(addresses: Sequence | None, topics: Sequence[Sequence | None]):
    """The filter as an expression; an empty set or position matches all."""
    out = F.lit(True)
    if addresses:
        out = out & F.col("address").isin(list(addresses))
    for k, allowed in enumerate(topics):
        if allowed:
            out = out & F.col(f"topic{k}").isin(list(allowed))
    return out


def search(logs: DataFrame, bounds: tuple[int, int] | None, addresses=None, topics=()) -> DataFrame:
    """The logs in the range that match. log_index already counts all logs of a block, so the range
    may be pushed below it and the rest of the filter stays above."""
    if bounds is None:
        return logs.limit(0)
    return logs.where(F.col("block").between(*bounds)).where(matches(addresses, topics))


def by_blooms(open_logs, segments: DataFrame, blocks: DataFrame, wanted: dict[str, Sequence | None]) -> DataFrame:
    """Logs that have one of the wanted values in each of the columns (None: any), by filters of segments and blocks.

    Segments whose filter misses a value are not opened (open_logs: from a list of segments to their logs); of the
    others, logs of blocks whose filter misses one are left out before values are compared.
    """
    rows = open_logs(blooms.opened(segments, wanted)).join(blooms.candidates(blocks, wanted), "block", "left_semi")
    for column, values in wanted.items():
        rows = rows.where(F.col(column).isin(list(values))) if values else rows
    return rows


def checked(found: DataFrame, bounds: tuple[int, int], max_logs: int = MAX_LOGS) -> DataFrame:
    """found, or an error with the last block that would still fit when a range of blocks has too many logs."""
    if bounds[0] == bounds[1] or found.limit(max_logs + 1).count() <= max_logs:
        return found
    by_block = found.groupBy("block").count().orderBy("block").limit(max_logs + 1).collect()
    total, fits = 0, bounds[0]
    for row in by_block:
        total += row["count"]
        if total > max_logs:
            break
        fits = row["block"]
    raise RangeError(f"more than {max_logs} logs; retry with blocks {bounds[0]} to {fits}")


def since(logs: DataFrame, last_poll: int, addresses=None, topics=()) -> DataFrame:
    """What an installed filter has not delivered yet."""
    return logs.where(F.col("block") > last_poll).where(matches(addresses, topics))
