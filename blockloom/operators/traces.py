"""Call traces: filter with paging, rewards as rows, digests by transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 100


def _calls() -> Column:
    """The calls of a transaction, as structs path, from_, to_, value, kind."""
    call = lambda path, a, b, value, kind: F.struct(F.lit(path).alias("path"), a.alias("from_"), b.alias("to_"), value.alias("value"), F.lit(kind).alias("kind"))
    sender, recipient = F.col("sender").cast("long"), F.col("recipient").cast("long")
    return F.array_compact(F.array(
        call("", sender, recipient, F.col("tip"), "call"), F.when(F.col("tx_num") % 3 == 0, call("0", recipient, sender, F.col("gas"), "call")), F.when(F.col("tx_num") % 17 == 0, call("1", recipient, F.col("tx_num") % 500, F.lit(0).cast("long"), "create")),
    ))


def of_transactions(txs: DataFrame) -> DataFrame:
    """tx_num, number, idx, path (of the call), from_, to_, value, gas, kind: a call for each transaction,
    an inner one for every third, and a creation below every seventeenth."""
    return txs.select("tx_num", "number", "idx", "gas", F.explode(_calls()).alias("t")).select("tx_num", "number", "idx", "t.path", "t.from_", "t.to_", "t.value", "gas", "t.kind")


def with_contract(txs: DataFrame) -> DataFrame:
    """Transactions with the contract that each created first (null: none); their calls are looked at in place, nothing is joined."""
    return txs.withColumn("contract", F.array_min(F.filter(_calls(), lambda c: c["kind"] == "create"))["to_"])


def involved(senders: Sequence | None, recipients: Sequence | None, union: bool = True) -> Column:
    """Traces from or to the given addresses; an empty side matches all on its own, nothing beside a given one."""
    sides = [F.col(c).isin(list(v)) for c, v in (("from_", senders), ("to_", recipients)) if v]
    if not sides:
        return F.lit(True)
    out = sides[0]
    for s in sides[1:]:
        out = out | s if union else out & s
    return out


def trace_filter(traces: DataFrame, first: int, last: int, matches: Column, after: int = 0, count: int | None = None, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Matching traces of a block range by block, transaction and path; a page of them if asked for."""
    if last < first or last - first > max_blocks:
        raise ValueError(f"a range of {last - first} blocks; at most {max_blocks}")
    found = traces.where(F.col("number").between(first, last)).where(matches).orderBy("number", "idx", "path")
    if after:
        found = found.offset(after)
    return found if count is None else found.limit(count)


def with_rewards(traces: DataFrame, headers: DataFrame, base: int = 2_000) -> DataFrame:
    """Traces and a reward row for each block's beneficiary."""
    rewards = headers.select(
        F.lit(None).cast("long").alias("tx_num"), "number", F.lit(None).cast("long").alias("idx"), F.lit("").alias("path"), F.lit(None).cast("long").alias("from_"), F.col("beneficiary").cast("long").alias("to_"),
        F.lit(base).cast("long").alias("value"), F.lit(0).cast("long").alias("gas"), F.lit("reward").alias("kind"),
    )
    return traces.unionByName(rewards)


def creators(traces: DataFrame) -> DataFrame:
    """contract, number, tx_num, creator: the first creation at each address."""
    first = traces.where("kind = 'create'").groupBy(F.col("to_").alias("contract"))  # values of fixed width, so that nothing is sorted
    return first.agg(F.min_by("number", "tx_num").alias("number"), F.min("tx_num").alias("tx_num"), F.min_by("from_", "tx_num").alias("creator"))
