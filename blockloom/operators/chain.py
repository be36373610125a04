"""Blocks, transactions and receipts: look-ups, band joins, positional joins, checks, segment algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fees import next_base_fee


def in_range(df: DataFrame, key: str, start: int | None, end: int | None, closed: bool = True) -> DataFrame:
    """Rows with start <= key <= end (end open unless closed); None is unbounded."""
    if start is not None:
        df = df.where(F.col(key) >= start)
    if end is not None:
        df = df.where(F.col(key) <= end if closed else F.col(key) < end)
    return df


def seek(df: DataFrame, key: str, at) -> DataFrame:
    """The row with the smallest key >= at."""
    return df.where(F.col(key) >= at).orderBy(key).limit(1)


def multi_get(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Every key with its row, nulls where there is none."""
    return keys.join(table, on, "left")


def take_while(df: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Rows in key order up to (without) the first that fails the predicate."""
    failed = df.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(key)).first()[0]
    return df if failed is None else df.where(F.col(key) < failed)


def block_of_tx(body_indices: DataFrame, tx_nums: DataFrame, width: int = 4096) -> DataFrame:
    """tx_num with the block that owns it, as a band join on ranges of transaction numbers.

    A block takes part in each range that it overlaps, so the join is an equi-join on the range.
    """
    blocks = body_indices.where("tx_count > 0").withColumn("last", F.col("first_tx_num") + F.col("tx_count") - 1)
    ranged = blocks.withColumn("range", F.explode(F.sequence(F.floor(F.col("first_tx_num") / width), F.floor(F.col("last") / width))))
    return tx_nums.withColumn("range", F.floor(F.col("tx_num") / width)).join(ranged, "range").where(F.col("tx_num").between(F.col("first_tx_num"), F.col("last"))).drop("range", "last")


def with_effective_price(receipts: DataFrame) -> DataFrame:
    """Receipts that carry their transaction's caps and their block's base fee, with the price that was paid."""
    return receipts.withColumn("effective_price", F.least("max_fee", F.col("base_fee") + F.col("tip")))


# The least gas limit, and the share of the parent's limit that a limit must not move by.
MINIMUM_GAS_LIMIT, LIMIT_DIVISOR = 5000, 1024


def with_parent(headers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """headers with p_... of the header before each one."""
    # A range's first header finds its parent in the row before it, which is sent along.
    edge = headers.where(F.pmod("number", F.lit(8192)) == 8191)
    both = headers.withColumn("own", F.lit(True)).unionByName(edge.withColumns({"own": F.lit(False)}))
    both = both.withColumn("slot", F.when(F.col("own"), F.floor(F.col("number") / 8192)).otherwise(F.floor(F.col("number") / 8192) + 1))
    order = Window.partitionBy("slot").orderBy("number")
    return both.withColumns({f"p_{c}": F.lag(c).over(order) for c in columns}).where("own").drop("own", "slot")


def header_faults(headers: DataFrame) -> DataFrame:
    """number, fault: each rule that a header breaks on its own or against its parent."""
    rows = with_parent(headers, ("number", "hash", "ts", "gas_limit", "gas_used", "base_fee"))
    known = F.col("p_number").isNotNull()
    rules = {
        "gas used beyond limit": F.col("gas_used") > F.col("gas_limit"),
        "number is not the parent's plus one": known & (F.col("number") != F.col("p_number") + 1),
        "parent hash": known & (F.col("parent_hash") != F.col("p_hash")),
        "timestamp not after the parent's": known & (F.col("ts") <= F.col("p_ts")),
        "gas limit moved too far": known & (F.abs(F.col("gas_limit") - F.col("p_gas_limit")) >= F.call_function("div", F.col("p_gas_limit"), F.lit(LIMIT_DIVISOR))),
        "gas limit below the minimum": known & (F.col("gas_limit") < MINIMUM_GAS_LIMIT),
        "base fee": known & (F.col("base_fee") != next_base_fee(F.col("p_base_fee"), F.col("p_gas_used"), F.col("p_gas_limit"))),
    }
    listed = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select("number", F.explode(listed).alias("fault"))


def body_faults(headers: DataFrame, txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Headers whose gas is not that of their transactions and of their last receipt."""
    sums = txs.groupBy("number").agg(F.sum("gas").alias("body_gas"))
    last = receipts.groupBy("number").agg(F.max("cumulative_gas").alias("receipt_gas"))
    joined = headers.select("number", "gas_used").join(sums, "number", "left").join(last, "number", "left").fillna(0, ["body_gas", "receipt_gas"])
    return joined.where((F.col("gas_used") != F.col("body_gas")) | (F.col("gas_used") != F.col("receipt_gas")))


def gaps(df: DataFrame, key: str, width: int = 8192, levels: int = 3) -> DataFrame:
    """start, end (inclusive) of the missing keys between present ones.

    Keys meet their successors within ranges of `width`, the ranges' ends theirs within ranges of ranges, and
    so on; at the last level one row for each width ** levels keys is left in one window.
    """
    runs, found = df.select(F.col(key).alias("lo"), F.col(key).alias("hi")), None
    for level in range(levels + 1):
        slot = F.floor(F.col("lo") / width ** (level + 1))
        window = Window.partitionBy(slot).orderBy("lo") if level < levels else Window.orderBy("lo")
        apart = runs.withColumn("next", F.lead("lo").over(window)).where("next > hi + 1").select((F.col("hi") + 1).alias("start"), (F.col("next") - 1).alias("end"))
        found = apart if found is None else found.unionByName(apart)
        runs = runs.groupBy(slot.alias("slot")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("slot")
    return found


def append_chain(left: DataFrame, right: DataFrame) -> DataFrame:
    """left followed by right; right must begin with the block after left's last one and name its hash."""
    tip = left.agg(F.max_by("hash", "number").alias("hash"), F.max("number").alias("number")).first()
    head = right.agg(F.min_by("parent_hash", "number").alias("parent"), F.min("number").alias("number")).first()
    if tip["number"] is not None and head["number"] is not None and (head["number"] != tip["number"] + 1 or head["parent"] != tip["hash"]):
        raise ValueError(f"block {head['number']} does not follow block {tip['number']}")
    return left.unionByName(right)


def split_at(df: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("number") <= number), df.where(F.col("number") > number)


def orphans(headers: DataFrame, genesis: int = 0) -> DataFrame:
    """Headers whose parent is not there."""
    parents = headers.select(F.col("hash").alias("parent_hash"))
    return headers.where(F.col("number") > genesis).join(parents, "parent_hash", "left_anti")


def tags(headers: DataFrame, safe: int = 32, final: int = 64) -> DataFrame:
    """tag, number of the named blocks."""
    ends = headers.agg(F.max("number").alias("hi"), F.min("number").alias("lo"))
    named = F.create_map(F.lit("latest"), F.col("hi"), F.lit("earliest"), F.col("lo"), F.lit("safe"), F.greatest(F.col("hi") - safe, "lo"), F.lit("finalized"), F.greatest(F.col("hi") - final, "lo"))
    return ends.select(F.explode(named).alias("tag", "number"))
