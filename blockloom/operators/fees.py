"""Fee statistics: gas-weighted percentiles, fee history, tip suggestion."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import prefix_minima, prefix_sums

#: Defaults of the tip suggestion: blocks sampled, lowest tips of each, percentile, ceiling.
BLOCKS, SAMPLE, PERCENTILE, MAX_HISTORY, CEILING = 20, 3, 60, 1024, 500_000_000_000
#: Points of a grid of rewards for one percent.
RESOLUTION = 4
# Gas of a blob, and how fast the blob fee follows the excess.
GAS_PER_BLOB, UPDATE_FRACTION = 131_072, 3_338_477


def reward_percentiles(txs: DataFrame, headers: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """number, p, reward: rewards_of_blocks as a row for each percentile; a block without transactions has reward 0."""
    zeros = F.array(*[F.lit(0).cast("long") for _ in percentiles])
    listed = headers.select("number").join(rewards_of_blocks(txs, percentiles), "number", "left").select("number", F.coalesce("rewards", zeros).alias("rewards"))
    named = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percentiles]).alias("p"), F.col("rewards").alias("reward"))
    return listed.select("number", F.inline(named).alias("p", "reward"))


def next_base_fee(base_fee, gas_used, gas_limit, denominator: int = 8, elasticity: int = 2):
    """The base fee that follows a block, in integers."""
    div = lambda a, b: F.call_function("div", a, b)
    target = div(gas_limit, F.lit(elasticity))
    gap = F.abs(gas_used - target)
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the product exceeds 64 bits
    change = div(div(wide(base_fee) * wide(gap), wide(F.greatest(target, F.lit(1)))), F.lit(denominator))
    return F.when(gas_used == target, base_fee).when(gas_used > target, base_fee + F.greatest(change, F.lit(1))).otherwise(F.greatest(base_fee - change, F.lit(0))).cast("long")


def effective_tip() -> Column:
    """What a transaction pays above its block's base fee; null where its cap doesn't reach it."""
    return F.when(F.col("max_fee") >= F.col("base_fee"), F.least("tip", F.col("max_fee") - F.col("base_fee")))


def rewards_of_blocks(txs: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """number, rewards: per block the effective tips (0 below the base fee) at which the running gas, by ascending
    tip, reaches each percentile of the block's gas; the last one stands in. txs: number, tx_num, gas, tip, max_fee, base_fee."""
    order = Window.partitionBy("number").orderBy("reward", "tx_num")
    ranked = txs.select("number", "tx_num", "gas", F.coalesce(effective_tip(), F.lit(0)).alias("reward"))
    ranked = ranked.withColumns({"reached": F.sum("gas").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("gas").over(Window.partitionBy("number"))})
    at = [F.coalesce(F.min(F.when(F.col("reached") >= F.floor(F.col("total") * float(p) / 100.0), F.col("reward"))), F.max("reward")) for p in percentiles]
    return ranked.groupBy("number").agg(F.array(*at).alias("rewards"))


def reward_grid(txs: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """number, grid: the rewards at 0, 1 / resolution, ... 100 percent of the block's gas, as rewards_of_blocks defines them."""
    run = lambda s, k: F.array_repeat(s["reward"], (s["held"] - F.coalesce(F.get("steps", k - 1)["held"], F.lit(0))).cast("int"))
    return reward_steps(txs, resolution).select("number", F.flatten(F.transform("steps", run)).alias("grid"))


def reward_steps(txs: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """number, steps (held, reward): the grid of reward_grid without its repetitions.

    Each transaction stands for the points that the running gas reaches with it: of the grid's points, so many as
    held have been reached. A block has no more steps than transactions, or than points.
    """
    div = lambda a, b: F.call_function("div", a, b)
    points = 100 * resolution
    order = Window.partitionBy("number").orderBy("reward", "tx_num")
    ranked = txs.select("number", "tx_num", F.col("gas").cast("long").alias("gas"), F.coalesce(effective_tip(), F.lit(0)).cast("long").alias("reward"))
    ranked = ranked.withColumns({"reached": F.sum("gas").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("gas").over(Window.partitionBy("number"))})
    held = F.when(F.col("total") > 0, F.least(div((F.col("reached") + 1) * points + F.col("total") - 1, F.col("total")), F.lit(points + 1))).otherwise(points + 1)
    counted = ranked.withColumn("held", held.cast("long")).withColumn("more", F.col("held") > F.lag("held", 1, 0).over(order))
    return counted.where("more").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("held", "reward"))).alias("steps"))


def rewards_from_grid(headers: DataFrame, grid: DataFrame, percentiles: Sequence[float], resolution: int = RESOLUTION) -> DataFrame:
    """number, p, reward: the point of the grid next to each percentile (outside of 0 to 100 the end); 0 without transactions."""
    return _at_points(headers.select("number").join(grid, "number", "left"), lambda k: F.element_at("grid", k + 1), percentiles, resolution)


def rewards_from_steps(headers: DataFrame, steps: DataFrame, percentiles: Sequence[float], resolution: int = RESOLUTION) -> DataFrame:
    """What rewards_from_grid gives, from reward_steps: a point's reward is that of the first step that holds it."""
    return _at_points(headers.select("number").join(steps, "number", "left"), lambda k: F.get(F.filter("steps", lambda s: s["held"] > k), 0)["reward"], percentiles, resolution)


def _at_points(rows: DataFrame, point, percentiles: Sequence[float], resolution: int) -> DataFrame:
    at = [min(max(floor(p * resolution + 0.5), 0), 100 * resolution) for p in percentiles]
    named = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.coalesce(point(F.lit(k)), F.lit(0)).cast("long").alias("reward")) for p, k in zip(percentiles, at)])
    return rows.select("number", F.inline(named).alias("p", "reward"))


def full_fee_history(headers: DataFrame, txs: DataFrame, first: int, last: int, percentiles: Sequence[float], blobs: DataFrame | None = None, blob_limit: int = 6, blob_target: int = 3) -> DataFrame:
    """number, base_fee, gas_used_ratio, rewards, blob_base_fee, blob_gas_used_ratio of a range, and a last row with the fees after it.

    blobs: number, blobs (carried by the block), excess (blob gas above target before it); blocks without a row
    carry none. Rewards of a block without transactions are zeros; percentiles must ascend within 0 and 100.
    """
    if list(percentiles) != sorted(percentiles) or any(not 0 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles must ascend within 0 and 100")
    if last < first or last - first >= MAX_HISTORY:
        raise ValueError(f"a range of 1 to {MAX_HISTORY} blocks")
    history = fee_history(headers, first, last).join(rewards_of_blocks(txs, percentiles), "number", "left")
    zeros = F.array(*[F.lit(0).cast("long") for _ in percentiles])
    history = history.withColumn("rewards", F.when(F.col("number") <= last, F.coalesce("rewards", zeros)))
    if blobs is None:
        blobs = headers.select("number", F.lit(0).alias("blobs"), F.lit(0).alias("excess")).limit(0)
    mine = blobs.where(F.col("number").between(first, last))
    after = mine.where(F.col("number") == last).select((F.col("number") + 1).alias("number"), F.lit(0).alias("blobs"), next_excess(F.col("excess"), F.col("blobs"), blob_target).alias("excess"))
    joined = history.join(mine.select("number", "blobs", "excess").unionByName(after), "number", "left").fillna(0, ["blobs", "excess"])
    ratio = F.when(F.col("number") <= last, F.col("blobs") / F.lit(float(blob_limit)))
    return joined.select("number", "base_fee", "gas_used_ratio", "rewards", blob_base_fee(F.col("excess")).alias("blob_base_fee"), ratio.alias("blob_gas_used_ratio"))


def next_excess(excess: Column, blobs: Column, target: int = 3, gas_per_blob: int = GAS_PER_BLOB) -> Column:
    """Blob gas above target after a block."""
    return F.greatest(excess + (blobs - target) * gas_per_blob, F.lit(0)).cast("long")


def excess_blob_gas(blobs: DataFrame, target: int = 3, gas_per_blob: int = GAS_PER_BLOB) -> DataFrame:
    """blobs (number, blobs; all numbers from 0 on) with excess: blob gas above target before each block.

    The excess never falls below zero, so it is the running sum above target less its smallest value so far.
    """
    rows = prefix_sums(blobs.withColumn("above", ((F.col("blobs") - target) * gas_per_blob).cast("long")), "number", "above", "sum")
    return prefix_minima(rows, "number", "sum", "low").withColumn("excess", (F.col("sum") - F.least("low", F.lit(0))).cast("long")).drop("above", "sum", "low")


def blob_base_fee(excess: Column, update_fraction: int = UPDATE_FRACTION, least: int = 1) -> Column:
    """least * e^(excess / update_fraction) by its series, in integers; terms are folded until they vanish.

    A hundred terms reach a fee of e^30 and more, where 64-bit fees end.
    """
    div = lambda a, b: F.call_function("div", a, b)
    wide = lambda x: x.cast("decimal(38,0)")
    start = F.struct(wide(F.lit(0)).alias("sum"), wide(F.lit(least * update_fraction)).alias("term"))
    step = lambda acc, k: F.struct((acc["sum"] + acc["term"]).cast("decimal(38,0)").alias("sum"), wide(div((acc["term"] * wide(excess)).cast("decimal(38,0)"), wide(F.lit(update_fraction) * k))).alias("term"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long")), start, step, lambda acc: div(acc["sum"], wide(F.lit(update_fraction))).cast("long"))


def gas_price(tip: DataFrame, headers: DataFrame) -> DataFrame:
    """One row: the suggested tip (tip) above the base fee of the latest block."""
    base = headers.agg(F.max_by("base_fee", "number")).first()[0]
    return tip.select((F.col("tip") + F.lit(base)).alias("gas_price"))


def tips_at_capacity(txs: DataFrame, headers: DataFrame, least: int, ceiling: int = CEILING) -> DataFrame:
    """number, tip: per block the least suggestion, or a tenth above the median effective tip where the block was full.

    A block is full if its gas and that of its largest transaction together exceed its limit. txs: number,
    gas, tip, max_fee, base_fee; transactions whose cap doesn't reach the base fee don't count for the median.
    """
    place = F.row_number().over(Window.partitionBy("number").orderBy("effective", "tx_num"))
    own = txs.select("number", "tx_num", "gas", effective_tip().alias("effective"))
    placed = own.where("effective IS NOT NULL").withColumns({"place": place, "n": F.count(F.lit(1)).over(Window.partitionBy("number"))})
    middle = F.call_function("div", F.col("n"), F.lit(2))
    high, low = F.max(F.when(F.col("place") == middle + 1, F.col("effective"))), F.max(F.when(F.col("place") == middle, F.col("effective")))
    medians = placed.groupBy("number").agg(F.when(F.max("n") % 2 == 1, high).otherwise(F.call_function("div", low + high, F.lit(2))).alias("median"))
    largest = own.groupBy("number").agg(F.max("gas").alias("largest"))
    joined = headers.select("number", "gas_used", "gas_limit").join(largest, "number", "left").join(medians, "number", "left")
    raised = F.col("median") + F.call_function("div", F.col("median"), F.lit(10))
    full = F.col("gas_used") + F.coalesce("largest", F.lit(0)) > F.col("gas_limit")
    return joined.select("number", F.least(F.when(full & F.col("median").isNotNull(), F.greatest(raised, F.lit(least))).otherwise(F.lit(least)), F.lit(ceiling)).cast("long").alias("tip"))


def fee_history(headers: DataFrame, first: int, last: int) -> DataFrame:
    """number, base_fee, gas_used_ratio of the range, and the base fee after it (ratio null)."""
    rows = headers.where(F.col("number").between(first, last))
    after = rows.where(F.col("number") == last).select((F.col("number") + 1).alias("number"), next_base_fee(F.col("base_fee"), F.col("gas_used"), F.col("gas_limit")).alias("base_fee"), F.lit(None).cast("double").alias("gas_used_ratio"))
    return rows.select("number", "base_fee", (F.col("gas_used") / F.col("gas_limit")).alias("gas_used_ratio")).unionByName(after)


def lowest_tips(txs: DataFrame, sample: int = SAMPLE, ignore_below: int = 2) -> DataFrame:
    """number, place, tip: the lowest effective tips of each block, without the beneficiary's own and very low ones.

    txs: number, tx_num, sender, tip, max_fee, and base_fee and beneficiary of the block; a transaction whose cap
    doesn't reach the base fee has no tip.
    """
    paid = txs.where(F.col("sender") != F.col("beneficiary")).select("number", "tx_num", effective_tip().alias("tip"))
    own = paid.where(F.col("tip") >= ignore_below)
    place = F.row_number().over(Window.partitionBy("number").orderBy("tip", "tx_num"))
    return own.withColumn("place", place.cast("long")).where(F.col("place") <= sample).select("number", "place", "tip")


def suggested_tip(txs: DataFrame, headers: DataFrame, head: int, blocks: int = BLOCKS, percentile: int = PERCENTILE, sample: int = SAMPLE, max_history: int = MAX_HISTORY, ceiling: int = CEILING) -> DataFrame:
    """One row: the tip at the percentile of the lowest tips of the latest blocks.

    At most min(head, 2 * max_history) blocks are looked at, newest first, until `blocks` of them had
    a sample; a block without one counts as a tip of 0.
    """
    in_reach = (F.col("number") <= head) & (F.col("number") > head - min(head, 2 * max_history))
    filled = headers.where(in_reach).select("number").join(lowest_tips(txs.where(in_reach), sample), "number", "left")
    per_block = filled.groupBy("number").agg(F.count("tip").alias("n"))
    # Populated blocks so far, newest first; the window holds one row for each of the blocks looked at.
    seen = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(Window.orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1))
    used = per_block.withColumn("seen", F.coalesce(seen, F.lit(0))).where(F.col("seen") < blocks).select("number")
    values = filled.join(used, "number").select(F.coalesce("tip", F.lit(0)).alias("tip"))
    listed = values.agg(F.array_sort(F.collect_list("tip")).alias("tips"))  # sample * (2 * max_history) values at most
    return listed.select(F.least(F.coalesce(F.expr(f"element_at(tips, cast((size(tips) - 1) * {percentile} div 100 as int) + 1)"), F.lit(0)), F.lit(ceiling)).cast("long").alias("tip"))


def median_tips(txs: DataFrame) -> DataFrame:
    """number, median_tip, max_gas: the median of each block's effective tips (null where no cap reaches its base fee)."""
    return txs.groupBy("number").agg(F.median(effective_tip()).alias("median_tip"), F.max("gas").alias("max_gas"))
