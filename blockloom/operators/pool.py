"""Transaction pool: sub-pools, best order, gaps, balances, eviction, replacement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import position_within, positions, running_sums, take_until
from ..sources.shared import written

# Bits of a transaction's state, from the weakest to the strongest.
BLOB, BLOB_FEE_CAP, FEE_CAP, NOT_HEAVY, BALANCE, NO_GAPS, NO_PARKED = 2, 4, 8, 16, 32, 64, 128
#: Limits and price bumps in percent.
MAX_PER_SENDER, BUMP, BLOB_BUMP = 16, 10, 100


def priority(base_fee: int) -> Column:
    """Effective tip at a base fee; null, and so last, when the fee does not cover it."""
    return F.when(F.col("max_fee") >= base_fee, F.least("max_tip", F.col("max_fee") - base_fee))


def with_state(pool: DataFrame, balances: DataFrame, base_fee: int, block_gas: int, blob_fee: int = 1) -> DataFrame:
    """pool with cumulative_cost, state and subpool. balances: sender, balance, next_nonce (missing: 0).

    Costs and gaps run along a sender's nonces; the blob-fee bit is always set where there are no blobs.
    A transaction has parked ancestors if any earlier one lacks a bit of its own. The sub-pool follows from
    comparing the state as a number, strongest bit first.
    """
    order = Window.partitionBy("sender").orderBy("nonce")
    rows = pool.join(balances, "sender", "left").fillna(0, ["balance", "next_nonce"])
    rows = rows.withColumn("cumulative_cost", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = {
        BLOB_FEE_CAP: ~F.col("is_blob") | (F.col("blob_fee") >= blob_fee), FEE_CAP: F.col("max_fee") >= base_fee, NOT_HEAVY: F.col("gas") <= block_gas,
        BALANCE: F.col("cumulative_cost") <= F.col("balance"), NO_GAPS: F.col("nonce") - F.col("next_nonce") == F.row_number().over(order) - 1,
    }
    bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    rows = rows.withColumn("own", sum((bit(c, b) for b, c in own.items()), F.lit(0)))
    ready = F.every(F.col("own") == sum(own)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    state = F.col("own") + bit(F.col("is_blob"), BLOB) + bit(F.coalesce(ready, F.lit(True)), NO_PARKED)
    rows = rows.withColumn("state", state.cast("long"))
    return rows.withColumn("subpool", subpool(F.col("state"))).drop("own")


def subpool(state: Column) -> Column:
    """pending, basefee, blob or queued by ordered comparison of the state."""
    ready = NO_PARKED + NO_GAPS + BALANCE + NOT_HEAVY
    blob = state.bitwiseAND(F.lit(BLOB)) > 0
    return F.when(state >= ready + FEE_CAP + BLOB_FEE_CAP, F.lit("pending")).when(blob, F.lit("blob")).when(state >= ready, F.lit("basefee")).otherwise(F.lit("queued"))


def promoted(parked: DataFrame, base_fee: int) -> DataFrame:
    """The parked transactions that a base fee releases: a sender's first, by nonce, that can't pay holds back all after it."""
    held = F.every(F.col("max_fee") >= base_fee).over(Window.partitionBy("sender").orderBy("nonce").rowsBetween(Window.unboundedPreceding, 0))
    return parked.withColumn("released", held).where("released").drop("released")


def best_order(pool: DataFrame, base_fee: int) -> DataFrame:
    """pool with the key by which it would be taken: a transaction waits for the sender's earlier nonces,
    so it ranks by the lowest (priority, earliest submission) among them, then by nonce."""
    rank = F.struct(F.coalesce(priority(base_fee), F.lit(-1)).alias("priority"), (-F.col("submission_id")).alias("age"))
    held = F.min(rank).over(Window.partitionBy("sender").orderBy("nonce").rowsBetween(Window.unboundedPreceding, 0))
    return pool.withColumn("held", held).select("*", F.col("held.priority").alias("held_priority"), (-F.col("held.age")).alias("held_by")).drop("held")


def best(pool: DataFrame, base_fee: int, n: int) -> DataFrame:
    """The next n transactions in the order in which they would be taken."""
    return best_order(pool, base_fee).orderBy(F.desc("held_priority"), "held_by", "nonce").limit(n)


def accepted(pool: DataFrame, predicate: Column) -> DataFrame:
    """pool without what a filter refuses, and without what waits for it: a sender's later nonces."""
    refused = pool.where(~F.coalesce(predicate, F.lit(False))).groupBy("sender").agg(F.min("nonce").alias("__refused"))
    return pool.join(refused, "sender", "left").where("__refused IS NULL OR nonce < __refused").drop("__refused")


def prioritized(pool: DataFrame, senders: DataFrame, base_fee: int, max_gas: int) -> DataFrame:
    """pool with place (0, 1, ...): transactions of the named senders first, as many as fit, then all others in their order.

    In the order in which they would be taken, one of a named sender goes ahead if its gas still fits what is
    left of max_gas; one that doesn't fit is passed over and stays among the others. Step by step, what can't
    fit any more is left out, and the longest run that fits together is taken by running sums.
    """
    ordered = best_order(pool, base_fee).withColumns({"worth": -F.coalesce("held_priority", F.lit(-1)), "wait": F.col("held_by")})
    rank = F.row_number().over(Window.partitionBy("worth").orderBy("wait", "nonce")) - 1
    per_worth = ordered.groupBy("worth").agg(F.count(F.lit(1)).alias("n"))
    starts = running_sums(per_worth, "worth", {"before": "n"}).drop("n")
    ranked = written(ordered.withColumn("rank", rank).join(starts, "worth").withColumn("rank", (F.col("before") + F.col("rank")).cast("long")).drop("worth", "wait", "before", "held_priority", "held_by"))
    mine = ranked.join(senders.select("sender").distinct(), "sender", "left_semi").select("rank", "gas")
    after, left, ahead = -1, max_gas, None
    while True:
        fitting = mine.where((F.col("rank") > after) & (F.col("gas") <= left))
        summed = running_sums(fitting, "rank", {"sum": "gas"}).withColumn("sum", F.col("sum") + F.col("gas"))
        ends = summed.agg(F.min(F.when(F.col("sum") > left, F.col("rank"))).alias("stop"), F.max("rank").alias("last")).first()
        if ends["last"] is None:
            break
        run = fitting if ends["stop"] is None else fitting.where(F.col("rank") < ends["stop"])
        ahead = run if ahead is None else ahead.unionByName(run)
        if ends["stop"] is None:
            break
        after, left = ends["stop"], left - run.agg(F.sum("gas")).first()[0]
    chosen = ranked.select("rank").limit(0) if ahead is None else ahead.select("rank")
    both = ranked.join(chosen.withColumn("ahead", F.lit(True)), "rank", "left").withColumn("turn", F.when(F.col("ahead"), F.col("rank")).otherwise(F.col("rank") + F.lit(1 << 40)))
    return positions(both, "turn", "place").drop("turn", "rank", "ahead")


def consecutive(pool: DataFrame, next_nonces: DataFrame) -> DataFrame:
    """sender, nonce, submission_id of the highest transaction that is reached from the sender's next nonce without a gap."""
    rows = pool.join(next_nonces, "sender", "left").fillna(0, ["next_nonce"]).where(F.col("nonce") >= F.col("next_nonce"))
    island = F.col("nonce") - F.row_number().over(Window.partitionBy("sender").orderBy("nonce")) + 1
    first = rows.withColumn("island", island).where(F.col("island") == F.col("next_nonce"))
    return first.groupBy("sender").agg(F.max("nonce").alias("nonce"), F.max_by("submission_id", "nonce").alias("submission_id"))


def evicted(pool: DataFrame, base_fee: int, max_count: int, max_bytes: int) -> DataFrame:
    """submission_id, pass, round of what goes until the pool is within both limits.

    In each round every sender's highest nonce goes, the lowest priorities first. The first pass spares local
    transactions, and with them what a sender has below; only if that is not enough, a second pass takes any.
    The pool is ranked once: what the first pass may take of a sender lies above what it spares, so rounds
    of the second are places less what the first took.
    """
    local = pool.where("is_local").groupBy("sender").agg(F.max("nonce").alias("top_local"))
    rows = pool.join(local, "sender", "left").withColumns({"down": -F.col("nonce"), "spared": F.coalesce(F.col("nonce") <= F.col("top_local"), F.lit(False))})
    ranked = position_within(rows, ["sender"], "down", "round")
    free = ranked.where("NOT spared").groupBy("sender").agg(F.count(F.lit(1)).alias("free"))
    ranked = ranked.join(free, "sender", "left").withColumn("round", F.when(F.col("spared"), F.col("round") - F.coalesce("free", F.lit(0))).otherwise(F.col("round")))
    ranked = ranked.withColumns({"worth": F.coalesce(priority(base_fee), F.lit(-1)), "age": -F.col("submission_id"), "one": F.lit(1)})
    ranked = written(ranked.select("submission_id", "spared", "round", "worth", "age", "one", "size"))
    sums = {r["spared"]: r for r in ranked.groupBy("spared").agg(F.sum("one").alias("one"), F.sum("size").alias("size")).collect()}  # two rows
    held = {c: sum(r[c] for r in sums.values()) for c in ("one", "size")}
    needs = {"one": held["one"] - max_count, "size": held["size"] - max_bytes}
    goes = None
    for spared in (False, True):
        out = take_until(ranked.where(F.col("spared") == spared), ["round", "worth", "age"], needs).select("submission_id", F.lit(2 if spared else 1).alias("pass"), (F.col("round") + 1).alias("round"))
        goes = out if goes is None else goes.unionByName(out)
        needs = {c: n - (sums[spared][c] if spared in sums else 0) for c, n in needs.items()}
        if all(n <= 0 for n in needs.values()):
            break
    return goes


def truncated(parked: DataFrame, max_count: int, max_bytes: int) -> DataFrame:
    """submission_id of parked transactions that go until both limits are met: whole senders, the least
    recently submitting first, each from its highest nonce down."""
    sums = parked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    latest = parked.groupBy("sender").agg(F.max("submission_id").alias("latest"))
    rows = parked.join(latest, "sender").withColumns({"down": -F.col("nonce"), "one": F.lit(1)})
    return take_until(rows, ["latest", "down"], {"one": sums["n"] - max_count, "size": sums["bytes"] - max_bytes}).select("submission_id")


def replacements(pool: DataFrame, offers: DataFrame, bump: int = BUMP, blob_bump: int = BLOB_BUMP) -> DataFrame:
    """offers (sender, nonce, max_fee, max_tip, is_blob, submission_id) with accepted: new, or both fees higher by the bump."""
    old = pool.select("sender", "nonce", F.col("max_fee").alias("old_fee"), F.col("max_tip").alias("old_tip"))
    joined = offers.join(old, ["sender", "nonce"], "left")
    factor = F.when(F.col("is_blob"), F.lit(100 + blob_bump)).otherwise(F.lit(100 + bump))
    enough = (F.col("max_fee") * 100 >= F.col("old_fee") * factor) & (F.col("max_tip") * 100 >= F.col("old_tip") * factor)
    return joined.withColumn("accepted", F.col("old_fee").isNull() | enough)


def fee_delta(fee: Column, current: Column) -> Column:
    """How many doublings of 12.5 % steps lie between a fee and the current one, signed.

    Both fees count by their whole binary logarithm (0 for a fee of 0); their distance in steps is rounded
    away from zero, and its own whole logarithm is the result; 0 for less than a step.
    """
    whole = lambda x: F.when(x > 0, F.length(F.bin(x)) - 1).otherwise(F.lit(0))
    steps = (whole(fee) - whole(current)) / F.lit(math.log2(1.125))
    far = whole(F.ceil(F.abs(steps)))
    return F.when(F.abs(steps) < 1, F.lit(0)).otherwise(F.when(steps > 0, far).otherwise(-far)).cast("long")


def blob_priority(base_fee: int, blob_fee: int) -> Column:
    """Of blob transactions: the worse of both distances to the current fees, 0 at best."""
    return F.least(fee_delta(F.col("blob_fee"), F.lit(blob_fee)), fee_delta(F.col("max_fee"), F.lit(base_fee)), F.lit(0)).cast("long")


def over_cap(pool: DataFrame, cap: int = MAX_PER_SENDER) -> DataFrame:
    """Senders with more transactions than allowed."""
    return pool.groupBy("sender").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)


def within_bytes(pool: DataFrame, senders: list | None, limit: int) -> DataFrame:
    """The longest prefix, by submission, of each sender's transactions whose sizes fit the limit; None takes all senders."""
    running = F.sum("size").over(Window.partitionBy("sender").orderBy("submission_id").rowsBetween(Window.unboundedPreceding, 0))
    asked = pool if senders is None else pool.where(F.col("sender").isin(senders))
    return asked.withColumn("bytes", running).where(F.col("bytes") <= limit)
