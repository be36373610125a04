"""What bodies carry beside transactions: withdrawals and blobs, their checks, and answers to requests for bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chain import with_parent
from .fees import GAS_PER_BLOB

#: Bodies of one answer, and its bytes after which no other body follows.
MOST_SERVED, SOFT_LIMIT = 1024, 2 << 20


def listed(paid: Column) -> Column:
    """Withdrawals (index, validator, address, amount) as text, in the list's order."""
    text = lambda w: F.concat_ws(":", *[w[c].cast("string") for c in ("index", "validator", "address", "amount")])
    return F.array_join(F.transform(paid, text), ",")


def withdrawals_root(paid: Column) -> Column:
    """The digest of a list of withdrawals."""
    return F.sha2(listed(paid), 256)


def withdrawal_faults(blocks: DataFrame) -> DataFrame:
    """number, fault of blocks whose body has no withdrawals, whose header names no root of them, or another one.

    blocks: number, withdrawals (an array; an empty one has a root too), withdrawals_root. The first fault is named.
    """
    fault = F.when(F.col("withdrawals").isNull(), "withdrawals missing").when(F.col("withdrawals_root").isNull(), "withdrawals root missing")
    return blocks.select("number", fault.when(F.col("withdrawals_root") != withdrawals_root(F.col("withdrawals")), "withdrawals root").alias("fault")).where("fault IS NOT NULL")


def withdrawn(blocks: DataFrame) -> DataFrame:
    """address, n, amount: what withdrawals brought each address."""
    each = blocks.select(F.explode("withdrawals").alias("w")).select("w.address", "w.amount")
    return each.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def blob_faults(headers: DataFrame, target: int = 3, limit: int = 6, gas_per_blob: int = GAS_PER_BLOB) -> DataFrame:
    """number, fault: each blob rule that a header breaks on its own, against its body or against its parent.

    headers: number, blobs (of the body), blob_gas_used, excess_blob_gas. A parent that names none counts as 0; a
    header without a parent isn't compared with one.
    """
    rows = with_parent(headers, ("number", "blob_gas_used", "excess_blob_gas"))
    used, excess = F.col("blob_gas_used"), F.col("excess_blob_gas")
    follows = F.greatest(F.coalesce("p_excess_blob_gas", F.lit(0)) + F.coalesce("p_blob_gas_used", F.lit(0)) - target * gas_per_blob, F.lit(0))
    rules = {
        "blob gas missing": used.isNull(),
        "excess blob gas missing": excess.isNull(),
        "blob gas is not that of the body": used != F.col("blobs") * gas_per_blob,
        "blob gas is not whole blobs": used % gas_per_blob != 0,
        "blob gas beyond limit": used > limit * gas_per_blob,
        "excess blob gas": (F.col("p_number") == F.col("number") - 1) & (excess != follows),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select("number", F.explode(broken).alias("fault"))


def answered(requests: DataFrame, found: DataFrame, on: str, size: str = "size", most: int = MOST_SERVED, budget: int = SOFT_LIMIT) -> DataFrame:
    """requests (place, on) with their rows of found, nulls per miss, in order until `most` are named or their bytes exceed the budget.

    The row with which the bytes exceed it is the last one that is sent; misses have no bytes. Requests beyond the
    first `most` aren't looked up, so the window holds as many rows at most.
    """
    first = requests.orderBy("place").limit(most)
    rows = first.join(found, on, "left")
    before = F.sum(F.coalesce(size, F.lit(0))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= budget).drop("before")
