"""Retention: prune modes, and exceptions for rows that carry something to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def should_prune(mode: str, value: int | None, tip: int, minimum: int = 0, number: str = "number") -> Column:
    """Whether a row's block goes: all beyond the minimum distance, beyond a distance, or before a block."""
    if mode == "full":
        mode, value = "distance", minimum
    if mode == "distance":
        if value < minimum:
            raise ValueError(f"a distance of {value} is below the minimum of {minimum}")
        return F.col(number) < tip - value
    if mode == "before":
        return F.col(number) < value
    raise ValueError(f"unknown mode {mode}")


def prune_logs(logs: DataFrame, rules: DataFrame, target: int) -> DataFrame:
    """Logs above the target, and older ones of an address from the block that its rule names.

    rules (address, from_block) come from configuration and are few; several rules of an address
    count as the earliest one.
    """
    first = rules.groupBy("address").agg(F.min("from_block").alias("from_block"))
    old = logs.where(F.col("block") <= target).join(first, "address").where(F.col("block") >= F.col("from_block")).drop("from_block")
    return logs.where(F.col("block") > target).unionByName(old.select(logs.columns))


def keep_with_allowed(rows: DataFrame, allowed: DataFrame, key: str, target: int, number: str = "number") -> DataFrame:
    """Rows above the target, and older ones whose key is allowed."""
    return rows.where(F.col(number) > target).unionByName(rows.where(F.col(number) <= target).join(allowed, key, "left_semi").select(rows.columns))
