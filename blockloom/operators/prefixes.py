"""Sets of keys asked by prefix or range: sorted keys, merged with the boundaries that are looked for.

A range holds a key exactly if the first key at or after its start lies before its end. Starts and keys are
merged in the order of keys, split at the keys' first characters, so no task gets all and nothing is crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import next_within

#: Characters of a key that name its part of the order, and what sorts after every hexadecimal digit.
PART, AFTER = 2, "g"


def first_keys(starts: DataFrame, keys: DataFrame, start: str = "start", key: str = "key") -> DataFrame:
    """start, key: the first key at or after each start; null if there is none."""
    asked = starts.select(F.col(start).alias("at")).distinct().select(F.struct("at", F.lit(0).alias("kind")).alias("place"), F.lit(None).cast("string").alias("own"))
    held = keys.select(F.col(key).alias("at")).distinct().select(F.struct("at", F.lit(1).alias("kind")).alias("place"), F.col("at").alias("own"))
    found = next_within(asked.unionByName(held), [], "place", "own", "key", slot=F.substring("place.at", 1, PART))
    return found.where("place.kind = 0").select(F.col("place.at").alias(start), "key")


def contains_range(ranges: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """ranges (start, end: exclusive, null is unbounded) with held: whether a key lies in the range."""
    found = ranges.join(first_keys(ranges, keys, "start", key).withColumnRenamed("key", "__first"), "start")
    return found.withColumn("held", F.col("__first").isNotNull() & (F.col("end").isNull() | (F.col("__first") < F.col("end")))).drop("__first")


def contains(prefixes: DataFrame, keys: DataFrame, prefix: str = "prefix", key: str = "key") -> DataFrame:
    """prefixes with held: whether a key begins with the prefix. Keys are hexadecimal digits in lower case."""
    ranges = prefixes.select("*", F.col(prefix).alias("start"), F.concat(prefix, F.lit(AFTER)).alias("end"))
    return contains_range(ranges, keys, key).drop("start", "end")


def retain_difference(paths: DataFrame, changed: DataFrame, path: str = "path", key: str = "key") -> DataFrame:
    """The paths below which no key has changed: what is stored for them stays right."""
    return contains(paths, changed, path, key).where("NOT held").drop("held")
