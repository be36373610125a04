"""Table tools: diff, filtered listing, checksum, statistics; merging of state layers; hash trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import positions


def diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and kind: rows with other values ('changed'), only left, or only right. Null keys are not equal to anything."""
    a = left.select(*keys, F.struct(*values).alias("l"))
    b = right.select(*keys, F.struct(*values).alias("r"))
    joined = a.join(b, keys, "full_outer")
    kind = F.when(F.col("r").isNull(), F.lit("only left")).when(F.col("l").isNull(), F.lit("only right")).when(~F.col("l").eqNullSafe(F.col("r")), F.lit("changed"))
    return joined.select(*keys, kind.alias("kind")).where("kind IS NOT NULL")


def listing(df: DataFrame, key: str, skip: int, length: int | None, predicate: Column, reverse: bool = False) -> DataFrame:
    """Rows in order of a unique, integral key: skip counts all rows, length those that match; None takes every match.

    Rows are numbered by counts of key ranges, so that skipping needs no task with all rows.
    """
    placed = positions(df.withColumn("__key", -F.col(key) if reverse else F.col(key)), "__key", "__at")
    ordered = placed.where((F.col("__at") >= skip) & predicate).orderBy("__key").drop("__key", "__at")
    return ordered if length is None else ordered.limit(length)


def contains_bytes(columns: list[str], needle: str) -> Column:
    """Whether any of the columns, as bytes, holds the needle's bytes."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.encode(F.col(c).cast("string"), "UTF-8"), F.encode(F.lit(needle), "UTF-8"))
    return out


def checksum(df: DataFrame) -> DataFrame:
    """rows, checksum: the same whatever the order of the rows and the partitions; equal rows count each."""
    h = F.conv(F.substring(F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, columns of each table and a row of totals."""
    each = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")) for n, df in tables.items()]
    both = each[0]
    for df in each[1:]:
        both = both.unionByName(df)
    return both.rollup("name").agg(F.sum("rows").alias("rows"), F.sum("columns").alias("columns")).select(F.coalesce("name", F.lit("total")).alias("name"), "rows", "columns")


def extend(layers: DataFrame, key: str, version: str, value: str, wiped: str) -> DataFrame:
    """key, value after all layers: later versions win, and a wiped layer voids what lies below it."""
    last_wipe = layers.groupBy(key).agg(F.max(F.when(F.col(wiped), F.col(version))).alias("__wipe"))
    live = layers.join(last_wipe, key).where(F.col("__wipe").isNull() | (F.col(version) >= F.col("__wipe")))
    return live.groupBy(key).agg(F.max_by(value, version).alias(value))


def prefix_sets(keys: DataFrame, column: str, length: int) -> DataFrame:
    """The distinct prefixes of changed keys."""
    return keys.select(F.substring(column, 1, length).alias("prefix")).distinct()


def partitioned_by(df: DataFrame, targets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the targets, and the others."""
    return df.join(targets, keys, "left_semi"), df.join(targets, keys, "left_anti")


def tree_depth(leaves: int, per_group: int = 1000) -> int:
    """The depth at which a group of evenly spread leaves has about so many at most."""
    depth = 1
    while leaves > per_group * 16**depth:
        depth += 1
    return depth


def content_digests(leaves: DataFrame, depth: int) -> DataFrame:
    """level, path, hash of a 16-way tree over leaves (path: hex key, hash).

    At each level the hashes below a prefix are joined in path order and hashed, so equal contents give
    equal roots. depth should grow with the table, so that groups stay small: see tree_depth.
    """
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda s: s["hash"]), ""), 256)
    level = leaves.groupBy(F.substring("path", 1, depth).alias("p")).agg(joined().alias("hash")).select(F.col("p").alias("path"), "hash")
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("path", 1, d).alias("p")).agg(joined().alias("hash")).select(F.col("p").alias("path"), "hash")
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select(F.col("level").cast("long").alias("level"), "path", "hash")


def within_budget(df: DataFrame, part: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Per part the longest prefix whose sizes fit the limit; its first row always comes."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).where((F.col("__before") == 0) | (F.col("__before") + F.col(size) <= limit)).drop("__before")
