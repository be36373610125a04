"""Batch stages: ranges from checkpoints, transaction numbering, index building, cold segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import next_within, prefix_sums
from ..sources.shared import written
from .tree import followed

#: Blocks of a stretch within which batches are followed in one task.
STRETCH = 1 << 16


def append_bodies(known: DataFrame, new: DataFrame) -> DataFrame:
    """number, first_tx_num, tx_count, last_tx_num of new blocks, numbered on from the known ones."""
    start = known.agg(F.coalesce(F.max(F.col("first_tx_num") + F.col("tx_count")), F.lit(0))).first()[0]
    rows = prefix_sums(new, "number", "tx_count", "first_tx_num").withColumn("first_tx_num", F.col("first_tx_num") + start)
    return rows.select("number", "first_tx_num", "tx_count", F.when(F.col("tx_count") > 0, F.col("first_tx_num") + F.col("tx_count") - 1).alias("last_tx_num"))


def batches_by_transactions(body_indices: DataFrame, threshold: int) -> DataFrame:
    """Blocks in batches of about so many transactions."""
    batch = F.floor((F.col("first_tx_num") + F.greatest("tx_count", F.lit(1)) - 1) / threshold).alias("batch")
    return body_indices.groupBy(batch).agg(F.min("number").alias("first_block"), F.max("number").alias("last_block"), F.sum("tx_count").alias("txs"))


def next_range(body_indices: DataFrame, checkpoint: int, max_txs: int) -> DataFrame:
    """The blocks after a checkpoint that hold at most so many transactions together."""
    start = body_indices.where(F.col("number") == checkpoint + 1).select("first_tx_num").first()
    rows = body_indices.where(F.col("number") > checkpoint).where(F.col("first_tx_num") + F.col("tx_count") - F.lit(start[0] if start else 0) <= max_txs)
    return rows.agg(F.lit(checkpoint + 1).cast("long").alias("first_block"), F.max("number").alias("last_block"), F.sum("tx_count").alias("txs"))


def batch_ends(blocks: DataFrame, max_blocks: int, limits: dict[str, int]) -> DataFrame:
    """number, end: where a batch that begins with a block ends: with its max_blocks-th block, or with the first at
    which the sum of an amount reaches its limit, or with the last block there is.

    blocks: number (all from the first on), and the amounts, none negative. Sums that are looked for and sums
    that are reached are merged in order, in ranges of sums, so no task gets all blocks and none are crossed.
    """
    last = blocks.agg(F.max("number")).first()[0]
    out = blocks.select("number", F.least(F.col("number") + (max_blocks - 1), F.lit(last)).alias("end"))
    for amount, limit in limits.items():
        sums = prefix_sums(blocks.select("number", F.col(amount).alias("__n")), "number", "__n", "__before")
        place = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.col("number").alias("number")).alias("place")
        asked = sums.select(place(F.col("__before") + limit, 0), F.lit(None).cast("long").alias("own"))
        reached = sums.select(place(F.col("__before") + F.col("__n"), 1), F.col("number").alias("own"))
        found = next_within(asked.unionByName(reached), [], "place", "own", "reached", slot=F.floor(F.col("place.at") / (1024 * limit)))
        out = out.join(found.where("place.kind = 0").select(F.col("place.number").alias("number"), "reached"), "number").select("number", F.least("end", "reached").alias("end"))
    return out


def batches(blocks: DataFrame, first: int, max_blocks: int, limits: dict[str, int]) -> DataFrame:
    """first, last of the batches from a block on, each as long as batch_ends allows; the next begins after it."""
    ends = written(batch_ends(blocks.where(F.col("number") >= first), max_blocks, limits))
    last = ends.agg(F.max("number")).first()[0]
    after = F.when(F.col("end") < F.lit(last), F.col("end") + 1)
    links = ends.select(F.col("number").alias("id"), (-F.col("number")).alias("place"), after.alias("up"), (-after).alias("up_place"))
    reached = written(followed(links, first, width=STRETCH).select(F.col("id").alias("number")))
    return ends.join(reached, "number").select(F.col("number").alias("first"), F.col("end").alias("last"))


def segments(body_indices: DataFrame, size: int) -> DataFrame:
    """The fixed-size block ranges of the cold store."""
    return body_indices.groupBy(F.floor(F.col("number") / size).alias("bucket")).agg(
        F.min("number").alias("first_block"), F.max("number").alias("last_block"), F.count(F.lit(1)).alias("blocks"), F.sum("tx_count").alias("txs"), F.min("first_tx_num").alias("first_tx")
    )


def write_segments(df: DataFrame, path: str, size: int = 500_000, key: str = "number", codec: str = "zstd") -> None:
    """df as Parquet in folders of `size` keys, sorted inside; reading a key range opens its folders only.

    Rows that carry their bucket are taken to lie together by it, in order of keys.
    """
    if "bucket" not in df.columns:
        df = df.withColumn("bucket", F.floor(F.col(key) / size)).repartition("bucket").sortWithinPartitions("bucket", key)
    df.write.partitionBy("bucket").option("compression", codec).parquet(path)


def read_segments(spark, path: str, start: int, end: int, size: int = 500_000, key: str = "number") -> DataFrame:
    """Rows with start <= key <= end; the folder predicate is derived here, as Spark cannot infer it."""
    return spark.read.parquet(path).where(F.col("bucket").between(start // size, end // size)).where(F.col(key).between(start, end)).drop("bucket")


def hot_and_cold(cold: DataFrame, hot: DataFrame, watermark: int, key: str = "number") -> DataFrame:
    """One view over both stores: cold up to the watermark, hot above; each scan is pruned."""
    return cold.where(F.col(key) <= watermark).withColumn("store", F.lit("cold")).unionByName(hot.where(F.col(key) > watermark).withColumn("store", F.lit("hot")))
