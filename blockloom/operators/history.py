"""State at any block, rebuilt from before-images; history indexes; unwinding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import GROUP_WIDTH, next_within, position_within

SHARD = 2000
#: The end of a key's last shard.
OPEN = 2**63 - 1


def as_of(changes: DataFrame, current: DataFrame, block: int, key: str = "address") -> DataFrame:
    """key, value at the start of a block (its own changes excluded); null: did not exist yet.

    The first change at or after the block holds the value in its before-image; without one the
    current value stands. One aggregation on the key and one left join, no windows.
    """
    later = changes.where(F.col("block") >= block).groupBy(key).agg(F.min("block").alias("first"), F.min_by("before", "block").alias("before"))
    return current.join(later, key, "left").select(key, F.when(F.col("first").isNotNull(), F.col("before")).otherwise(F.col("value")).alias("value"))


def as_of_many(changes: DataFrame, current: DataFrame, wanted: DataFrame, key: str = "address", width: int = GROUP_WIDTH) -> DataFrame:
    """The value for each (key, block) of wanted, in one pass: requests and changes are merged per key,
    and each request takes the nearest change at or after its block; a hot key is split at ranges of blocks."""
    asked = wanted.select(key, "block").distinct().select(key, (F.col("block") * 2).alias("at"), F.lit(None).cast("struct<before:double>").alias("change"))
    made = changes.select(key, (F.col("block") * 2 + 1).alias("at"), F.struct(F.col("before").cast("double").alias("before")).alias("change"))
    merged = next_within(asked.unionByName(made), [key], "at", "change", "nearest", width).where("at % 2 = 0")
    return merged.join(current, key, "left").select(key, F.call_function("div", F.col("at"), F.lit(2)).alias("block"), F.when(F.col("nearest").isNotNull(), F.col("nearest.before")).otherwise(F.col("value")).alias("value"))


def classify(changes: DataFrame, keys: DataFrame, block: int, lowest: int | None = None, key: str = "address") -> DataFrame:
    """Where the value of each key at a block is found: in a changeset, in the plain state, or nowhere yet.

    A key whose first change lies at or after the block was not written before it, unless changes
    below `lowest` are pruned and it may be older.
    """
    seen = changes.groupBy(key).agg(F.min("block").alias("first"), F.min(F.when(F.col("block") >= block, F.col("block"))).alias("next"), F.min_by("before", "block").alias("oldest"))
    joined = keys.join(seen, key, "left")
    unknown = F.lit("maybe in plain state") if lowest is not None else F.lit("not yet written")
    kind = F.when(F.col("first").isNull(), unknown).when(F.col("next").isNull(), F.lit("in plain state")).when((F.col("next") == F.col("first")) & F.lit(lowest is None) & F.col("oldest").isNull(), F.lit("not yet written")).otherwise(F.lit("in changeset"))
    return joined.select(key, F.col("next").alias("block"), kind.alias("found"))


def index_shards(changes: DataFrame, keys: list[str], size: int = SHARD, width: int = GROUP_WIDTH) -> DataFrame:
    """keys, shard_end, blocks: the blocks that changed a key, in shards; the last one is open (OPEN).

    A key's blocks are ranked in ranges, so a hot key is many tasks; rows are dealt out by key and shard.
    """
    distinct = changes.select(*keys, "block").distinct()
    ranked = position_within(distinct, keys, "block", "at", width, total="n")
    last = F.floor((F.max("n") - 1) / size)
    shards = ranked.groupBy(*keys, F.floor(F.col("at") / size).alias("shard")).agg(F.array_sort(F.collect_list("block")).alias("blocks"), last.alias("last"))  # at most `size` each
    return shards.select(*keys, F.when(F.col("shard") == F.col("last"), F.lit(OPEN)).otherwise(F.element_at("blocks", -1)).alias("shard_end"), "blocks")


def shard_lookup(shards: DataFrame, wanted: DataFrame, keys: list[str], width: int = GROUP_WIDTH) -> DataFrame:
    """wanted (keys, block) with next_block: the first block at or after it that changed the key, null if none.

    Requests and the ends of shards are merged by key, without the shards' blocks: a request takes the first
    end that is not below its block, and fetches that one shard.
    """
    code = lambda c, odd: F.least(c, F.lit(OPEN // 4)) * 2 + odd
    asked = wanted.select(*keys, code(F.col("block"), 0).alias("at"), F.lit(None).cast("long").alias("end")).distinct()
    ends = shards.select(*keys, code(F.col("shard_end"), 1).alias("at"), F.col("shard_end").alias("end"))
    nearest = next_within(asked.unionByName(ends), keys, "at", "end", "shard_end", width).where("at % 2 = 0")
    fetched = nearest.select(*keys, F.call_function("div", F.col("at"), F.lit(2)).alias("block"), "shard_end").join(shards, [*keys, "shard_end"])
    found = fetched.select(*keys, "block", F.array_min(F.filter("blocks", lambda b: b >= F.col("block"))).alias("next_block"))
    return wanted.join(found, [*keys, "block"], "left")


def account_info(changes: DataFrame, current: DataFrame, txs: DataFrame, creations: DataFrame, block: int) -> DataFrame:
    """address, balance, nonce, code at the start of a block: what stood there, transactions sent before it, and the
    hash of the code of an account created before it (null: none). creations: contract, number, tx_num."""
    nonces = txs.where(F.col("number") < block).groupBy(F.col("sender").cast("long").alias("address")).agg(F.count(F.lit(1)).alias("nonce"))
    codes = creations.where(F.col("number") < block).select(F.col("contract").cast("long").alias("address"), F.md5(F.concat(F.lit("code-"), F.col("tx_num").cast("string"))).alias("code"))
    state = as_of(changes, current, block).withColumnRenamed("value", "balance")
    return state.join(nonces, "address", "left").join(codes, "address", "left").fillna(0, ["nonce"]).select("address", "balance", "nonce", "code")


def unwind_shards(shards: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Shards without the blocks above block: later ones go, the one that holds the cut is cut and, as a key's last, open.

    Shards below the cut are passed on as they are: their blocks are neither taken apart nor ranked again.
    """
    kept = shards.where(F.array_min("blocks") <= block)
    # One row for each key, without blocks: where its last shard that is left begins.
    last = kept.groupBy(*keys).agg(F.max(F.array_min("blocks")).alias("__last"))
    is_last = F.array_min("blocks") == F.col("__last")
    cut = F.when(F.array_max("blocks") > block, F.filter("blocks", lambda b: b <= block)).otherwise(F.col("blocks"))
    return kept.join(last, keys).select(*keys, F.when(is_last, F.lit(OPEN)).otherwise(F.col("shard_end")).alias("shard_end"), cut.alias("blocks"))


def trim_shards(shards: DataFrame, keys: list[str], block: int, size: int = SHARD) -> DataFrame:
    """Shards without blocks <= block; empty ones go, and the last that is left is open."""
    kept = shards.select(*keys, F.explode("blocks").alias("block")).where(F.col("block") > block)
    return index_shards(kept, keys, size)


def unwind(changes: DataFrame, current: DataFrame, block: int, key: str = "address") -> tuple[DataFrame, DataFrame]:
    """State and changes after taking back all blocks above block; keys that did not exist are gone."""
    state = as_of(changes, current, block + 1, key)
    return state.where(F.col("value").isNotNull()), changes.where(F.col("block") <= block)


def changed_balances(changes: DataFrame, current: DataFrame, block: int, key: str = "address") -> DataFrame:
    """Keys that a block changed, with the value after it; unchanged ones are left out, deleted ones are 0."""
    mine = changes.where(F.col("block") == block).select(key, "before")
    after = as_of(changes.join(mine.select(key), key, "left_semi"), current, block + 1, key)
    return mine.join(after, key, "left").where(~F.col("value").eqNullSafe(F.col("before"))).select(key, F.coalesce("value", F.lit(0.0)).alias("value"))


def merged(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of several layers, the first layer that has a key wins (in memory before stored)."""
    tagged = [df.withColumn("__layer", F.lit(k)) for k, df in enumerate(layers)]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df)
    best = F.row_number().over(Window.partitionBy(key).orderBy("__layer"))
    return both.withColumn("__best", best).where("__best = 1").drop("__best", "__layer")
