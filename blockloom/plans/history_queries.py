"""Queries over account history: time travel, indexes, unwinding, retention, batch stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history, retention, stages
from ..sources.manifest import Segments
from ..sources.shared import shared_dir
from .registry import query
from .views import Ledger

AS_OF = """
    SELECT a.address, CASE WHEN c.address IS NOT NULL THEN c.before ELSE a.value END AS value FROM accounts a
    LEFT JOIN (SELECT address, arg_min_null(before, block) AS before FROM account_changes WHERE block >= {n} GROUP BY address) c USING (address)"""


@query("accounts_as_of", "account_changes accounts", AS_OF.format(n=300))
def accounts_as_of(x: Ledger):
    return history.as_of(x.changes_between(300, None), x.accounts, 300)


@query("accounts_as_of_genesis", "account_changes accounts", AS_OF.format(n=1))
def accounts_as_of_genesis(x: Ledger):
    return history.as_of(x.account_changes, x.accounts, 1)


@query("accounts_as_of_many", "account_changes accounts", """
    WITH w AS (SELECT address, n AS block FROM accounts, (VALUES (1), (24), (100), (333), (719), (100000)) v(n)),
    f AS (SELECT w.address, w.block, count(c.block) AS n, arg_min_null(c.before, c.block) AS before FROM w LEFT JOIN account_changes c ON c.address = w.address AND c.block >= w.block GROUP BY ALL)
    SELECT f.address, CAST(f.block AS BIGINT) AS block, CASE WHEN n > 0 THEN before ELSE a.value END AS value FROM f JOIN accounts a USING (address)""")
def accounts_as_of_many(x: Ledger):
    wanted = x.accounts.select("address", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 24, 100, 333, 719, 100000)])).alias("block"))
    return history.as_of_many(x.account_changes, x.accounts, wanted)


@query("history_lookup", "account_changes", "SELECT address, min(block) FILTER (block >= 200) AS next_block FROM account_changes GROUP BY 1")
def history_lookup(x: Ledger):
    return x.account_changes.groupBy("address").agg(F.min(F.when(F.col("block") >= 200, F.col("block"))).alias("next_block"))


@query("history_class", "account_changes accounts", """
    SELECT a.address, c.next AS block, CASE WHEN c.next IS NULL THEN 'in plain state' WHEN c.next = c.first AND c.oldest IS NULL THEN 'not yet written' ELSE 'in changeset' END AS found
    FROM accounts a JOIN (SELECT address, min(block) AS first, min(block) FILTER (block >= 100) AS next, arg_min_null(before, block) AS oldest FROM account_changes GROUP BY 1) c USING (address)""")
def history_class(x: Ledger):
    return history.classify(x.account_changes, x.accounts.select("address"), 100)


@query("changed_accounts", "account_changes", "SELECT DISTINCT address FROM account_changes WHERE block BETWEEN 50 AND 80")
def changed_accounts(x: Ledger):
    return x.changes_between(50, 80).select("address").distinct()


@query("changed_accounts_and_blocks", "account_changes", "SELECT address, string_agg(block, ',' ORDER BY block) AS blocks FROM account_changes WHERE block BETWEEN 50 AND 250 GROUP BY 1")
def changed_accounts_and_blocks(x: Ledger):
    listed = x.changes_between(50, 250).groupBy("address").agg(F.array_sort(F.collect_list("block")).alias("b"))
    return listed.select("address", F.array_join(F.transform("b", lambda v: v.cast("string")), ",").alias("blocks"))


@query("block_changeset", "account_changes", "SELECT address, before FROM account_changes WHERE block = 120")
def block_changeset(x: Ledger):
    return x.changes_between(120, 120).select("address", "before")


@query("changed_balances", "account_changes accounts", """
    WITH m AS (SELECT address, before, after FROM account_changes WHERE block = 240)
    SELECT address, coalesce(after, 0) AS value FROM m WHERE after IS DISTINCT FROM before""")
def changed_balances(x: Ledger):
    return history.changed_balances(x.changes_between(240, None), x.accounts, 240)


@query("state_unwound", "account_changes accounts", "SELECT * FROM (" + AS_OF.format(n=401) + ") WHERE value IS NOT NULL")
def state_unwound(x: Ledger):
    return history.unwind(x.account_changes, x.accounts, 400)[0]


@query("history_index", "account_changes", """
    WITH r AS (SELECT address, block, (row_number() OVER (PARTITION BY address ORDER BY block) - 1) // 8 AS shard FROM (SELECT DISTINCT address, block FROM account_changes)),
    s AS (SELECT address, shard, max(block) AS top, count(*) AS n, string_agg(block, ',' ORDER BY block) AS blocks FROM r GROUP BY ALL)
    SELECT address, CASE WHEN shard = max(shard) OVER (PARTITION BY address) THEN 9223372036854775807 ELSE top END AS shard_end, n, blocks FROM s""")
def history_index(x: Ledger):
    shards = history.index_shards(x.account_changes, ["address"], 8)
    return shards.select("address", "shard_end", F.size("blocks").cast("long").alias("n"), F.array_join(F.transform("blocks", lambda v: v.cast("string")), ",").alias("blocks"))


@query("history_index_trimmed", "account_changes", """
    WITH r AS (SELECT address, block, (row_number() OVER (PARTITION BY address ORDER BY block) - 1) // 8 AS shard FROM (SELECT DISTINCT address, block FROM account_changes WHERE block > 300)),
    s AS (SELECT address, shard, max(block) AS top, count(*) AS n FROM r GROUP BY ALL)
    SELECT address, CASE WHEN shard = max(shard) OVER (PARTITION BY address) THEN 9223372036854775807 ELSE top END AS shard_end, n FROM s""")
def history_index_trimmed(x: Ledger):
    shards = history.trim_shards(history.index_shards(x.account_changes, ["address"], 8), ["address"], 300, 8)
    return shards.select("address", "shard_end", F.size("blocks").cast("long").alias("n"))


@query("history_index_unwound", "account_changes", """
    WITH r AS (SELECT address, block, (row_number() OVER (PARTITION BY address ORDER BY block) - 1) // 8 AS shard FROM (SELECT DISTINCT address, block FROM account_changes WHERE block <= 300)),
    s AS (SELECT address, shard, max(block) AS top, string_agg(block, ',' ORDER BY block) AS blocks FROM r GROUP BY ALL)
    SELECT address, CASE WHEN shard = max(shard) OVER (PARTITION BY address) THEN 9223372036854775807 ELSE top END AS shard_end, blocks FROM s""")
def history_index_unwound(x: Ledger):
    """The index after all blocks above 300 are taken back, without building it again."""
    shards = history.unwind_shards(history.index_shards(x.account_changes, ["address"], 8), ["address"], 300)
    return shards.select("address", "shard_end", F.array_join(F.transform("blocks", lambda v: v.cast("string")), ",").alias("blocks"))


@query("live_over_stored", "accounts account_changes", """
    WITH l AS (SELECT address, arg_max_null(after, block) AS value FROM account_changes WHERE block >= 700 GROUP BY 1), s AS (SELECT * FROM (""" + AS_OF.format(n=700) + """))
    SELECT address, value FROM l UNION ALL SELECT address, value FROM s WHERE address NOT IN (SELECT address FROM l)""")
def live_over_stored(x: Ledger):
    live = x.changes_between(700, None).groupBy("address").agg(F.max_by("after", "block").alias("value"))
    return history.merged([live, history.as_of(x.changes_between(700, None), x.accounts, 700)], "address")


@query("latest_change_per_account", "account_changes", "SELECT address, max(block) AS block, arg_max_null(after, block) AS value, count(*) AS n_changes FROM account_changes GROUP BY 1")
def latest_change_per_account(x: Ledger):
    return x.account_changes.groupBy("address").agg(F.max("block").alias("block"), F.max_by("after", "block").alias("value"), F.count(F.lit(1)).alias("n_changes"))


@query("stage_append_bodies", "body_indices", "SELECT number, first_tx_num, tx_count, CASE WHEN tx_count > 0 THEN first_tx_num + tx_count - 1 END AS last_tx_num FROM body_indices WHERE number BETWEEN 1001 AND 3000")
def stage_append_bodies(x: Ledger):
    """Bodies appended after checkpoint 1000: numbering goes on from the last transaction."""
    return stages.append_bodies(x.body_indices_between(None, 1000), x.body_indices_between(1001, 3000).select("number", "tx_count"))


@query("stage_batches_by_tx", "body_indices", """
    SELECT (first_tx_num + greatest(tx_count, 1) - 1) // 5000 AS batch, min(number) AS first_block, max(number) AS last_block, sum(tx_count)::BIGINT AS txs FROM body_indices GROUP BY 1""")
def stage_batches_by_tx(x: Ledger):
    return stages.batches_by_transactions(x.body_indices, 5000)


@query("stage_next_range", "body_indices", "SELECT 101::BIGINT AS first_block, max(number) AS last_block, sum(tx_count)::BIGINT AS txs FROM body_indices WHERE number > 100 AND (first_tx_num + tx_count) - (SELECT first_tx_num FROM body_indices WHERE number = 101) <= 3000")
def stage_next_range(x: Ledger):
    return stages.next_range(x.body_indices, 100, 3000)


@query("stage_hash_index", "transactions", "SELECT substr(hash, 1, 2) AS prefix, count(*) AS n, min(hash) AS first_hash, arg_min(tx_num, hash) AS first_tx FROM transactions GROUP BY 1")
def stage_hash_index(x: Ledger):
    """The folders of the index of hashes, and what each begins with."""
    index = x.hash_index("tx")
    return index.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first_hash"), F.min_by("tx_num", "hash").alias("first_tx"))


@query("stage_gas_total", "headers", "SELECT sum(gas_used)::BIGINT AS gas FROM headers WHERE number BETWEEN 10 AND 5000")
def stage_gas_total(x: Ledger):
    return x.headers_between(10, 5000).agg(F.sum("gas_used").alias("gas"))


@query("segment_buckets", "body_indices", """
    SELECT number // 500 AS bucket, min(number) AS first_block, max(number) AS last_block, count(*) AS blocks, sum(tx_count)::BIGINT AS txs, min(first_tx_num) AS first_tx FROM body_indices GROUP BY 1""")
def segment_buckets(x: Ledger):
    return stages.segments(x.body_indices, 500)


@query("hot_and_cold", "headers", "SELECT number, hash, CASE WHEN number <= 600 THEN 'cold' ELSE 'hot' END AS store FROM headers")
def hot_and_cold(x: Ledger):
    return stages.hot_and_cold(x.headers_between(None, 620), x.headers_between(401, None), 600).select("number", "hash", "store")


@query("range_with_missing", "headers", "SELECT CAST(r.n AS BIGINT) AS number, h.hash FROM range((SELECT max(number) - 20 FROM headers), (SELECT max(number) + 20 FROM headers)) r(n) LEFT JOIN headers h ON h.number = r.n")
def range_with_missing(x: Ledger):
    head = x.headers.agg(F.max("number")).first()[0]
    return x.spark.range(head - 20, head + 20).withColumnRenamed("id", "number").join(x.headers_between(head - 20, None).select("number", "hash"), "number", "left")


@query("prune_by_mode", "headers", """
    SELECT m AS mode, count(*) FILTER (CASE m WHEN 'full' THEN number < (SELECT max(number) FROM headers) - 64 WHEN 'distance' THEN number < (SELECT max(number) FROM headers) - 500 ELSE number < 900 END) AS pruned, count(*) AS blocks
    FROM headers, (VALUES ('full'), ('distance'), ('before')) v(m) GROUP BY 1""")
def prune_by_mode(x: Ledger):
    tip = x.headers.agg(F.max("number")).first()[0]
    modes = {"full": retention.should_prune("full", None, tip, 64), "distance": retention.should_prune("distance", 500, tip, 64), "before": retention.should_prune("before", 900, tip, 64)}
    counts = x.headers.agg(F.count(F.lit(1)).alias("blocks"), *[F.count(F.when(p, 1)).alias(m) for m, p in modes.items()])
    return counts.select("blocks", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in modes]), F.array(*modes))).alias("mode", "pruned"))


@query("prune_logs_except_addresses", "logs", "SELECT block, log_index, address FROM logs WHERE block > 500 OR (address IN (3, 5) AND block >= 100) OR (address = 9 AND block >= 0)")
def prune_logs_except_addresses(x: Ledger):
    rules = x.spark.createDataFrame([(3, 100), (5, 100), (9, 0)], "address long, from_block long")
    return retention.prune_logs(x.logs, rules, 500).select("block", "log_index", "address")


@query("pruned_in_runs", "logs", """
    SELECT block, log_index, address FROM (SELECT *, row_number() OVER (ORDER BY block, log_index) AS r FROM logs) WHERE block > 300 OR r > 1500""")
def pruned_in_runs(x: Ledger):
    """All logs after two runs of deletion up to block 300, the second going on within the block where the first stopped."""
    stored = Segments(x.spark, f"{shared_dir(x.spark)}/pruned")
    stored.build(x.logs.select("block", "log_index", "address"), 64, "block")
    for limit in (1000, 500):
        stored.prune(300, limit, "log_index")
    return stored.read().drop("bucket")


@query("prune_receipts_with_allowed_log", "receipts transactions", """
    SELECT r.number, count(*) AS n FROM receipts r WHERE r.number > 2000 OR r.number IN (SELECT number FROM transactions WHERE recipient IN (10, 20, 30, 40, 50)) GROUP BY 1""")
def prune_receipts_with_allowed_log(x: Ledger):
    allowed = x.transactions.where(F.col("recipient").isin(10, 20, 30, 40, 50)).select("number").distinct()
    return retention.keep_with_allowed(x.receipts, allowed, "number", 2000).groupBy("number").agg(F.count(F.lit(1)).alias("n"))


@query("account_slots", "storage_changes", "SELECT address, count(DISTINCT slot) AS slots, count(*) AS n FROM storage_changes WHERE block <= 500 GROUP BY 1")
def account_slots(x: Ledger):
    """Slots that each account has written up to a block, and how often."""
    return x.storage_changes_between(None, 500).groupBy("address").agg(F.countDistinct("slot").alias("slots"), F.count(F.lit(1)).alias("n"))


@query("recently_changed_accounts", "account_changes", """
    SELECT address, max(block) AS last_access FROM account_changes GROUP BY 1 HAVING max(block) > (SELECT max(block) - 12 FROM account_changes)""")
def recently_changed_accounts(x: Ledger):
    """Accounts that the last 12 blocks changed."""
    head = x.account_changes.agg(F.max("block")).first()[0]
    return x.account_changes.groupBy("address").agg(F.max("block").alias("last_access")).where(F.col("last_access") > head - 12)


@query("changed_after_pause", "account_changes", """
    SELECT DISTINCT block, address FROM account_changes c WHERE block BETWEEN 100 AND 160 AND NOT EXISTS (SELECT 1 FROM account_changes p WHERE p.address = c.address AND p.block < c.block AND p.block >= c.block - 12)""")
def changed_after_pause(x: Ledger):
    """Changes of accounts that the 12 blocks before left alone."""
    before = F.lag("block").over(Window.partitionBy("address").orderBy("block"))
    return x.account_changes.select("block", "address").withColumn("prev", before).where("prev IS NULL OR prev < block - 12").where("block BETWEEN 100 AND 160").select("block", "address")
