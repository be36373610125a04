"""Queries over call traces and storage slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, traces
from .registry import query
from .views import Ledger


@query("trace_filter", "traces", "SELECT number, idx, path, from_, to_, value FROM traces WHERE number BETWEEN 100 AND 200 AND (from_ IN (1, 2, 3) OR to_ IN (5, 7, 11, 13))")
def trace_filter(x: Ledger):
    return traces.trace_filter(x.traces_between(100, 200), 100, 200, traces.involved([1, 2, 3], [5, 7, 11, 13])).select("number", "idx", "path", "from_", "to_", "value")


@query("trace_filter_page", "traces", "SELECT number, idx, path, value FROM traces WHERE number BETWEEN 300 AND 400 ORDER BY number, idx, path LIMIT 50 OFFSET 75")
def trace_filter_page(x: Ledger):
    return traces.trace_filter(x.traces_between(300, 400), 300, 400, traces.involved(None, None), 75, 50).select("number", "idx", "path", "value")


@query("trace_blocks_with_rewards", "traces headers", """
    SELECT number, tx_num, path, kind, to_, value FROM traces UNION ALL SELECT number, NULL, '', 'reward', beneficiary, 2000 FROM headers""")
def trace_blocks_with_rewards(x: Ledger):
    return traces.with_rewards(x.traces, x.headers).select("number", "tx_num", "path", "kind", "to_", "value")


@query("trace_gas_by_kind", "traces", "SELECT number, kind, sum(gas)::BIGINT AS gas, count(*) AS n, max(length(path)) AS depth FROM traces GROUP BY ALL")
def trace_gas_by_kind(x: Ledger):
    return x.traces.groupBy("number", "kind").agg(F.sum("gas").alias("gas"), F.count(F.lit(1)).alias("n"), F.max(F.length("path")).alias("depth"))


@query("internal_transfers", "traces", "SELECT tx_num, path, from_, to_, value FROM traces WHERE path <> '' AND value > 0")
def internal_transfers(x: Ledger):
    return x.traces.where("path <> '' AND value > 0").select("tx_num", "path", "from_", "to_", "value")


@query("contract_creators", "traces", "SELECT to_ AS contract, arg_min(number, tx_num) AS number, min(tx_num) AS tx_num, arg_min(from_, tx_num) AS creator FROM traces WHERE kind = 'create' GROUP BY 1")
def contract_creators(x: Ledger):
    return traces.creators(x.traces)


@query("storage_as_of", "storage_changes storages", """
    SELECT s.address, s.slot, CASE WHEN c.address IS NOT NULL THEN c.before ELSE s.value END AS value FROM storages s
    LEFT JOIN (SELECT address, slot, arg_min_null(before, block) AS before FROM storage_changes WHERE block >= 250 GROUP BY ALL) c USING (address, slot)""")
def storage_as_of(x: Ledger):
    key = F.struct("address", "slot").alias("key")
    state = history.as_of(x.storage_changes_between(250, None).select(key, "block", "before"), x.storages.select(key, "value"), 250, "key")
    return state.select("key.address", "key.slot", "value")


@query("changed_slots", "storage_changes", "SELECT address, string_agg(slot, ',' ORDER BY slot) AS slots FROM (SELECT DISTINCT address, slot FROM storage_changes WHERE block BETWEEN 100 AND 300) GROUP BY 1")
def changed_slots(x: Ledger):
    return x.storage_changes_between(100, 300).groupBy("address").agg(F.array_join(F.array_sort(F.collect_set("slot")), ",").alias("slots"))


@query("storage_changeset", "storage_changes", "SELECT address, slot, before FROM storage_changes WHERE block = 120")
def storage_changeset(x: Ledger):
    """What a block changed: each slot with the value before."""
    return x.storage_changes_between(120, 120).select("address", "slot", "before")


@query("storage_changesets_range", "storage_changes", "SELECT block, address, slot, before FROM storage_changes WHERE block BETWEEN 100 AND 300")
def storage_changesets_range(x: Ledger):
    return x.storage_changes_between(100, 300).select("block", "address", "slot", "before")


@query("storage_changed_blocks", "storage_changes", """
    SELECT address, slot, string_agg(block, ',' ORDER BY block) AS blocks FROM storage_changes WHERE block BETWEEN 50 AND 250 GROUP BY ALL""")
def storage_changed_blocks(x: Ledger):
    """Slots that a range of blocks changed, each with those blocks."""
    listed = x.storage_changes_between(50, 250).groupBy("address", "slot").agg(F.array_sort(F.collect_list("block")).alias("b"))
    return listed.select("address", "slot", F.array_join(F.transform("b", lambda v: v.cast("string")), ",").alias("blocks"))


@query("storage_before_block", "storage_changes storages", """
    SELECT w.block, s.address, s.slot, c.address IS NOT NULL AS changed, c.before FROM storages s, (VALUES (CAST(0 AS BIGINT)), (120), (240), (100000)) w(block)
    LEFT JOIN storage_changes c ON c.block = w.block AND c.address = s.address AND c.slot = s.slot""")
def storage_before_block(x: Ledger):
    """Every slot at several blocks: whether the block changed it, and the value before it if so."""
    blocks = [0, 120, 240, 100_000]
    asked = x.storages.select("address", "slot", F.explode(F.array(*[F.lit(n).cast("long") for n in blocks])).alias("block"))
    made = x.storage_changes_at(blocks).select("block", "address", "slot", "before", F.lit(True).alias("made"))
    return asked.join(made, ["block", "address", "slot"], "left").select("block", "address", "slot", F.coalesce("made", F.lit(False)).alias("changed"), "before")


@query("storage_history_index", "storage_changes", "SELECT address, slot, count(DISTINCT block) AS n, max(block) AS last_block FROM storage_changes GROUP BY 1, 2")
def storage_history_index(x: Ledger):
    shards = history.index_shards(x.storage_changes, ["address", "slot"], 16)
    return shards.groupBy("address", "slot").agg(F.sum(F.size("blocks")).alias("n"), F.max(F.element_at("blocks", -1)).alias("last_block"))


@query("storage_values_batch", "storages accounts", """
    SELECT w.address, string_agg(CASE WHEN s.value IS NULL THEN 'none' ELSE w.slot END, ',' ORDER BY w.pos) AS found
    FROM (SELECT address, slot, pos FROM accounts, (VALUES ('click', 0), ('missing', 1), ('view', 2)) v(slot, pos)) w LEFT JOIN storages s ON s.address = w.address AND s.slot = w.slot GROUP BY 1""")
def storage_values_batch(x: Ledger):
    """The same slots of every account."""
    return _values_batch(x.accounts.select("address"), x)


def _values_batch(addresses: DataFrame, x: Ledger) -> DataFrame:
    asked = addresses.select("address", F.posexplode(F.array(*[F.lit(s) for s in ("click", "missing", "view")])).alias("pos", "slot"))
    joined = asked.join(x.storages, ["address", "slot"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("value").isNull(), F.lit("none")).otherwise(F.col("slot")).alias("v"))))
    return joined.groupBy("address").agg(F.array_join(F.transform(listed, lambda s: s["v"]), ",").alias("found"))


@query("slots_by_account", "storages", "SELECT address, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS large FROM storages GROUP BY 1")
def slots_by_account(x: Ledger):
    return x.storages.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("large"))
