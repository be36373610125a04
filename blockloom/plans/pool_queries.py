"""Queries over the transaction pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pool
from .registry import query
from .views import Ledger

BASE, BLOB_FEE, BLOCK_GAS = 60_000, 30_000, 5_000
STATE = """
    b AS (SELECT c_custkey AS sender, CAST(floor(greatest(c_acctbal, 0) * 100) AS BIGINT) AS balance, CAST(0 AS BIGINT) AS next_nonce FROM customer),
    j AS (SELECT p.*, coalesce(balance, 0) AS balance, coalesce(next_nonce, 0) AS next_nonce FROM pool p LEFT JOIN b USING (sender)),
    r AS (SELECT *, CAST(sum(cost) OVER w AS BIGINT) AS cumulative_cost, nonce - next_nonce = row_number() OVER w - 1 AS gapless FROM j WINDOW w AS (PARTITION BY sender ORDER BY nonce)),
    e AS (SELECT *, cumulative_cost <= balance AS enough, max_fee >= 60000 AS paid, NOT is_blob OR blob_fee >= 30000 AS blob_paid, gas <= 5000 AS light FROM r),
    q AS (SELECT *, coalesce(bool_and(enough AND gapless AND paid AND blob_paid AND light) OVER (PARTITION BY sender ORDER BY nonce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ready FROM e),
    s AS (SELECT *, CAST(is_blob::INT * 2 + blob_paid::INT * 4 + paid::INT * 8 + light::INT * 16 + enough::INT * 32 + gapless::INT * 64 + ready::INT * 128 AS BIGINT) AS state FROM q),
    t AS (SELECT *, CASE WHEN state >= 252 THEN 'pending' WHEN is_blob THEN 'blob' WHEN state >= 240 THEN 'basefee' ELSE 'queued' END AS subpool FROM s)"""


def _balances(x: Ledger):
    return x.table("customer").select(F.col("c_custkey").alias("sender"), F.floor(F.greatest("c_acctbal", F.lit(0.0)) * 100).cast("long").alias("balance"), F.lit(0).cast("long").alias("next_nonce"))


def _with_state(x: Ledger) -> DataFrame:
    return pool.with_state(x.pool, _balances(x), BASE, BLOCK_GAS, BLOB_FEE)


@query("pool_subpools", "pool", f"WITH {STATE} SELECT submission_id, cumulative_cost, CAST(state AS BIGINT) AS state, subpool FROM t")
def pool_subpools(x: Ledger):
    return _with_state(x).select("submission_id", "cumulative_cost", "state", "subpool")


@query("pool_status", "pool", f"WITH {STATE} SELECT subpool, count(*) AS n, sum(size)::BIGINT AS bytes, count(DISTINCT sender) AS senders FROM t GROUP BY 1")
def pool_status(x: Ledger):
    return _with_state(x).groupBy("subpool").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.countDistinct("sender").alias("senders"))


@query("pool_promotions", "pool", f"""
    WITH {STATE}, p AS (SELECT submission_id, sender, nonce, bool_and(max_fee >= 30000) OVER (PARTITION BY sender ORDER BY nonce) AS released FROM t WHERE subpool = 'basefee')
    SELECT submission_id, sender, nonce FROM p WHERE released""")
def pool_promotions(x: Ledger):
    """What a base fee of half releases from the transactions that wait for it."""
    return pool.promoted(_with_state(x).where("subpool = 'basefee'"), BASE // 2).select("submission_id", "sender", "nonce")


@query("pool_best", "pool", """
    WITH k AS (SELECT *, CASE WHEN max_fee >= 60000 THEN least(max_tip, max_fee - 60000) ELSE -1 END AS pr FROM pool),
    h AS (SELECT sender, nonce, submission_id, min({'p': pr, 'a': -submission_id}) OVER (PARTITION BY sender ORDER BY nonce) AS held FROM k)
    SELECT submission_id, sender, nonce, held.p AS held_priority, -held.a AS held_by FROM h""")
def pool_best(x: Ledger):
    return pool.best_order(x.pool, BASE).select("submission_id", "sender", "nonce", "held_priority", "held_by")


@query("pool_best_top", "pool", """
    WITH k AS (SELECT *, CASE WHEN max_fee >= 60000 THEN least(max_tip, max_fee - 60000) ELSE -1 END AS pr FROM pool),
    h AS (SELECT sender, nonce, submission_id, min({'p': pr, 'a': -submission_id}) OVER (PARTITION BY sender ORDER BY nonce) AS held FROM k)
    SELECT submission_id, sender, nonce FROM h ORDER BY held.p DESC, -held.a, nonce LIMIT 200""")
def pool_best_top(x: Ledger):
    return pool.best(x.pool, BASE, 200).select("submission_id", "sender", "nonce")


@query("pool_consecutive", "pool", """
    WITH g AS (SELECT sender, nonce, submission_id FROM pool WHERE submission_id % 5 <> 3),
    i AS (SELECT *, nonce - row_number() OVER (PARTITION BY sender ORDER BY nonce) + 1 AS island FROM g)
    SELECT sender, max(nonce) AS nonce, arg_max(submission_id, nonce) AS submission_id FROM i WHERE island = 0 GROUP BY 1""")
def pool_consecutive(x: Ledger):
    return pool.consecutive(x.pool.where("submission_id % 5 <> 3"), _balances(x).select("sender", "next_nonce"))


@query("pool_evicted", "pool", """
    WITH g AS (SELECT count(*) // 3 AS max_count, CAST(sum(size) AS BIGINT) // 4 AS max_bytes, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM pool),
    l AS (SELECT p.*, coalesce(CASE WHEN max_fee >= 60000 THEN least(max_tip, max_fee - 60000) END, -1) AS worth, nonce > coalesce(max(CASE WHEN is_local THEN nonce END) OVER (PARTITION BY sender), -1) AS free FROM pool p),
    r1 AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY nonce DESC) AS round FROM l WHERE free),
    c1 AS (SELECT *, count(*) OVER o AS gone, coalesce(sum(size) OVER o, 0) AS gone_bytes FROM r1 WINDOW o AS (ORDER BY round, worth, submission_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p1 AS (SELECT submission_id, size, round FROM c1, g WHERE n - gone > max_count OR bytes - gone_bytes > max_bytes),
    h AS (SELECT (SELECT count(*) FROM p1) AS n1, (SELECT coalesce(sum(size), 0) FROM p1) AS b1),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY nonce DESC) AS round FROM l WHERE submission_id NOT IN (SELECT submission_id FROM p1)),
    c2 AS (SELECT *, count(*) OVER o AS gone, coalesce(sum(size) OVER o, 0) AS gone_bytes FROM r2 WINDOW o AS (ORDER BY round, worth, submission_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p2 AS (SELECT submission_id, round FROM c2, g, h WHERE n - n1 - gone > max_count OR bytes - b1 - gone_bytes > max_bytes)
    SELECT submission_id, 1 AS pass, round FROM p1 UNION ALL SELECT submission_id, 2, round FROM p2""")
def pool_evicted(x: Ledger):
    sums = x.pool.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    return pool.evicted(x.pool, BASE, sums["n"] // 3, (sums["bytes"] or 0) // 4)


@query("pool_truncated_senders", "pool", f"""
    WITH {STATE}, k AS (SELECT submission_id, sender, nonce, size, max(submission_id) OVER (PARTITION BY sender) AS latest, count(*) OVER () AS n, sum(size) OVER () AS bytes FROM t WHERE subpool = 'queued'),
    c AS (SELECT *, count(*) OVER o AS gone, coalesce(sum(size) OVER o, 0) AS gone_bytes FROM k WINDOW o AS (ORDER BY latest, nonce DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT submission_id FROM c WHERE n - gone > n // 2 OR bytes - gone_bytes > bytes // 3""")
def pool_truncated_senders(x: Ledger):
    parked = _with_state(x).where("subpool = 'queued'")
    sums = parked.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    return pool.truncated(parked, sums["n"] // 2, (sums["bytes"] or 0) // 3)


@query("pool_replacements", "pool", """
    WITH o AS (SELECT sender, nonce, max_fee + (submission_id % 40) * max_fee // 100 AS max_fee, max_tip + (submission_id % 30) * max_tip // 100 AS max_tip, is_blob, submission_id FROM pool)
    SELECT o.submission_id, o.max_fee * 100 >= p.max_fee * (CASE WHEN o.is_blob THEN 200 ELSE 110 END) AND o.max_tip * 100 >= p.max_tip * (CASE WHEN o.is_blob THEN 200 ELSE 110 END) AS accepted FROM o JOIN pool p USING (sender, nonce)""")
def pool_replacements(x: Ledger):
    return _replacements(x, x.pool)


def _replacements(x: Ledger, offered: DataFrame) -> DataFrame:
    bumped = lambda c, m: (F.col(c) + F.expr(f"(submission_id % {m}) * {c} div 100")).alias(c)
    offers = offered.select("sender", "nonce", bumped("max_fee", 40), bumped("max_tip", 30), "is_blob", "submission_id")
    return pool.replacements(x.pool, offers).select("submission_id", "accepted")


@query("pool_content", "pool", "SELECT sender, string_agg(nonce || ':' || submission_id, ',' ORDER BY nonce) AS content FROM pool GROUP BY 1")
def pool_content(x: Ledger):
    listed = x.pool.groupBy("sender").agg(F.array_sort(F.collect_list(F.struct("nonce", "submission_id"))).alias("l"))
    return listed.select("sender", F.array_join(F.transform("l", lambda s: F.concat_ws(":", s["nonce"].cast("string"), s["submission_id"].cast("string"))), ",").alias("content"))


@query("pool_inspect", "pool", "SELECT submission_id, sender || '/' || nonce || ': ' || cost || ' wei + ' || size || ' gas x ' || max_fee || ' wei' AS summary FROM pool")
def pool_inspect(x: Ledger):
    return x.pool.select("submission_id", F.format_string("%d/%d: %d wei + %d gas x %d wei", "sender", "nonce", "cost", "size", "max_fee").alias("summary"))


@query("pool_highest_by_sender", "pool", "SELECT sender, max(nonce) AS nonce, arg_max(submission_id, nonce) AS submission_id FROM pool GROUP BY 1")
def pool_highest_by_sender(x: Ledger):
    return x.pool.groupBy("sender").agg(F.max("nonce").alias("nonce"), F.max_by("submission_id", "nonce").alias("submission_id"))


@query("pool_over_cap", "pool", "SELECT sender, count(*) AS n FROM pool GROUP BY 1 HAVING count(*) > 8")
def pool_over_cap(x: Ledger):
    return pool.over_cap(x.pool, 8)


@query("pool_unknown_announced", "pool", "SELECT o_orderkey AS submission_id FROM orders WHERE o_orderkey NOT IN (SELECT submission_id FROM pool)")
def pool_unknown_announced(x: Ledger):
    return x.table("orders").select(F.col("o_orderkey").alias("submission_id")).join(x.pool.select("submission_id"), "submission_id", "left_anti")


@query("pool_within_bytes", "pool", "SELECT submission_id, CAST(bytes AS BIGINT) AS bytes FROM (SELECT *, sum(size) OVER (PARTITION BY sender ORDER BY submission_id) AS bytes FROM pool) WHERE bytes <= 2000")
def pool_within_bytes(x: Ledger):
    return pool.within_bytes(x.pool, None, 2000).select("submission_id", "bytes")


DELTA = """CASE WHEN {d} = 0 THEN 0 ELSE sign({d}) * (length(bin(CAST(ceil(abs({d}) / 0.16992500144231237) AS BIGINT))) - 1) END"""
WHOLE = "(CASE WHEN {x} > 0 THEN length(bin({x})) - 1 ELSE 0 END)"


@query("pool_blob_order", "pool", f"""
    WITH d AS (SELECT submission_id, {WHOLE.format(x="blob_fee")} - {WHOLE.format(x="30000")} AS blob, {WHOLE.format(x="max_fee")} - {WHOLE.format(x="60000")} AS fee FROM pool WHERE is_blob)
    SELECT submission_id, CAST(least({DELTA.format(d="blob")}, {DELTA.format(d="fee")}, 0) AS BIGINT) AS priority FROM d""")
def pool_blob_order(x: Ledger):
    return x.pool.where("is_blob").select("submission_id", pool.blob_priority(BASE, BLOB_FEE).alias("priority"))


@query("pool_next_nonce", "pool transactions", "SELECT sender, greatest(max(n), 0) + 1 AS next_nonce FROM (SELECT sender, max(nonce) AS n FROM pool GROUP BY 1 UNION ALL SELECT sender, count(*) - 1 FROM transactions GROUP BY 1) GROUP BY 1")
def pool_next_nonce(x: Ledger):
    """Transaction count of an account, pending ones included."""
    mined = x.transactions.groupBy(F.col("sender").cast("long").alias("sender")).agg((F.count(F.lit(1)) - 1).alias("n"))
    both = x.pool.groupBy("sender").agg(F.max("nonce").alias("n")).unionByName(mined)
    return both.groupBy("sender").agg((F.greatest(F.max("n"), F.lit(0)) + 1).alias("next_nonce"))


@query("pool_price_rank", "pool", "SELECT submission_id, rank() OVER (PARTITION BY sender ORDER BY max_fee DESC) AS place FROM pool")
def pool_price_rank(x: Ledger):
    return x.pool.select("submission_id", F.rank().over(Window.partitionBy("sender").orderBy(F.desc("max_fee"))).cast("long").alias("place"))


BEST = """
    h AS (SELECT *, -CAST(coalesce(min(rank) OVER (PARTITION BY sender ORDER BY nonce), 0) AS HUGEINT) AS turn FROM (
        SELECT *, CAST(CASE WHEN max_fee >= 60000 THEN least(max_tip, max_fee - 60000) ELSE -1 END AS HUGEINT) * 1000000000000 - submission_id AS rank FROM pool)),
    o AS (SELECT submission_id, sender, nonce, gas, row_number() OVER (ORDER BY turn, nonce) - 1 AS rank FROM h)"""


@query("pool_prioritized", "pool", f"""
    WITH RECURSIVE {BEST},
    m AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM o WHERE sender % 25 = 0),
    g AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS ahead UNION ALL SELECT m.k, CASE WHEN used + gas <= 30000 THEN used + gas ELSE used END, used + gas <= 30000 FROM g JOIN m ON m.k = g.k + 1),
    a AS (SELECT rank FROM m JOIN g USING (k) WHERE ahead)
    SELECT submission_id, CAST(row_number() OVER (ORDER BY rank NOT IN (SELECT rank FROM a), rank) - 1 AS BIGINT) AS place FROM o""")
def pool_prioritized(x: Ledger):
    """The whole pool in the order of being taken, with some senders ahead up to a sum of gas."""
    senders = x.table("customer").where("c_custkey % 25 = 0").select(F.col("c_custkey").alias("sender"))
    return pool.prioritized(x.pool, senders, BASE, 30_000).select("submission_id", "place")


@query("pool_without_blobs", "pool", """
    SELECT submission_id FROM pool p WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.sender = p.sender AND b.is_blob AND b.nonce <= p.nonce)""")
def pool_without_blobs(x: Ledger):
    """What is left to be taken if blobs are refused, and with them what waits for them."""
    return pool.accepted(x.pool, ~F.col("is_blob")).select("submission_id")
