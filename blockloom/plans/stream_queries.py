"""Queries that run as streams over all events, and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stages
from ..sources import backfill
from ..sources.shared import shared_dir
from ..streaming import assembly, changes, lifecycle
from ..streaming.changelog import ChangeLog
from .registry import query
from .views import HOURS, Ledger

OPS = f"""
    SELECT e.*, {HOURS} AS block, n.seq, CASE WHEN n.seq = 1 THEN 'revert' ELSE 'commit' END AS op, n.seq = 1 AS removed
    FROM events e JOIN (VALUES (0), (1), (2)) n(seq) ON n.seq = 0 OR {HOURS} % 10 = 0"""


@query("stream_logs", "", f"SELECT CAST(block AS BIGINT) AS block, seq, event_id, user_id AS address, event_type AS topic0, removed FROM ({OPS}) WHERE event_type IN ('click', 'purchase')")
def stream_logs(x: Ledger):
    return changes.run_once(changes.log_stream(changes.notifications(changes.event_stream(x.spark, x.sf_dir)), ["click", "purchase"]))


@query("stream_windows", "", """
    WITH w AS (SELECT epoch(ts)::BIGINT // 21600 * 21600 AS start, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL)
    SELECT * FROM w WHERE start + 21600 <= (SELECT epoch_us(max(ts)) // 1000 / 1000.0 - 3600 FROM events)""")
def stream_windows(x: Ledger):
    return changes.run_once(changes.windowed_counts(changes.event_stream(x.spark, x.sf_dir)))


@query("stream_balances", "", "SELECT event_id, user_id AS address, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, value AS after FROM events")
def stream_balances(x: Ledger):
    return changes.balance_changes(changes.run_once(changes.event_stream(x.spark, x.sf_dir).select("event_id", "user_id", "value")))


@query("bodies_reassembled", "headers", """
    WITH d AS (SELECT number, hash, number // 1024 AS bucket FROM headers WHERE number // 64 % 41 <> 40),
    g AS (SELECT number // 1024 AS bucket, min(number) AS gap FROM headers WHERE number // 64 % 41 = 40 GROUP BY 1)
    SELECT number, hash FROM d LEFT JOIN g USING (bucket) WHERE gap IS NULL OR number < gap""")
def bodies_reassembled(x: Ledger):
    """Blocks downloaded in batches of 64 that arrive in any order, some twice and some never: runs without gaps."""
    path, batch = f"{shared_dir(x.spark)}/downloads", F.floor(F.col("number") / 64)
    arrival = F.pmod(F.xxhash64(batch), F.lit(4))
    sent = x.headers.where(batch % 41 != 40).select("number", "hash", F.explode(F.when(batch % 7 == 0, F.array(arrival, (arrival + 1) % 4)).otherwise(F.array(arrival))).alias("arrival"))
    sent.repartition("arrival", F.floor(F.col("number") / (1 << 17))).write.partitionBy("arrival").parquet(path)
    return changes.run_once(assembly.assembled(changes.in_batches(x.spark, path, "number long, hash string", 2))).where("kind = 'block'").select("number", "hash")


SUBMITTED = """
    p AS (SELECT submission_id AS id, sender, nonce, max_fee FROM pool),
    s AS (SELECT id, sender, max(nonce) OVER (PARTITION BY sender) - nonce AS nonce, id * 4 AS seq FROM p)"""


@query("pool_lifecycle", "pool", f"""
    WITH {SUBMITTED},
    t AS (SELECT *, max(id) OVER (PARTITION BY sender) * 4 AS top FROM s),
    e AS (
        SELECT sender, seq, 0 AS step, id, 'queued' AS event FROM t WHERE nonce > 0 UNION ALL SELECT sender, seq, 0, id, 'pending' FROM t WHERE nonce = 0
        UNION ALL SELECT f.sender, f.seq, CAST(t.nonce AS INTEGER), t.id, 'pending' FROM t JOIN t f ON f.sender = t.sender AND f.nonce = 0 AND t.nonce > 0
        UNION ALL SELECT sender, top + 1, 0, id, 'mined' FROM t WHERE nonce = 0
        UNION ALL SELECT sender, top + 2, 0, id, 'discarded' FROM t WHERE nonce = 1
        UNION ALL SELECT sender, top + 2, CAST(nonce - 1 AS INTEGER), id, 'queued' FROM t WHERE nonce > 1)
    SELECT sender, CAST(seq AS BIGINT) AS seq, step, id, event FROM e""")
def pool_lifecycle(x: Ledger):
    """The pool's transactions, submitted from each sender's last nonce down; its first one is mined, its second dropped."""
    path = f"{shared_dir(x.spark)}/submissions"
    pool = x.pool.select(F.col("submission_id").alias("id"), "sender", "nonce", "max_fee")
    ids = pool.groupBy("sender").agg(F.max("id").alias("top"), F.max("nonce").alias("last"))
    # Ids rise with nonces; the row of a nonce takes the id of its mirror, so that a sender's ids rise as nonces fall.
    mirrored = pool.join(ids, "sender").select("sender", (F.col("last") - F.col("nonce")).alias("nonce"), F.col("id"), "max_fee", "top")
    rows = mirrored.select(F.array(
        F.struct((F.col("id") * 4).alias("seq"), F.lit("submit").alias("kind"), "nonce", "id", "max_fee"),
        F.when(F.col("nonce") == 0, F.struct((F.col("top") * 4 + 1).alias("seq"), F.lit("included").alias("kind"), "nonce", "id", "max_fee")),
        F.when(F.col("nonce") == 1, F.struct((F.col("top") * 4 + 2).alias("seq"), F.lit("drop").alias("kind"), "nonce", "id", "max_fee")),
    ).alias("r"), "sender")
    rows.select("sender", F.explode(F.array_compact("r")).alias("r")).select("sender", "r.*").write.parquet(path)
    stream = x.spark.readStream.schema("sender long, seq long, kind string, nonce long, id long, max_fee long").parquet(path)
    return changes.run_once(lifecycle.events(stream))


CUTS = """
    g AS (SELECT number, CAST(sum(gas_used) OVER (ORDER BY number) AS BIGINT) AS gas, CAST(sum(tx_count) OVER (ORDER BY number) AS BIGINT) AS txs FROM headers JOIN body_indices USING (number)),
    c AS (SELECT CAST(40 AS BIGINT) AS first, min(number) AS last FROM g WHERE number >= 40 AND (number - 39 >= 300 OR gas - (SELECT gas FROM g WHERE number = 39) >= 500000 OR txs - (SELECT txs FROM g WHERE number = 39) >= 1000)
          UNION ALL SELECT p.last + 1, min(g.number) FROM (SELECT c.last, h.gas, h.txs FROM c JOIN g h ON h.number = c.last) p
          JOIN g ON g.number > p.last AND (g.number - p.last >= 300 OR g.gas - p.gas >= 500000 OR g.txs - p.txs >= 1000 OR g.number = (SELECT max(number) FROM headers)) GROUP BY p.last)"""


@query("feed_backfilled", "headers body_indices", f"WITH RECURSIVE {CUTS} SELECT first AS batch, number, hash FROM c JOIN headers h ON h.number BETWEEN c.first AND c.last")
def feed_backfilled(x: Ledger):
    """All blocks from 40 on for a consumer that starts late, in batches cut by blocks, gas and transactions."""
    blocks = x.headers.select("number", "gas_used").join(x.body_indices.select("number", "tx_count"), "number")
    cuts = stages.batches(blocks, 40, 300, {"gas_used": 500_000, "tx_count": 1000})
    path = shared_dir(x.spark)
    for stream in backfill.in_runs(x.spark, cuts):
        fed = changes.run_once(stream, path)
    return fed.join(x.headers.select("number", "hash"), "number")


FEED = f"""
    SELECT DISTINCT {HOURS} AS block, n.seq, CASE WHEN n.seq = 1 THEN 'revert' ELSE 'commit' END AS op
    FROM events JOIN (VALUES (0), (1), (2)) n(seq) ON n.seq = 0 OR {HOURS} % 10 = 0"""


@query("change_log", "", f"SELECT CAST(block AS BIGINT) AS number, md5('block-' || block || '-' || CASE WHEN block % 10 = 0 AND seq < 2 THEN 'left' ELSE 'chain' END) AS hash, op, CAST(seq AS BIGINT) AS seq FROM ({FEED}) WHERE block > (SELECT min({HOURS}) + 99 FROM events)")
def change_log(x: Ledger):
    """Commits and reverts of all blocks logged from a stream; what all consumers have finished is taken away, if it fills a batch."""
    log = ChangeLog(x.spark, f"{shared_dir(x.spark)}/log")
    log.sink(changes.block_notifications(changes.notifications(changes.event_stream(x.spark, x.sf_dir))))
    first = log.read().agg(F.min("number")).first()[0]
    log.truncate((first or 0) + 99)
    return log.read(None if first is None else first + 100).select("number", "hash", "op", "seq")


@query("finalized_commits", "", f"SELECT event_id, CAST({HOURS} AS BIGINT) AS block FROM events WHERE {HOURS} <= (SELECT min({HOURS}) + 500 FROM events)")
def finalized_commits(x: Ledger):
    notes = changes.notifications(x.table("events"))
    first = notes.agg(F.min("block")).first()[0] or 0
    return changes.finalized(notes, first + 500)


@query("removed_receipts", "", f"SELECT CAST(block AS BIGINT) AS block, count(*) FILTER (removed) AS removed, count(*) FILTER (NOT removed) AS committed FROM ({OPS}) GROUP BY 1")
def removed_receipts(x: Ledger):
    return changes.notifications(x.table("events")).groupBy("block").agg(F.count(F.when(F.col("removed"), 1)).alias("removed"), F.count(F.when(~F.col("removed"), 1)).alias("committed"))


@query("reorg_point", "headers", "SELECT (SELECT max(number) - 5 FROM headers) AS first, 6::BIGINT AS blocks")
def reorg_point(x: Ledger):
    ours = x.headers.select("number", "hash")
    tip = ours.agg(F.max("number")).first()[0]
    theirs = ours.select("number", F.when(F.col("number") > tip - 6, F.md5("hash")).otherwise(F.col("hash")).alias("other"))
    return changes.reorg_depth(ours, theirs)


@query("consumers_finished", "account_changes", "SELECT min(h) AS height FROM (SELECT address % 4 AS c, max(block) AS h FROM account_changes GROUP BY 1)")
def consumers_finished(x: Ledger):
    heights = x.account_changes.groupBy((F.col("address") % 4).alias("consumer")).agg(F.max("block").alias("height"))
    return changes.finished_height(heights, 4)
