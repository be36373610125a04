"""Queries over bodies: withdrawals, blobs, answers to requests; rewards from the grid; state by block hash, what follows the head."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import bodies, fees, history
from ..sources import archive
from .chain_queries import NEXT_FEE
from .history_queries import AS_OF
from .registry import query
from .tool_queries import archive_path
from .views import Ledger

ASKED = (5, 77, -1, 300, 77, 900, 120, 40, -2, 301)
ASKED_ROWS = "(VALUES (CAST(0 AS BIGINT), 5), (1, 77), (2, -1), (3, 300), (4, 77), (5, 900), (6, 120), (7, 40), (8, -2), (9, 301)) v(place, n)"
WITHDRAWN_TEXT = "string_agg(index || ':' || validator || ':' || address || ':' || amount, ',' ORDER BY k)"


@query("withdrawal_faults", "headers withdrawn", f"""
    WITH w AS (SELECT number, sha256({WITHDRAWN_TEXT}) AS root FROM withdrawn GROUP BY 1),
    b AS (SELECT h.number, w.root, CASE WHEN h.number % 211 = 3 THEN reverse(root) WHEN h.number % 401 <> 6 THEN root END AS named FROM headers h LEFT JOIN w USING (number))
    SELECT number, CASE WHEN root IS NULL THEN 'withdrawals missing' WHEN named IS NULL THEN 'withdrawals root missing' ELSE 'withdrawals root' END AS fault FROM b WHERE root IS NULL OR named IS NULL OR named <> root""")
def withdrawal_faults(x: Ledger):
    return bodies.withdrawal_faults(x.withdrawn_between(None, None))


@query("withdrawn_by_address", "withdrawn", "SELECT address, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM withdrawn GROUP BY 1")
def withdrawn_by_address(x: Ledger):
    return bodies.withdrawn(x.withdrawn_between(None, None))


@query("block_with_withdrawals", "headers withdrawn body_indices", f"""
    SELECT h.number, h.hash, b.first_tx_num, b.tx_count, coalesce({WITHDRAWN_TEXT}, '') AS withdrawals FROM headers h JOIN body_indices b USING (number) LEFT JOIN withdrawn w USING (number)
    WHERE number BETWEEN 250 AND 1250 GROUP BY ALL""")
def block_with_withdrawals(x: Ledger):
    """Headers of a range with their bodies' places and withdrawals."""
    paid = x.withdrawn_between(250, 1250).select("number", F.coalesce(bodies.listed(F.col("withdrawals")), F.lit("")).alias("withdrawals"))
    return x.headers_between(250, 1250).select("number", "hash").join(x.body_indices_between(250, 1250), "number").join(paid, "number")


@query("blob_faults", "blob_headers", """
    WITH p AS (SELECT *, lag(number) OVER w AS pn, lag(blob_gas_used) OVER w AS pu, lag(excess_blob_gas) OVER w AS pe FROM blob_headers WINDOW w AS (ORDER BY number))
    SELECT number, 'blob gas missing' AS fault FROM p WHERE blob_gas_used IS NULL
    UNION ALL SELECT number, 'excess blob gas missing' FROM p WHERE excess_blob_gas IS NULL
    UNION ALL SELECT number, 'blob gas is not that of the body' FROM p WHERE blob_gas_used <> blobs * 131072
    UNION ALL SELECT number, 'blob gas is not whole blobs' FROM p WHERE blob_gas_used % 131072 <> 0
    UNION ALL SELECT number, 'blob gas beyond limit' FROM p WHERE blob_gas_used > 786432
    UNION ALL SELECT number, 'excess blob gas' FROM p WHERE pn = number - 1 AND excess_blob_gas <> greatest(coalesce(pe, 0) + coalesce(pu, 0) - 393216, 0)""")
def blob_faults(x: Ledger):
    return bodies.blob_faults(x.blob_headers)


def _asked(x: Ledger):
    """Hashes in the order of a request, some unknown and one twice, and the bodies that are there."""
    hashes = [hashlib.md5(f"block-{n}".encode()).hexdigest() for n in ASKED]
    numbers = [r["number"] for r in x.of_hashes(hashes, "block").collect()]  # one for each hash at most
    found = x.headers_at(numbers).select("number", "hash").join(x.body_indices_at(numbers), "number")
    requests = x.spark.createDataFrame(list(enumerate(hashes)), "place long, hash string")
    return requests, found.withColumn("size", F.col("tx_count") * 110 + 540)


BODIES = f"""
    WITH f AS (SELECT place, md5('block-' || n) AS hash, h.number, b.first_tx_num, b.tx_count, b.tx_count * 110 + 540 AS size
        FROM {ASKED_ROWS} LEFT JOIN headers h ON h.hash = md5('block-' || n) LEFT JOIN body_indices b ON b.number = h.number),
    s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT place, hash, number, first_tx_num, tx_count, size FROM s"""


@query("bodies_by_hash", "headers body_indices", BODIES)
def bodies_by_hash(x: Ledger):
    return bodies.answered(*_asked(x), "hash")


@query("bodies_by_hash_within_bytes", "headers body_indices", BODIES + " WHERE before <= 4000")
def bodies_by_hash_within_bytes(x: Ledger):
    return bodies.answered(*_asked(x), "hash", budget=4000)


@query("bodies_by_range", "headers body_indices", """
    SELECT place, CAST(790 + place AS BIGINT) AS number, first_tx_num, tx_count, size FROM (
        SELECT *, coalesce(sum(size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT r.place, b.first_tx_num, b.tx_count, b.tx_count * 110 + 540 AS size FROM (SELECT unnest(range(0, 1024)) AS place) r LEFT JOIN body_indices b ON b.number = 790 + r.place)) WHERE before <= 2097152""")
def bodies_by_range(x: Ledger):
    """Bodies from block 790 on, nulls beyond the head."""
    requests = x.spark.range(bodies.MOST_SERVED).select(F.col("id").alias("place"), (F.col("id") + 790).alias("number"))
    found = x.body_indices_between(790, 790 + bodies.MOST_SERVED - 1).withColumn("size", F.col("tx_count") * 110 + 540)
    return bodies.answered(requests, found, "number").select("place", "number", "first_tx_num", "tx_count", "size")


@query("rewards_from_grid", "transactions headers", """
    WITH t AS (SELECT number, tx_num, gas, CASE WHEN max_fee >= base_fee THEN least(tip, max_fee - base_fee) ELSE 0 END AS reward FROM transactions JOIN headers USING (number)),
    p AS (SELECT number, reward, sum(gas) OVER (PARTITION BY number ORDER BY reward, tx_num) AS reached, sum(gas) OVER (PARTITION BY number) AS total FROM t)
    SELECT h.number, v.p, CAST(coalesce(min(reward) FILTER (reached >= floor(total * v.q / 100)), max(reward), 0) AS BIGINT) AS reward
    FROM headers h CROSS JOIN (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (12.6, 12.5), (37.38, 37.5), (50.0, 50.0), (99.9, 100.0)) v(p, q) LEFT JOIN p ON p.number = h.number GROUP BY h.number, v.p""")
def rewards_from_grid(x: Ledger):
    """Rewards of all blocks at any percentiles, from the stored points at quarters of a percent."""
    return fees.rewards_from_steps(x.headers, x.reward_grids_between(None, None), (0, 12.6, 37.38, 50, 99.9))


@query("accounts_at_block_hash", "account_changes accounts", AS_OF.format(n=251))
def accounts_at_block_hash(x: Ledger):
    """The state after the block of a hash; an unknown hash has none."""
    found = x.of_hashes([hashlib.md5(b"block-250").hexdigest()], "block").first()
    if found is None:
        return x.accounts.limit(0)
    return history.as_of(x.changes_between(found["number"] + 1, None), x.accounts, found["number"] + 1)


@query("pending_header", "headers", "SELECT number + 1 AS number, hash AS parent_hash, CAST(" + NEXT_FEE.format(fee="base_fee", used="gas_used", target="(gas_limit // 2)") + " AS BIGINT) AS base_fee, gas_limit FROM headers WHERE number = (SELECT max(number) FROM headers)")
def pending_header(x: Ledger):
    """What is known of the block after the head."""
    head = x.headers.agg(F.max("number")).first()[0] or 0
    return x.headers_at([head]).select((F.col("number") + 1).alias("number"), F.col("hash").alias("parent_hash"), fees.next_base_fee(F.col("base_fee"), F.col("gas_used"), F.col("gas_limit")).alias("base_fee"), "gas_limit")


@query("archive_round_trip_framed", "headers", "SELECT number, hash, parent_hash, gas_used FROM headers")
def archive_round_trip_framed(x: Ledger):
    """All headers through an archive of framed snappy values and back."""
    path = archive_path(x)
    archive.export_headers(x.headers.select("number", "hash", "parent_hash", "gas_used"), path, framing="snappy")
    return archive.import_headers(x.spark, path, "number long, hash string, parent_hash string, gas_used long", framing="snappy")
