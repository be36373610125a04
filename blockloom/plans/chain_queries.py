"""Queries over blocks, transactions, receipts, logs and fees."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import position_within
from ..operators import chain, fees, history, logs, tree
from .registry import query
from .views import Ledger

NEXT_FEE = "CASE WHEN {used} = {target} THEN {fee} WHEN {used} > {target} THEN {fee} + greatest({fee} * ({used} - {target}) // {target} // 8, 1) ELSE greatest({fee} - {fee} * ({target} - {used}) // {target} // 8, 0) END"
TOPICS = (["click", "purchase", "view", "login"], None)


def _head(x: Ledger) -> int:
    return x.headers.agg(F.max("number")).first()[0]


def _log_head(x: Ledger) -> int:
    return x.logs.agg(F.max("block")).first()[0]


@query("log_search", "logs", "SELECT block, log_index, address, topic0, topic1, data FROM logs WHERE block BETWEEN 24 AND 480 AND address IN (1, 7, 11, 42, 99) AND topic0 IN ('click', 'purchase', 'view', 'login')")
def log_search(x: Ledger):
    bounds = logs.block_range(24, 480, _log_head(x))
    return logs.checked(logs.search(x.logs_between(*bounds), bounds, [1, 7, 11, 42, 99], TOPICS), bounds).select("block", "log_index", "address", "topic0", "topic1", "data")


@query("log_search_wildcard", "logs", "SELECT block, log_index, address, topic0, topic1 FROM logs WHERE topic1 IN (10, 20, 30, 40)")
def log_search_wildcard(x: Ledger):
    return logs.search(x.logs, (0, _log_head(x)), None, (None, [10, 20, 30, 40])).select("block", "log_index", "address", "topic0", "topic1")


@query("log_poll", "logs", "SELECT block, log_index, address FROM logs WHERE block > (SELECT max(block) - 48 FROM logs) AND topic0 = 'purchase'")
def log_poll(x: Ledger):
    return logs.since(x.logs, _log_head(x) - 48, None, (["purchase"],)).select("block", "log_index", "address")


@query("log_search_with_balance", "logs account_changes accounts", """
    SELECT l.block, l.log_index, l.address, l.topic0, CASE WHEN c.address IS NOT NULL THEN c.before ELSE a.value END AS balance
    FROM logs l JOIN accounts a USING (address)
    LEFT JOIN (SELECT address, arg_min_null(before, block) AS before FROM account_changes WHERE block >= 360 GROUP BY address) c USING (address)
    WHERE l.block BETWEEN 24 AND 480 AND l.topic0 IN ('click', 'purchase', 'view', 'login')""")
def log_search_with_balance(x: Ledger):
    found = logs.search(x.logs_between(24, 480), (24, 480), None, TOPICS).select("block", "log_index", "address", "topic0")
    return found.join(history.as_of(x.account_changes, x.accounts, 360).withColumnRenamed("value", "balance"), "address")


@query("log_search_by_bloom", "logs", "SELECT block, log_index, address, topic0, topic1 FROM logs WHERE address IN (3, 5, 77, 101) AND topic0 = 'purchase' AND topic1 BETWEEN 20 AND 39")
def log_search_by_bloom(x: Ledger):
    wanted = {"address": [3, 5, 77, 101], "topic0": ["purchase"], "topic1": range(20, 40)}
    return logs.by_blooms(x.logs_of_segments, x.segment_blooms, x.block_blooms, wanted).select("block", "log_index", "address", "topic0", "topic1")


@query("block_blooms", "logs", """
    WITH v AS (SELECT block, md5('address=' || address) AS h FROM logs UNION ALL SELECT block, md5('topic0=' || topic0) FROM logs UNION ALL SELECT block, md5('topic1=' || topic1) FROM logs WHERE topic1 IS NOT NULL),
    b AS (SELECT block, CAST('0x' || substr(h, 4 * k + 1, 4) AS INTEGER) % 2048 AS bit FROM v, (VALUES (0), (1), (2)) t(k))
    SELECT block, count(DISTINCT bit) AS bits FROM b GROUP BY 1""")
def block_blooms(x: Ledger):
    """How full each block's filter is."""
    return x.block_blooms.select("block", F.bitmap_count("bloom").alias("bits"))


@query("block_logs_digest", "logs", "SELECT block, count(*) AS n_logs, count(DISTINCT address) AS n_addresses, count(DISTINCT topic0) AS n_topics FROM logs GROUP BY block")
def block_logs_digest(x: Ledger):
    return x.logs.groupBy("block").agg(F.count(F.lit(1)).alias("n_logs"), F.countDistinct("address").alias("n_addresses"), F.countDistinct("topic0").alias("n_topics"))


@query("header_range", "headers", "SELECT * FROM headers WHERE number BETWEEN 100 AND 1100")
def header_range(x: Ledger):
    return x.headers_between(100, 1100)


@query("header_by_hash", "headers", "SELECT * FROM headers WHERE hash IN (md5('block-5'), md5('block-77'), md5('block-900'))")
def header_by_hash(x: Ledger):
    return _of_hashes(x, [hashlib.md5(f"block-{n}".encode()).hexdigest() for n in (5, 77, 900)])


def _of_hashes(x: Ledger, hashes: list[str]) -> DataFrame:
    """The headers of a few hashes, by the index of hashes and their blocks' folders."""
    return x.headers_at([r["number"] for r in x.of_hashes(hashes, "block").collect()])  # one for each hash at most


@query("canonical_hashes", "headers", "SELECT number, hash FROM headers WHERE number >= 10 AND number < 60")
def canonical_hashes(x: Ledger):
    return x.headers_between(10, 59).select("number", "hash")


@query("chain_info", "headers", "SELECT max(number) AS best_number, arg_max(hash, number) AS best_hash, min(number) AS earliest FROM headers")
def chain_info(x: Ledger):
    return x.headers.agg(F.max("number").alias("best_number"), F.max_by("hash", "number").alias("best_hash"), F.min("number").alias("earliest"))


@query("headers_while", "headers", "SELECT number, base_fee FROM headers WHERE number < (SELECT min(number) FROM headers WHERE base_fee >= 250)")
def headers_while(x: Ledger):
    return chain.take_while(x.headers, "number", F.col("base_fee") < 250).select("number", "base_fee")


@query("headers_stepped", "headers", "SELECT number, hash FROM headers WHERE number >= 7 AND (number - 7) % 4 = 0 AND number < 7 + 4 * 1024")
def headers_stepped(x: Ledger):
    return x.headers_between(7, 6 + 4 * 1024).where((F.col("number") - 7) % 4 == 0).select("number", "hash")


@query("body_indices", "body_indices", "SELECT * FROM body_indices")
def body_indices(x: Ledger):
    return x.body_indices


@query("block_assembled", "headers transactions", """
    SELECT h.number, h.hash, list(t.hash ORDER BY t.idx) FILTER (t.hash IS NOT NULL) IS NULL AS empty, coalesce(string_agg(t.hash, ',' ORDER BY t.idx), '') AS txs
    FROM headers h LEFT JOIN transactions t USING (number) GROUP BY ALL""")
def block_assembled(x: Ledger):
    return _assembled(x.headers, x.transactions)


def _assembled(headers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions are listed before the join, so that both sides have a row for each block."""
    listed = transactions.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("l")).select("number", F.array_join(F.transform("l", lambda s: s["hash"]), ",").alias("txs"))
    return headers.select("number", "hash").join(listed, "number", "left").select("number", "hash", F.col("txs").isNull().alias("empty"), F.coalesce("txs", F.lit("")).alias("txs"))


@query("block_of_transaction", "transactions", "SELECT tx_num, number FROM transactions")
def block_of_transaction(x: Ledger):
    return chain.block_of_tx(x.body_indices, x.transactions.select("tx_num")).select("tx_num", "number")


@query("transactions_with_meta", "transactions headers", "SELECT t.hash, t.idx, h.hash AS block_hash, h.number, h.base_fee, h.ts FROM transactions t JOIN headers h USING (number)")
def transactions_with_meta(x: Ledger):
    return x.enriched_between(None, None).select("hash", "idx", "block_hash", "number", "base_fee", "ts")


@query("transactions_by_block_range", "headers transactions", """
    SELECT h.number, count(t.tx_num) AS n, coalesce(min(t.tx_num), -1) AS first_tx, coalesce(max(t.tx_num), -1) AS last_tx
    FROM headers h LEFT JOIN transactions t USING (number) WHERE h.number BETWEEN 500 AND 5000 GROUP BY 1""")
def transactions_by_block_range(x: Ledger):
    held = F.col("tx_count") > 0
    return x.body_indices_between(500, 5000).select("number", F.col("tx_count").alias("n"), F.when(held, F.col("first_tx_num")).otherwise(-1).alias("first_tx"), F.when(held, F.col("first_tx_num") + F.col("tx_count") - 1).otherwise(-1).alias("last_tx"))


@query("tx_range_of_blocks", "body_indices", "SELECT min(first_tx_num) AS first_tx, max(first_tx_num + tx_count - 1) AS last_tx FROM body_indices WHERE number BETWEEN 100 AND 300 AND tx_count > 0")
def tx_range_of_blocks(x: Ledger):
    return x.body_indices_between(100, 300).where("tx_count > 0").agg(F.min("first_tx_num").alias("first_tx"), F.max(F.col("first_tx_num") + F.col("tx_count") - 1).alias("last_tx"))


@query("transaction_by_sender_nonce", "transactions", """
    SELECT sender, nonce, tx_num FROM (SELECT sender, tx_num, row_number() OVER (PARTITION BY sender ORDER BY tx_num) - 1 AS nonce FROM transactions) WHERE nonce IN (0, 5, 17)""")
def transaction_by_sender_nonce(x: Ledger):
    return position_within(x.transactions.select("sender", "tx_num"), ["sender"], "tx_num", "nonce").where(F.col("nonce").isin(0, 5, 17)).select("sender", "nonce", "tx_num")


@query("transaction_by_block_and_index", "transactions", "SELECT number, idx, hash FROM transactions WHERE idx = 2")
def transaction_by_block_and_index(x: Ledger):
    return x.transactions.where("idx = 2").select("number", "idx", "hash")


@query("senders_by_tx_range", "transactions", "SELECT tx_num, sender FROM transactions WHERE tx_num BETWEEN 1000 AND 9000")
def senders_by_tx_range(x: Ledger):
    return chain.in_range(x.transactions_between(*x.blocks_of_tx_range(1000, 9000)).select("tx_num", "sender"), "tx_num", 1000, 9000)


@query("receipts_by_block_range", "headers receipts", """
    SELECT h.number, count(r.tx_num) AS n, coalesce(max(r.cumulative_gas), 0) AS gas, count(r.tx_num) FILTER (r.success) AS n_success
    FROM headers h LEFT JOIN receipts r USING (number) GROUP BY 1""")
def receipts_by_block_range(x: Ledger):
    return _receipt_sums(x.headers, x.receipts)


def _receipt_sums(headers: DataFrame, receipts: DataFrame) -> DataFrame:
    sums = receipts.groupBy("number").agg(F.count("tx_num").alias("n"), F.max("cumulative_gas").alias("gas"), F.count(F.when(F.col("success"), 1)).alias("n_success"))
    return headers.select("number").join(sums, "number", "left").fillna(0, ["n", "gas", "n_success"])


@query("block_receipts", "receipts transactions headers", """
    SELECT r.tx_num, t.hash, r.success, r.cumulative_gas - lag(r.cumulative_gas, 1, 0) OVER (PARTITION BY r.number ORDER BY r.idx) AS gas_used, least(t.max_fee, h.base_fee + t.tip) AS effective_price
    FROM receipts r JOIN transactions t USING (tx_num) JOIN headers h ON h.number = r.number""")
def block_receipts(x: Ledger):
    return chain.with_effective_price(x.enriched_between(None, None)).select("tx_num", "hash", "success", "gas_used", "effective_price")


@query("block_details", "transactions headers", """
    SELECT h.number, h.gas_used, count(t.tx_num) AS n_txs, coalesce(sum(t.gas * least(t.max_fee, h.base_fee + t.tip)), 0)::BIGINT AS total_fees FROM headers h LEFT JOIN transactions t USING (number) GROUP BY 1, 2""")
def block_details(x: Ledger):
    paid = chain.with_effective_price(x.enriched_between(None, None))
    sums = paid.groupBy("number").agg(F.count(F.lit(1)).alias("n_txs"), F.sum(F.col("gas") * F.col("effective_price")).alias("total_fees"))
    return x.headers.select("number", "gas_used").join(sums, "number", "left").fillna(0, ["n_txs", "total_fees"])


@query("block_transaction_page", "transactions", "SELECT number, idx, hash FROM transactions WHERE idx >= 2 AND idx < 4")
def block_transaction_page(x: Ledger):
    return _page(x.transactions, 1, 2)


def _page(transactions: DataFrame, page: int, size: int) -> DataFrame:
    """The same page of every block's transactions."""
    return transactions.where((F.col("idx") >= page * size) & (F.col("idx") < (page + 1) * size)).select("number", "idx", "hash")


@query("reward_percentiles", "paid headers", """
    WITH r AS (SELECT number, coalesce(effective, 0) AS tip, sum(gas) OVER (PARTITION BY number ORDER BY coalesce(effective, 0), tx_num) AS reached FROM paid),
    w AS (SELECT number, gas_used, p FROM headers, (VALUES (10.0), (50.0), (60.0), (90.0)) v(p))
    SELECT w.number, CAST(w.p AS DOUBLE) AS p, CAST(coalesce(min(tip) FILTER (reached >= floor(gas_used * CAST(p AS DOUBLE) / 100)), max(tip), 0) AS BIGINT) AS reward FROM w LEFT JOIN r USING (number) GROUP BY ALL""")
def reward_percentiles(x: Ledger):
    return fees.reward_percentiles(x.enriched_between(None, None), x.headers, (10, 50, 60, 90))


@query("fee_history", "headers", """
    SELECT number, base_fee, gas_used / gas_limit AS gas_used_ratio FROM headers WHERE number BETWEEN 200 AND 1223
    UNION ALL
    SELECT number + 1, CAST(""" + NEXT_FEE.format(fee="base_fee", used="gas_used", target="(gas_limit // 2)") + """ AS BIGINT), NULL FROM headers WHERE number = 1223""")
def fee_history(x: Ledger):
    return fees.fee_history(x.headers_between(200, 1223), 200, 1223)


@query("lowest_tips", "paid", """
    SELECT number, place, tip FROM (SELECT number, effective AS tip, row_number() OVER (PARTITION BY number ORDER BY effective, tx_num) AS place
    FROM paid WHERE sender <> beneficiary AND effective >= 2) WHERE place <= 3""")
def lowest_tips(x: Ledger):
    return fees.lowest_tips(x.enriched_between(None, None))


SUGGESTED_TIP = """
    WITH looked AS (SELECT * FROM headers WHERE number > (SELECT max(number) - least(max(number), 2048) FROM headers)),
    s AS (SELECT t.number, t.effective AS tip, row_number() OVER (PARTITION BY t.number ORDER BY t.effective, t.tx_num) AS place FROM looked h JOIN paid t USING (number) WHERE t.sender <> t.beneficiary AND t.effective >= 2),
    f AS (SELECT l.number, s.tip FROM looked l LEFT JOIN (SELECT * FROM s WHERE place <= 3) s USING (number)),
    b AS (SELECT number, coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (ORDER BY number DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM (SELECT number, count(tip) AS n FROM f GROUP BY 1)),
    v AS (SELECT coalesce(tip, 0) AS tip FROM f JOIN b USING (number) WHERE seen < 20),
    l AS (SELECT list(tip ORDER BY tip) AS tips FROM v)
    SELECT CAST(least(tips[((len(tips) - 1) * 60) // 100 + 1], 500000000000) AS BIGINT) AS tip FROM l"""


@query("suggested_tip", "paid headers", SUGGESTED_TIP)
def suggested_tip(x: Ledger):
    head = _head(x)
    reach = (head - 2 * fees.MAX_HISTORY, head)
    return fees.suggested_tip(x.enriched_between(*reach), x.headers_between(*reach), head)


@query("median_tip", "paid", "SELECT number, median(effective) AS median_tip, max(gas) AS max_gas FROM paid GROUP BY 1")
def median_tip(x: Ledger):
    return fees.median_tips(x.enriched_between(None, None))


@query("gas_by_recipient_and_sender", "transactions", "SELECT recipient, sender, success, sum(gas)::BIGINT AS gas, count(*) AS n FROM transactions GROUP BY ALL")
def gas_by_recipient_and_sender(x: Ledger):
    return x.transactions.groupBy("recipient", "sender", "success").agg(F.sum("gas").alias("gas"), F.count(F.lit(1)).alias("n"))


@query("header_faults", "headers", """
    WITH p AS (SELECT *, lag(number) OVER w AS pn, lag(hash) OVER w AS ph, lag(ts) OVER w AS pt, lag(gas_used) OVER w AS pg, lag(gas_limit) OVER w AS pl, lag(base_fee) OVER w AS pb FROM headers WINDOW w AS (ORDER BY number)),
    f AS (
        SELECT number, 'gas used beyond limit' AS fault FROM p WHERE gas_used > gas_limit
        UNION ALL SELECT number, 'number is not the parent''s plus one' FROM p WHERE number <> pn + 1
        UNION ALL SELECT number, 'parent hash' FROM p WHERE parent_hash <> ph
        UNION ALL SELECT number, 'timestamp not after the parent''s' FROM p WHERE ts <= pt
        UNION ALL SELECT number, 'gas limit moved too far' FROM p WHERE abs(gas_limit - pl) >= pl // 1024
        UNION ALL SELECT number, 'gas limit below the minimum' FROM p WHERE pn IS NOT NULL AND gas_limit < 5000
        UNION ALL SELECT number, 'base fee' FROM p WHERE pn IS NOT NULL AND base_fee <> """ + NEXT_FEE.format(fee="pb", used="pg", target="(pl // 2)") + """)
    SELECT * FROM f""")
def header_faults(x: Ledger):
    return chain.header_faults(x.headers)


@query("body_faults", "headers transactions", "SELECT h.number, h.gas_used, coalesce(sum(t.gas), 0)::BIGINT AS body_gas, 0::BIGINT AS receipt_gas FROM headers h LEFT JOIN transactions t USING (number) GROUP BY 1, 2 HAVING h.gas_used <> coalesce(sum(t.gas), 0)")
def body_faults(x: Ledger):
    return chain.body_faults(x.headers, x.transactions, x.receipts)


@query("key_gaps", "transactions", """
    SELECT k + 1 AS start, n - 1 AS "end" FROM (SELECT tx_num AS k, lead(tx_num) OVER (ORDER BY tx_num) AS n FROM transactions WHERE NOT success OR gas > 500) WHERE n > k + 1""")
def key_gaps(x: Ledger):
    return chain.gaps(x.transactions.where("NOT success OR gas > 500").select("tx_num"), "tx_num")


@query("segment_split_and_append", "headers", "SELECT number, hash FROM headers")
def segment_split_and_append(x: Ledger):
    return chain.append_chain(*chain.split_at(x.headers, 400)).select("number", "hash")


@query("body_requests", "headers", """
    SELECT hi AS first, greatest(hi - 511, 100) AS last FROM (SELECT unnest(range((SELECT max(number) FROM headers), 99, -512)) AS hi)""")
def body_requests(x: Ledger):
    """The gap between block 100 and the head as descending requests of 512."""
    tip = x.headers.agg(F.max("number").alias("tip"))
    return tip.select(F.explode(F.sequence(F.col("tip"), F.lit(100).cast("long"), F.lit(-512).cast("long"))).alias("first")).withColumn("last", F.greatest(F.col("first") - 511, F.lit(100)))


@query("block_ancestors", "headers", "SELECT number, hash, CAST(700 - number AS BIGINT) AS depth FROM headers WHERE number BETWEEN 684 AND 700")
def block_ancestors(x: Ledger):
    return tree.ancestors(x.headers_between(684, 700), hashlib.md5(b"block-700").hexdigest(), 16)


@query("block_tree", "tree", "SELECT number, hash, CASE WHEN kind = 'lost' THEN hash ELSE md5('block-0') END AS root, CASE WHEN kind = 'lost' THEN 0 ELSE number END AS depth FROM tree")
def block_tree(x: Ledger):
    """Where each block of all forks comes from, and how far."""
    return tree.rooted(x.tree)


@query("block_tree_canonical", "headers", "SELECT number, hash FROM headers")
def block_tree_canonical(x: Ledger):
    """The chain of the best head among all forks."""
    return tree.canonical(x.tree)


@query("block_tree_descends", "tree", "SELECT number, hash, kind = 'chain' AND number > 325 OR kind IN ('fork', 'twig') AND f >= 325 AS descends FROM tree")
def block_tree_descends(x: Ledger):
    """Of all blocks, those that descend from block 325, where a fork begins."""
    return tree.descends(x.tree, hashlib.md5(b"block-325").hexdigest())


@query("block_tree_finalized", "tree headers", """
    WITH t AS (SELECT greatest(max(number) // 50 * 50 - 23, 0) AS n FROM headers)
    SELECT number, hash, CASE WHEN number < n THEN 'below' WHEN kind = 'chain' OR kind IN ('fork', 'twig') AND f >= n OR kind = 'lost' AND number > n THEN 'kept' ELSE 'side' END AS fate FROM tree, t""")
def block_tree_finalized(x: Ledger):
    """What becomes of all blocks once one near the head is final, two blocks into a fork."""
    number = max((_head(x) or 0) // 50 * 50 - 23, 0)
    return tree.after_finality(x.tree, number, hashlib.md5(f"block-{number}".encode()).hexdigest())


@query("orphan_blocks", "headers", "SELECT number, hash FROM headers WHERE (number - 1) % 97 = 0 AND number > 0 AND number % 97 <> 0")
def orphan_blocks(x: Ledger):
    return chain.orphans(x.headers.where("number % 97 <> 0")).select("number", "hash")


@query("block_tags", "headers", """
    SELECT 'latest' AS tag, max(number) AS number FROM headers UNION ALL SELECT 'earliest', min(number) FROM headers
    UNION ALL SELECT 'safe', greatest(max(number) - 32, min(number)) FROM headers UNION ALL SELECT 'finalized', greatest(max(number) - 64, min(number)) FROM headers""")
def block_tags(x: Ledger):
    return chain.tags(x.headers)


@query("transaction_count_as_of", "transactions", "SELECT sender, count(*) AS nonce FROM transactions WHERE number <= 1000 GROUP BY 1")
def transaction_count_as_of(x: Ledger):
    return x.transactions_between(None, 1000).groupBy("sender").agg(F.count(F.lit(1)).alias("nonce"))
