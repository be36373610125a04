"""Edge cases of the ledger operators on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from blockloom.functions import encodings
from blockloom.functions.ranks import position_within, positions, prefix_minima, prefix_sums, previous_within, take_until
from blockloom.operators import chain, fees, history, logs, pool, retention, stages, tools
from blockloom.sources import archive


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_block_range():
    assert logs.block_range(None, None, 10) == (10, 10)
    assert logs.block_range(11, None, 10) is None
    for bad in ((1, 11), (5, 3), (0, 10)):
        with pytest.raises(logs.RangeError):
            logs.block_range(*bad, 10, earliest=1)
    with pytest.raises(logs.RangeError):
        logs.block_range(0, 200_000, 300_000)


def test_too_many_logs_names_the_last_block_that_fits(spark):
    df = table(spark, [(b, i) for b in range(4) for i in range(3)], "block long, log_index long")
    assert logs.checked(df, (0, 3), 12).count() == 12
    assert logs.checked(df.where("block = 1"), (1, 1), 2).count() == 3  # a single block is never refused
    with pytest.raises(logs.RangeError, match="blocks 0 to 1"):
        logs.checked(df, (0, 3), 8)


def test_topics_are_positional_and_empty_positions_match_all(spark):
    df = table(spark, [(1, "a", 1), (1, "b", 2), (2, "a", 2)], "address long, topic0 string, topic1 long")
    assert listed(df.where(logs.matches(None, [None, [2]])).select("address", "topic0")) == [(1, "b"), (2, "a")]
    assert df.where(logs.matches([], [[], None])).count() == 3
    assert df.where(logs.matches([2], [["b"]])).count() == 0


CHANGES = [(2, "a", None, 1.0), (5, "a", 1.0, 2.0), (9, "a", 2.0, 3.0), (5, "b", None, 7.0)]


def replay(block, key):
    value = None
    for b, k, _, after in sorted(CHANGES):
        if k == key and b < block:
            value = after
    return value


@pytest.mark.parametrize("block", range(12))
def test_as_of_equals_replay(spark, block):
    changes = table(spark, CHANGES, "block long, address string, before double, after double")
    current = table(spark, [("a", 3.0), ("b", 7.0), ("never", 4.0)], "address string, value double")
    got = dict(listed(history.as_of(changes, current, block)))
    assert got == {"a": replay(block, "a"), "b": replay(block, "b"), "never": 4.0}
    many = history.as_of_many(changes, current, current.select("address", F.lit(block).cast("long").alias("block")))
    assert {r["address"]: r["value"] for r in many.collect()} == got


def test_changed_balances_leave_out_what_stayed(spark):
    changes = table(spark, [(1, "a", 1.0, 1.0), (1, "b", 1.0, 2.0)], "block long, address string, before double, after double")
    current = table(spark, [("a", 1.0), ("b", 2.0)], "address string, value double")
    assert listed(history.changed_balances(changes, current, 1)) == [("b", 2.0)]


def test_index_shards_at_their_bounds(spark):
    for n in (1, 4, 5, 8, 9):
        shards = history.index_shards(table(spark, [(k, "x") for k in range(n)], "block long, address string"), ["address"], 4)
        rows = sorted(shards.select("shard_end", "blocks").collect())
        assert [len(r["blocks"]) for r in rows] == [4] * (n // 4) + ([n % 4] if n % 4 else [])
        assert rows[-1]["shard_end"] == 2**63 - 1
        assert [b for r in rows for b in r["blocks"]] == list(range(n))
    trimmed = history.trim_shards(shards, ["address"], 6, 4)
    assert [r["blocks"] for r in trimmed.collect()] == [[7, 8]]


def test_positions_and_sums_across_ranges(spark):
    keys = [3, 10, 11, 4095, 4096, 9000, 123456]
    got = positions(table(spark, [(k,) for k in keys], "k long"), "k", "p").collect()
    assert sorted((r["k"], r["p"]) for r in got) == [(k, i) for i, k in enumerate(keys)]
    sums = prefix_sums(table(spark, [(k, 2) for k in keys], "k long, n long"), "k", "n", "before", width=8).collect()
    assert sorted((r["k"], r["before"]) for r in sums) == [(k, 2 * i) for i, k in enumerate(keys)]


def test_positions_and_neighbours_within_groups(spark):
    rows = [(g, k, k * 10 + g) for g in (1, 2) for k in (0, 3, 7, 8, 9, 20, 33) if k % (g + 1) != 1]
    df = table(spark, rows, "g long, k long, v long")
    at = {(r["g"], r["k"]): (r["p"], r["b"]) for r in previous_within(position_within(df, ["g"], "k", "p", 8), ["g"], "k", "v", "b", 8).collect()}
    for g in (1, 2):
        mine = [r for r in rows if r[0] == g]
        assert [at[g, k] for _, k, _ in mine] == [(i, mine[i - 1][2] if i else None) for i in range(len(mine))]
    low = prefix_minima(df.where("g = 1").withColumn("v", F.abs(F.col("k") - 8)), "k", "v", "m", 3).orderBy("k").collect()
    assert [r["m"] for r in low] == [min(abs(k - 8) for _, k, _ in rows if _ == _ and k <= r["k"] and (1, k, k * 10 + 1) in rows) for r in low]


def test_take_until(spark):
    rows = [(a, b, (3 * a + b) % 5 + 1) for a in range(6) for b in range(7)]
    df = table(spark, rows, "a long, b long, n long").withColumn("one", F.lit(1))
    for need in (0, 1, 9, 40, 125, 10**6):
        total, want = 0, []
        for r in sorted(rows):
            if total >= need and (len(want) >= need // 10):
                break
            want.append(r[:2])
            total += r[2]
        assert sorted((r["a"], r["b"]) for r in take_until(df, ["a", "b"], {"n": need, "one": need // 10}).collect()) == want


def test_reward_percentiles_of_empty_block_and_ties(spark):
    headers = table(spark, [(0, 0), (1, 30)], "number long, gas_used long")
    txs = table(spark, [(1, 5, 0, 10, 100, 7), (1, 5, 1, 10, 100, 7), (1, 9, 2, 10, 100, 7)], "number long, tip long, tx_num long, gas long, max_fee long, base_fee long")
    got = {(r["number"], r["p"]): r["reward"] for r in fees.reward_percentiles(txs, headers, (0, 60, 70, 100)).collect()}
    assert got == {(0, p): 0 for p in (0.0, 60.0, 70.0, 100.0)} | {(1, 0.0): 5, (1, 60.0): 5, (1, 70.0): 9, (1, 100.0): 9}


#: tx_num, sender, gas, tip cap, fee cap of a block of beneficiary 9 with a base fee of 100, and the tip that is paid.
PAID = [
    (0, 1, 10, 50, 99, None), (1, 1, 10, 50, 100, 0), (2, 2, 10, 50, 101, 1), (3, 2, 10, 50, 130, 30), (4, 3, 10, 50, 150, 50), (5, 3, 10, 50, 400, 50), (6, 9, 10, 2, 400, 2), (7, 4, 10, 0, 400, 0), (8, 4, 10, 7, 107, 7),
]


def test_tips_are_what_is_paid_above_the_base_fee(spark):
    """Caps below the base fee, at it, between it and the tip, and beyond."""
    txs = table(spark, [(5, *r[:5], 100, 9) for r in PAID], "number long, tx_num long, sender long, gas long, tip long, max_fee long, base_fee long, beneficiary long")
    headers = table(spark, [(5, 90)], "number long, gas_used long")
    assert [r["t"] for r in txs.select("tx_num", fees.effective_tip().alias("t")).orderBy("tx_num").collect()] == [r[5] for r in PAID]
    # Without the beneficiary's own, and those below 2, refused ones included: 7, 30, 50 (the earlier of two).
    assert [(r["place"], r["tip"]) for r in fees.lowest_tips(txs).orderBy("place").collect()] == [(1, 7), (2, 30), (3, 50)]
    assert [r["tip"] for r in fees.lowest_tips(txs, 9, 0).orderBy("place").collect()] == [0, 0, 1, 7, 30, 50, 50]
    # By ascending reward (a refused one counts 0): 0 0 0 1 2 7 30 50 50, ten gas each.
    assert {r["p"]: r["reward"] for r in fees.reward_percentiles(txs, headers, (0, 33, 34, 50, 70, 78, 100)).collect()} == {0.0: 0, 33.0: 0, 34.0: 0, 50.0: 2, 70.0: 30, 78.0: 30, 100.0: 50}
    assert fees.median_tips(txs).first()["median_tip"] == 4.5  # of 0 0 1 2 7 30 50 50
    tip = fees.suggested_tip(txs, headers.select("number"), 5)
    assert tip.first()["tip"] == 30  # the value at 60 % of 7 30 50
    assert fees.gas_price(tip, table(spark, [(4, 10), (5, 100)], "number long, base_fee long")).first()["gas_price"] == 130


def fake_exponential(factor, numerator, denominator):
    """factor * e^(numerator / denominator) by its series, in whole numbers."""
    out, term, k = 0, factor * denominator, 1
    while term > 0:
        out, term, k = out + term, term * numerator // (denominator * k), k + 1
    return out // denominator


@pytest.mark.parametrize("fee, used, limit, after", [
    (1000, 15, 30, 1000), (1000, 30, 30, 1125), (1000, 0, 30, 875), (7, 16, 30, 8), (0, 30, 30, 1), (10**15, 10_000_000, 30_000_000, 10**15 - 10**15 * 5_000_000 // 15_000_000 // 8),
])
def test_next_base_fee(spark, fee, used, limit, after):
    df = table(spark, [(fee, used, limit)], "f long, u long, l long")
    assert df.select(fees.next_base_fee(F.col("f"), F.col("u"), F.col("l"))).first()[0] == after


def test_blob_fees_and_excess(spark):
    df = table(spark, [(0,), (2_314_057,), (10 * 1024 * 1024,), (40_000_000,)], "e long")
    assert [r[0] for r in df.select(fees.blob_base_fee(F.col("e"))).collect()] == [fake_exponential(1, e, fees.UPDATE_FRACTION) for e in (0, 2_314_057, 10 * 1024 * 1024, 40_000_000)]
    blobs, excess, want = [6, 6, 0, 0, 0, 6, 3, 4, 0], 0, []
    for n in blobs:
        want.append(excess)
        excess = max(0, excess + (n - 3) * fees.GAS_PER_BLOB)
    rows = table(spark, list(enumerate(blobs)), "number long, blobs long")
    assert [r["excess"] for r in fees.excess_blob_gas(rows).orderBy("number").collect()] == want


def test_full_fee_history_and_capacity(spark):
    headers = table(spark, [(1, 10, 90, 100), (2, 11, 10, 100), (3, 12, 0, 100)], "number long, base_fee long, gas_used long, gas_limit long")
    txs = table(spark, [(1, 0, 50, 5, 100, 10), (1, 1, 40, 8, 100, 10), (2, 2, 10, 3, 5, 11)], "number long, tx_num long, gas long, tip long, max_fee long, base_fee long")
    got = {r["number"]: r for r in fees.full_fee_history(headers, txs, 1, 3, (0, 50, 60, 100)).collect()}
    assert [got[n]["rewards"] for n in (1, 2, 3, 4)] == [[5, 5, 8, 8], [0, 0, 0, 0], [0, 0, 0, 0], None]  # the second's cap is below its base fee
    assert got[1]["gas_used_ratio"] == 0.9 and got[4]["gas_used_ratio"] is None and got[4]["base_fee"] == 12 - 12 // 8 and {r["blob_base_fee"] for r in got.values()} == {1}
    tips = {r["number"]: r["tip"] for r in fees.tips_at_capacity(txs, headers, 2).collect()}
    assert tips == {1: 6, 2: 2, 3: 2}  # a median of 6, and a tenth of it; the others had room
    for bad in ((50, 10), (-1,), (101,)):
        with pytest.raises(ValueError):
            fees.full_fee_history(headers, txs, 1, 3, bad)


def test_header_rules(spark):
    rows = [(0, "h0", "x", 1, 5, 10_240, 8), (1, "h1", "h0", 2, 50, 10_249, 7), (2, "h2", "bad", 2, 10_300, 10_239, 7), (4, "h4", "h2", 9, 50, 4_999, 7)]
    faults = listed(chain.header_faults(table(spark, rows, "number long, hash string, parent_hash string, ts long, gas_used long, gas_limit long, base_fee long")))
    assert (2, "parent hash") in faults and (2, "gas used beyond limit") in faults and (2, "timestamp not after the parent's") in faults
    assert (4, "number is not the parent's plus one") in faults and (4, "gas limit moved too far") in faults and (4, "gas limit below the minimum") in faults
    assert (2, "gas limit moved too far") in faults and (1, "gas limit moved too far") not in faults  # 10 of 10,249 is a share of 1024, 9 of 10,240 is not
    assert not any(n in (0, 1) and "hash" in f for n, f in faults)


def test_band_join_finds_the_owner_across_ranges(spark):
    bodies = table(spark, [(0, 0, 5), (1, 5, 0), (2, 5, 9000), (3, 9005, 1)], "number long, first_tx_num long, tx_count long")
    wanted = table(spark, [(0,), (4,), (5,), (4096,), (9004,), (9005,), (9006,)], "tx_num long")
    assert listed(chain.block_of_tx(bodies, wanted).select("tx_num", "number")) == sorted([(0, 0), (4, 0), (5, 2), (4096, 2), (9004, 2), (9005, 3)], key=repr)


def test_append_chain_must_connect(spark):
    schema = "number long, hash string, parent_hash string"
    left, right = table(spark, [(1, "a", "z")], schema), table(spark, [(2, "b", "a")], schema)
    assert chain.append_chain(left, right).count() == 2
    with pytest.raises(ValueError):
        chain.append_chain(right, left)


def test_gaps(spark):
    df = table(spark, [(k,) for k in (0, 1, 5, 8191, 8192, 20000)], "k long")
    assert sorted(map(tuple, chain.gaps(df, "k").collect())) == [(2, 4), (6, 8190), (8193, 19999)]


def test_prune_modes():
    with pytest.raises(ValueError):
        retention.should_prune("distance", 10, 100, 64)
    with pytest.raises(ValueError):
        retention.should_prune("other", 10, 100)


def evict_by_hand(rows, base, max_count, max_bytes):
    """Round by round, worst first, each sender's highest nonce; local ones are spared at first."""
    left, order = {r[0]: r for r in rows}, []
    over = lambda: len(left) > max_count or sum(r[5] for r in left.values()) > max_bytes
    for spare in (True, False):
        while over():
            heads = {}
            for r in left.values():
                if r[1] not in heads or r[2] > heads[r[1]][2]:
                    heads[r[1]] = r
            going = [r for r in sorted(heads.values(), key=lambda r: (min(r[4], r[3] - base) if r[3] >= base else -1, -r[0])) if not (spare and r[6])]
            if not going:
                break
            for r in going:
                if not over():
                    break
                order.append(r[0])
                del left[r[0]]
    return order


@pytest.mark.parametrize("max_count, max_bytes", [(0, 0), (4, 10**6), (21, 300), (9, 10**6), (10**6, 500), (21, 10**6)])
def test_eviction_rounds_equal_a_loop(spark, max_count, max_bytes):
    rows = [(100 * s + n, s, n, 1000 + (7 * s + 3 * n) % 50, 10, 10 + 7 * s % 40, s == 4 or (s == 5 and n == 2)) for s in range(6) for n in range(s + 1)]
    df = table(spark, rows, "submission_id long, sender long, nonce long, max_fee long, max_tip long, size long, is_local boolean")
    assert sorted(r["submission_id"] for r in pool.evicted(df, 1000, max_count, max_bytes).collect()) == sorted(evict_by_hand(rows, 1000, max_count, max_bytes))


def test_truncation_takes_whole_senders_least_recent_first(spark):
    senders = {"a": 4, "b": 3, "c": 3, "d": 1}
    rows, at = [], 0
    for s, n in senders.items():
        for k in range(n):
            rows.append((at, ord(s), k, 10))
            at += 1
    df = table(spark, rows, "submission_id long, sender long, nonce long, size long")
    gone = {r["submission_id"] for r in pool.truncated(df, 4, 10**6).collect()}
    assert gone == {r[0] for r in rows if chr(r[1]) in "ab"}  # c and d are left
    assert {r["submission_id"] for r in pool.truncated(df, 9, 10**6).collect()} == {3, 2}  # a's highest nonces
    assert pool.truncated(df, 11, 110).count() == 0 and pool.truncated(df, 11, 75).count() == 4


@pytest.mark.parametrize("base, fee, expected", [(7, 10, 2), (17_200_000_000, 17_200_000_000, 0), (9_853_941_692, 11_085_092_510, 0), (11_544_106_391, 10_356_781_100, 0), (17_200_000_000, 7, -7), (7, 17_200_000_000, 7), (100, 80, 0), (100, 63, -2), (0, 0, 0)])
def test_fee_distance(spark, base, fee, expected):
    assert table(spark, [(fee, base)], "fee long, base long").select(pool.fee_delta(F.col("fee"), F.col("base"))).first()[0] == expected


def test_blob_order_goes_by_the_worse_distance(spark):
    rows = [(1, 80, 630), (2, 80, 800), (3, 63, 800), (4, 63, 630)]
    df = table(spark, rows, "submission_id long, blob_fee long, max_fee long").withColumn("p", pool.blob_priority(1000, 100))
    assert [r["p"] for r in df.orderBy("submission_id").collect()] == [0, 0, -2, -2]


def test_promotion_stops_at_the_first_that_cannot_pay(spark):
    df = table(spark, [(1, 0, 100), (1, 1, 40), (1, 2, 100), (2, 0, 40), (2, 1, 100), (3, 5, 50)], "sender long, nonce long, max_fee long")
    assert listed(pool.promoted(df, 50).select("sender", "nonce")) == [(1, 0), (3, 5)]
    assert pool.promoted(df, 40).count() == 6 and pool.promoted(df, 101).count() == 0


def test_states_and_subpools(spark):
    rows = [
        (1, 0, 100, 10, 50, False, 0), (1, 1, 10, 10, 50, False, 0), (1, 2, 100, 10, 50, False, 0),  # pays, waits for the fee, waits for it too
        (2, 0, 100, 10, 50, True, 9), (3, 0, 100, 10, 50, True, 1), (4, 1, 100, 10, 50, False, 0), (5, 0, 100, 999, 50, False, 0), (6, 0, 100, 10, 500, False, 0),
    ]
    df = table(spark, rows, "sender long, nonce long, max_fee long, cost long, gas long, is_blob boolean, blob_fee long")
    balances = table(spark, [(s, 100, 0) for s in range(1, 7)], "sender long, balance long, next_nonce long")
    got = {(r["sender"], r["nonce"]): (r["state"], r["subpool"]) for r in pool.with_state(df, balances, 50, 100, 5).collect()}
    assert got == {
        (1, 0): (252, "pending"), (1, 1): (244, "basefee"), (1, 2): (124, "queued"), (2, 0): (254, "pending"), (3, 0): (250, "blob"), (4, 1): (188, "queued"), (5, 0): (220, "queued"), (6, 0): (236, "queued"),
    }


def test_best_order_equals_a_loop(spark):
    rows = [(10 * s + n, s, n, 1000 + (13 * s + 29 * n) % 90, 60) for s in range(6) for n in range(4)]
    df = table(spark, rows, "submission_id long, sender long, nonce long, max_fee long, max_tip long")
    heads, order = {s: 0 for s in range(6)}, []
    by = {(r[1], r[2]): r for r in rows}
    while heads:
        s = max(heads, key=lambda s: (min(60, by[s, heads[s]][3] - 1000), -by[s, heads[s]][0]))
        order.append(by[s, heads[s]][0])
        heads[s] += 1
        if heads[s] == 4:
            del heads[s]
    assert [r["submission_id"] for r in pool.best(df, 1000, 24).collect()] == order


def test_diff_and_checksum(spark):
    a = table(spark, [(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = table(spark, [(2, None), (3, "y"), (4, "w")], "k long, v string")
    assert listed(tools.diff(a, b, ["k"], ["v"])) == [(1, "only left"), (3, "changed"), (4, "only right")]
    assert tools.checksum(a).first() == tools.checksum(a.orderBy(F.desc("k"))).first()
    assert tools.checksum(a).first()["checksum"] != tools.checksum(b).first()["checksum"]
    assert tools.checksum(a.limit(0)).first()["rows"] == 0


def test_content_digests_depends_on_contents_only(spark):
    leaves = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.md5(F.col("id").cast("string")).alias("hash"))
    root = lambda df: tools.content_digests(df, 2).where("level = 0").first()["hash"]
    assert root(leaves) == root(leaves.repartition(7))
    assert root(leaves) != root(leaves.where("hash <> md5('7')"))


def test_tree_depth_follows_the_leaves():
    assert [tools.tree_depth(n) for n in (0, 16_000, 16_001, 10**9)] == [1, 1, 2, 5]


def test_shard_lookup_equals_a_search(spark):
    changes = table(spark, [(a, b) for a, blocks in (("x", (1, 4, 9, 10, 30)), ("y", (7,))) for b in blocks], "address string, block long")
    wanted = table(spark, [(a, b) for a in "xy" for b in (0, 1, 2, 7, 8, 10, 11, 31)], "address string, block long")
    got = {(r["address"], r["block"]): r["next_block"] for r in history.shard_lookup(history.index_shards(changes, ["address"], 2), wanted, ["address"]).collect()}
    held = {"x": (1, 4, 9, 10, 30), "y": (7,)}
    assert got == {(a, b): min((c for c in held[a] if c >= b), default=None) for a in "xy" for b in (0, 1, 2, 7, 8, 10, 11, 31)}


def test_segments_prune_folders(spark, tmp_path):
    df = spark.range(5000).withColumnRenamed("id", "number").withColumn("v", F.col("number") * 2)
    stages.write_segments(df, f"file://{tmp_path}/seg", 1000)
    got = stages.read_segments(spark, f"file://{tmp_path}/seg", 1500, 2500, 1000)
    assert got.agg(F.count(F.lit(1)), F.sum("v")).first()[:] == (1001, sum(2 * k for k in range(1500, 2501)))
    assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().toString()


def test_keccak_and_ordered_keys(spark):
    assert encodings.keccak256_rows([b"", b"abc", b"x" * 136])[1].hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    df = table(spark, [("",), (None,), ("abc",)], "s string").select(encodings.keccak256_hex("s").alias("h"))
    assert [r["h"] for r in df.collect()][1] is None
    keys = spark.range(0, 100_000, 777).select("id", encodings.be_key(F.col("id")).alias("k"))
    assert [r["id"] for r in keys.orderBy("k").collect()] == list(range(0, 100_000, 777))


def test_archive_entries():
    data = archive.entry(archive.VERSION, b"") + archive.entry(3, b"abc")
    assert [(k, v) for _, k, v in archive.entries(data)] == [(archive.VERSION, b""), (3, b"abc")]
    with pytest.raises(ValueError):
        list(archive.entries(data[:-1]))


def test_md5_chain_is_what_the_views_say(spark):
    assert spark.range(1).select(F.md5(F.lit("block-5")).alias("h")).first()["h"] == hashlib.md5(b"block-5").hexdigest()


@pytest.mark.parametrize("split", [111, 1 << 20])
def test_archives_don_t_depend_on_the_size_of_parts(spark, tmp_path, split):
    """Entries of many lengths in two files with an index and one without: each is read once, whatever the cuts are."""
    spark.dataSource.register(archive.ArchiveSource)
    rows = [("", 0, archive.HEADER, bytes([k % 251]) * (k * 13 % 90)) for k in range(40)]
    path = f"file://{tmp_path}/a"
    spark.createDataFrame(rows, archive.SCHEMA).repartition(2).write.format("archive").mode("append").save(path)
    (tmp_path / "a" / "old.tlv").write_bytes(archive.entry(archive.VERSION, b"") + archive.entry(archive.BODY, b"x" * 300))
    got = spark.read.format("archive").option("split", split).load(path)
    assert sorted(bytes(r["value"]) for r in got.where(F.col("kind") == archive.HEADER).collect()) == sorted(r[3] for r in rows)
    assert got.where(F.col("kind") == archive.BODY).count() == 1 and got.where(F.col("kind") == archive.VERSION).count() == 3 and got.where(F.col("kind") == archive.INDEX).isEmpty()
    assert got.select("file", "position").distinct().count() == got.count() == 44
    assert split > 200 or got.rdd.getNumPartitions() > 20
