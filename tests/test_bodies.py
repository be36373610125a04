"""Withdrawals, blobs, answers to requests, rewards from a grid, and framed archives, against plain rules and fixed vectors."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import bodies, fees
from blockloom.sources import archive, framing

PAID = "array<struct<index: long, validator: long, address: long, amount: long>>"


def root(paid):
    return hashlib.sha256(",".join(":".join(map(str, w)) for w in paid).encode()).hexdigest()


def test_withdrawal_faults(spark):
    one, two = [(0, 1, 7, 50)], [(1, 2, 7, 60), (2, 3, 8, 70)]
    rows = [(1, one, root(one)), (2, two, root(two)), (3, [], root([])), (4, None, root(one)), (5, one, None), (6, None, None), (7, two, root(two[::-1])), (8, [], root(one))]
    df = spark.createDataFrame(rows, f"number long, withdrawals {PAID}, withdrawals_root string")
    got = {r["number"]: r["fault"] for r in bodies.withdrawal_faults(df).collect()}
    assert got == {4: "withdrawals missing", 5: "withdrawals root missing", 6: "withdrawals missing", 7: "withdrawals root", 8: "withdrawals root"}
    assert {r["address"]: (r["n"], r["amount"]) for r in bodies.withdrawn(df).collect()} == {7: (4, 50 + 60 + 50 + 60), 8: (2, 140)}
    assert bodies.withdrawal_faults(df.limit(0)).count() == 0


def test_blob_faults(spark):
    g = fees.GAS_PER_BLOB
    rows = [
        (0, 6, 6 * g, 5 * g),  # no parent: any excess
        (1, 3, 3 * g, 8 * g), (2, 0, 0, 8 * g), (3, 0, 0, 5 * g), (4, 1, g, 2 * g), (5, 0, 0, 0),  # up by three, even, down, down to zero
        (6, 2, None, 0), (7, 0, 0, None), (8, 0, 0, 0),  # what is missing counts as zero for the next one
        (9, 7, 7 * g, 0), (10, 1, g + 1, 4 * g), (11, 1, g, g), (8191, 4, 4 * g, g), (8192, 4, 4 * g, 2 * g), (8193, 1, g, 2 * g),
    ]
    df = spark.createDataFrame(rows, "number long, blobs long, blob_gas_used long, excess_blob_gas long")
    got = sorted((r["number"], r["fault"]) for r in bodies.blob_faults(df).collect())
    assert got == [
        (6, "blob gas missing"), (7, "excess blob gas missing"), (9, "blob gas beyond limit"),
        (10, "blob gas is not that of the body"), (10, "blob gas is not whole blobs"), (11, "excess blob gas"), (8193, "excess blob gas"),
    ]


def test_answers_keep_order_and_misses_and_stop_after_the_budget(spark):
    requests = spark.createDataFrame(list(enumerate(["b", "x", "a", "b", "y", "c", "a"])), "place long, hash string")
    found = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "hash string, size long")
    answer = lambda **limits: [(r["place"], r["size"]) for r in bodies.answered(requests, found, "hash", **limits).orderBy("place").collect()]
    whole = [(0, 20), (1, None), (2, 10), (3, 20), (4, None), (5, 30), (6, 10)]
    assert answer() == whole
    assert answer(budget=49) == whole[:4]  # the body that exceeds the budget is the last
    assert answer(budget=50) == whole[:6] and answer(budget=0) == whole[:1]
    assert answer(most=3) == whole[:3]


def test_the_grid_holds_what_each_percentile_gives(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for number in range(40):
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((n, number, rng.choice([0, 1, 21, 400, 9973]) if number else 0, rng.randrange(6), rng.randrange(9), 3))
            n += 1
    txs = spark.createDataFrame(rows, "tx_num long, number long, gas long, tip long, max_fee long, base_fee long")
    headers = spark.range(41).select(F.col("id").alias("number"))  # the last one has no transactions
    grid = fees.reward_grid(txs).cache()
    assert {len(r["grid"]) for r in grid.collect()} == {401}
    at = [k / 4 for k in range(401)]
    want = {r["number"]: r["rewards"] for r in fees.rewards_of_blocks(txs, at).collect()}
    assert {r["number"]: r["grid"] for r in grid.collect()} == want
    near = {(r["number"], r["p"]): r["reward"] for r in fees.rewards_from_grid(headers, grid, (-1, 0.125, 12.6, 99.9, 150)).collect()}
    assert len(near) == 41 * 5
    for number, rewards in want.items():
        assert [near[number, p] for p in (-1, 0.125, 12.6, 99.9, 150)] == [rewards[k] for k in (0, 1, 50, 400, 400)]
    assert near[40, 12.6] == 0


def test_checksums():
    # Published checksums.
    assert framing.crc32c(b"123456789") == 0xE3069283
    assert framing.crc32c(bytes(32)) == 0x8A9136AA and framing.crc32c(b"\xff" * 32) == 0x62A8AB43
    assert framing.crc32c(b"") == 0

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(1)
    for n in (1, 255, 256, 257, 4095, 4096, 4097, 9000):
        data = rng.randbytes(n)
        assert framing.crc32c(data) == plain(data), n


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 50_000, random.Random(2).randbytes(150_000), bytes(65536), bytes(65537)])
def test_frames(data):
    assert framing.unframed(framing.framed(data)) == data


def test_chunks_of_other_kinds_and_damage():
    whole = framing.framed(b"hello " * 100)
    padded = whole + b"\xfe\x02\x00\x00zz" + whole  # padding, then another stream
    assert framing.unframed(padded) == b"hello " * 200
    with pytest.raises(ValueError, match="unknown type"):
        framing.unframed(whole + b"\x02\x00\x00\x00")
    with pytest.raises(ValueError, match="no snappy stream"):
        framing.unframed(whole[10:])
    with pytest.raises(ValueError, match="cut off"):
        framing.unframed(whole[:-1])
    with pytest.raises(ValueError, match="damaged"):
        framing.unframed(whole[:14] + bytes([whole[14] ^ 1]) + whole[15:])


def test_framed_archives_do_not_depend_on_the_split(spark, tmp_path):
    path = "file://" + str(tmp_path / "framed")
    headers = spark.range(3000).select(F.col("id").alias("number"), F.md5(F.col("id").cast("string")).alias("hash"))
    archive.export_headers(headers, path, 1000, framing="snappy")
    want = sorted(map(tuple, headers.collect()))
    for split in (700, 1 << 20):
        rows = spark.read.format("archive").option("framing", "snappy").option("split", split).load(path).where(F.col("kind") == archive.HEADER)
        got = rows.select(F.from_json(F.decode("value", "UTF-8"), "number long, hash string").alias("h")).select("h.*")
        assert sorted(map(tuple, got.collect())) == want
    raw = spark.read.format("archive").load(path).where(F.col("kind") == archive.HEADER).first()
    assert bytes(raw["value"]).startswith(framing.IDENTIFIER)
    with pytest.raises(Exception, match="unknown framing"):
        spark.read.format("archive").option("framing", "zip").load(path).count()
