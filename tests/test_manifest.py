"""Segments with a manifest: second sessions, damage, deletion below, truncation above."""

import os

import pytest
from pyspark.sql import functions as F

from blockloom.plans import views
from blockloom.sources import manifest
from blockloom.sources.manifest import Segments

from .conftest import SF


@pytest.fixture
def held(spark, tmp_path):
    segments = Segments(spark, f"file://{tmp_path}/table")
    segments.build(spark.range(1000).select(F.col("id").alias("number"), F.md5(F.col("id").cast("string")).alias("hash")), 100, "number")
    return segments


def numbers(segments):
    return sorted(r["number"] for r in segments.read().collect())


def part(segments, bucket):
    (generation,) = {s["generation"] for b, s in segments.manifest()["segments"].items() if b == str(bucket)}
    folder = f"{segments.path.removeprefix('file://')}/gen={generation}/bucket={bucket}"
    return [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")][0]


def test_built_once_and_read_by_folders(spark, held):
    again = Segments(spark, held.path)
    assert again.stored() and again.size == 100 and numbers(again) == list(range(1000)) and again.faults() == ([], 999)
    assert {(s["first"], s["last"], s["rows"]) for s in again.manifest()["segments"].values()} == {(k, k + 99, 100) for k in range(0, 1000, 100)}
    plan = again.read().where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_damaged_and_missing_segments_are_found(held):
    with open(part(held, 6), "ab") as f:
        f.write(b"x")
    found, good = held.faults()
    assert good == 599 and len(found) == 1 and "bucket 6" in found[0] and "another length" in found[0]
    os.remove(part(held, 2))
    found, good = held.faults()
    assert good == 199 and len(found) == 2 and "is missing" in found[0]
    held.truncate_above(good)  # back to what is whole
    assert held.faults() == ([], 199) and numbers(held) == list(range(200))


def test_deletion_below_leaves_the_highest(held):
    assert held.delete_below(0) == [] and held.delete_below(250) == [0, 1] and numbers(held) == list(range(200, 1000))
    assert held.delete_below(10**9) == [2, 3, 4, 5, 6, 7, 8] and numbers(held) == list(range(900, 1000)) and held.faults() == ([], 999)


def test_truncation_writes_one_segment_again(held):
    before = held.manifest()["segments"]
    kept = {b: open(part(held, b), "rb").read() for b in range(5)}
    assert held.truncate_above(550) == [5, 6, 7, 8, 9] and numbers(held) == list(range(551)) and held.faults() == ([], 550)
    after = held.manifest()["segments"]
    assert {b for b in after if after[b] != before[b]} == {"5"} and all(open(part(held, b), "rb").read() == kept[b] for b in range(5))
    assert held.truncate_above(550) == [] and held.truncate_above(499) == [5] and numbers(held) == list(range(500))
    assert held.truncate_above(-1) == [0, 1, 2, 3, 4] and held.read().isEmpty()


@pytest.mark.parametrize("limit", [7, 64])
def test_many_small_deletions_equal_a_large_one(spark, tmp_path, limit):
    rows = [(b, i) for b in range(60) for i in range(b % 7)]
    build = lambda name: Segments(spark, f"file://{tmp_path}/{name}")
    table = spark.createDataFrame(rows, "number long, idx long")
    small, large = build("small"), build("large")
    for held in (small, large):
        held.build(table, 10, "number")
    want = [r for r in rows if r[0] > 43]
    assert large.prune(43, 10**6, "idx") == {"deleted": len(rows) - len(want), "done": True, "checkpoint": [43, 0]}
    deleted, done, runs = 0, False, 0
    while not done:
        before = small.manifest()["segments"]
        got = small.prune(43, limit, "idx")
        deleted, done, runs = deleted + got["deleted"], got["done"], runs + 1
        left = sorted(map(tuple, small.read().drop("bucket").collect()))
        assert left == rows[deleted:] and got["deleted"] <= limit and (done or got["deleted"] == limit) and tuple(got["checkpoint"]) == rows[deleted - 1]
        after = small.manifest()["segments"]
        assert sum(after[b] != before[b] for b in after) <= 1 and small.faults()[0] == []  # one folder is written again
        if limit == 7 and runs == 4:
            break
    if limit != 7:
        assert left == want == sorted(map(tuple, large.read().drop("bucket").collect())) and small.prune(43, limit, "idx")["deleted"] == 0


def test_a_kill_before_the_manifest_changes_nothing(held, monkeypatch):
    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(held.files, "replace", killed)
    with pytest.raises(RuntimeError):
        held.truncate_above(550)
    assert numbers(Segments(held.spark, held.path)) == list(range(1000))


def test_a_second_session_builds_nothing(spark, monkeypatch):
    first = views.Ledger(spark, SF)
    want = [df.count() for df in (first.headers, first.transactions, first.logs, first.block_blooms, first.of_hashes(["00"], "tx"))]

    def refused(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(views, "_stored", {})
    monkeypatch.setattr(manifest, "write_segments", refused)
    again = views.Ledger(spark, SF)
    assert [df.count() for df in (again.headers, again.transactions, again.logs, again.block_blooms, again.of_hashes(["00"], "tx"))] == want and len(views._stored) == 5
