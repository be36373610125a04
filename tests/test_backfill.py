"""Batches of a backfill, and its source over several runs."""

import random

import pytest

from blockloom.functions import ranks
from blockloom.operators import stages
from blockloom.sources import backfill
from blockloom.streaming import changes


def by_hand(rows, first, max_blocks, limits):
    out, begin, sums = [], None, None
    for number, *amounts in rows:
        if number < first:
            continue
        if begin is None:
            begin, sums = number, [0] * len(amounts)
        sums = [a + b for a, b in zip(sums, amounts)]
        if number - begin + 1 >= max_blocks or any(s >= m for s, m in zip(sums, limits)) or number == rows[-1][0]:
            out.append((begin, number))
            begin = None
    return out


@pytest.mark.parametrize("max_blocks, gas, txs", [(1, 10**9, 10**9), (7, 10**9, 10**9), (50, 40, 10**9), (50, 60, 9), (10**6, 10**9, 10**9), (5, 1, 1)])
def test_batches(spark, max_blocks, gas, txs):
    rng = random.Random(max_blocks)
    rows = [(n, rng.choice([0, 0, 5, 11, 90]), rng.randrange(4)) for n in range(3, 300)]
    df = spark.createDataFrame(rows, "number long, gas long, txs long")
    got = sorted((r["first"], r["last"]) for r in stages.batches(df, 10, max_blocks, {"gas": gas, "txs": txs}).collect())
    assert got == by_hand(rows, 10, max_blocks, (gas, txs))


def test_offsets_survive_a_restart(spark, tmp_path):
    """A run up to block 123, one with other thresholds up to 200, and one without news equal one batch over all."""
    path = f"file://{tmp_path}/feed"
    rows = [(n, n % 5) for n in range(201)]
    for last, most in ((123, 10), (200, 17), (200, 17)):
        cuts = stages.batches(spark.createDataFrame([r for r in rows if r[0] <= last], "number long, gas long"), 4, most, {"gas": 30})
        got = changes.run_once(backfill.stream(spark, cuts), path)
    assert sorted(r["number"] for r in got.collect()) == list(range(4, 201))
    once = changes.run_once(backfill.stream(spark, stages.batches(spark.createDataFrame(rows, "number long, gas long"), 4, 10, {"gas": 30})))
    assert sorted(r["number"] for r in once.collect()) == list(range(4, 201))


def test_more_cuts_than_a_source_takes(spark, monkeypatch):
    monkeypatch.setattr(backfill, "MOST", 3)
    with pytest.raises(ValueError, match="end the range at block 29"):
        backfill.stream(spark, spark.createDataFrame([(k, k + 9) for k in range(0, 40, 10)], "first long, last long"))


def test_a_longer_range_is_read_by_runs(spark, tmp_path):
    """Runs of two cuts give the blocks of all five; there are never more partitions than a run may have."""
    cuts = spark.createDataFrame([(k, k + 9) for k in range(0, 50, 10)], "first long, last long")
    for feed in backfill.in_runs(spark, cuts, 2):
        got = changes.run_once(feed, f"file://{tmp_path}/feed")
    assert sorted((r["batch"], r["number"]) for r in got.collect()) == [(n // 10 * 10, n) for n in range(50)]
    parts = backfill.BackfillReader([[k, k] for k in range(5000)]).partitions({"number": 7}, {"number": 4999})
    assert len(parts) <= backfill.PARTITIONS and [b for p in parts for b in p.batches] == [(k, k, k) for k in range(7, 4999)]


def test_no_frame_runs_to_the_end_of_its_group(spark):
    """Frames that end with their group are worked out anew for each row: quadratic in the rows of a range."""
    df = spark.createDataFrame([(1, 1, None), (1, 4, 40), (1, 9, 90), (2, 3, 30)], "g long, k long, v long")
    found = ranks.next_within(df, ["g"], "k", "v", "later", 4)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString()
    assert sorted((r["g"], r["k"], r["later"]) for r in found.collect()) == [(1, 1, 40), (1, 4, 90), (1, 9, None), (2, 3, None)]
