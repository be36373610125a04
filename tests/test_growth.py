"""What large tables need: nothing is built, sorted, shuffled or called more often than a query's rows ask for."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from blockloom.operators import fees, history, traces
from blockloom.plans import views
from blockloom.plans.registry import QUERIES
from blockloom.streaming import changes, lifecycle

from . import test_lifecycle
from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_looked_up_without_transactions(spark, monkeypatch):
    monkeypatch.setattr(views, "_stored", {})
    x = views.Ledger(spark, SF)
    asked = hashlib.md5(b"block-77").hexdigest()
    assert [(r["hash"], r["number"]) for r in x.of_hashes([asked, "00"], "block").collect()] == [(asked, 77)]
    assert {name for _, name, _ in views._stored} == {"blocks", "hashes-block"}
    assert {len(r["key"]) for r in x.hash_index("block").select("key").collect()} == {16}


def test_blocks_are_put_together_without_a_sort_of_lines(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(views, "written", lambda df, write=views.written: plans.append(plan(df)) or write(df))
    monkeypatch.setattr(views.Segments, "stored", lambda self: False)
    monkeypatch.setattr(views, "_stored", {})
    assert views.Ledger(spark, SF).headers.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]


def test_rewards_are_stored_as_steps(spark):
    txs = spark.range(3000).select(F.col("id").alias("tx_num"), F.floor(F.col("id") / 9).alias("number"), (F.col("id") % 7 * 30).alias("gas"), (F.col("id") % 5).alias("tip"), F.lit(9).cast("long").alias("max_fee"), F.lit(6).cast("long").alias("base_fee"))
    headers, at = spark.range(335).withColumnRenamed("id", "number"), (-1, 0, 12.6, 37.38, 50, 99.9, 150)
    steps = fees.reward_steps(txs)
    assert steps.agg(F.max(F.size("steps"))).first()[0] <= 9
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(fees.rewards_from_steps(headers, steps, at)) == rows(fees.rewards_from_grid(headers, fees.reward_grid(txs), at))


def test_bodies_are_shuffled_without_their_hashes(spark):
    made = plan(QUERIES["bodies_within_bytes"](spark, SF))
    assert made.count("md5(") == 1 and made.index("md5(") < made.index("Window") < made.index("Exchange")


def test_receipts_find_their_contracts_in_place(spark):
    made = plan(QUERIES["receipts_with_contract"](spark, SF))
    assert "Exchange" not in made and "Join" not in made and "Generate" not in made
    txs = spark.range(40).select(F.col("id").alias("tx_num"), F.col("id").alias("number"), F.col("id").alias("idx"), F.col("id").alias("sender"), F.col("id").alias("recipient"), F.col("id").alias("tip"), F.col("id").alias("gas"))
    created = {r["tx_num"]: r["to_"] for r in traces.of_transactions(txs).where("kind = 'create'").collect()}
    assert {r["tx_num"]: r["contract"] for r in traces.with_contract(txs).collect()} == {n: created.get(n) for n in range(40)} and sorted(created) == [0, 17, 34]


def test_first_changes_and_creations_are_found_without_a_sort(spark):
    made = spark.range(10).select("id", F.lit(1).cast("long").alias("address"), F.col("id").alias("block"), F.lit(None).cast("double").alias("before"), F.lit(2.0).alias("value"))
    calls = traces.of_transactions(made.select(F.col("id").alias("tx_num"), F.col("id").alias("number"), F.col("id").alias("idx"), F.col("id").alias("sender"), F.col("id").alias("recipient"), F.col("id").alias("tip"), F.col("id").alias("gas")))
    for df in (history.as_of(made, made.select("address", "value").limit(1), 3), traces.creators(calls)):
        assert "SortAggregate" not in plan(df)
    assert history.as_of(made, made.select("address", "value").limit(1), 3).collect() == [(1, None)]


def test_a_folder_is_read_in_few_batches(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(0, 90, 1, 9).write.parquet(source)
    got = changes.run_once(changes.in_batches(spark, source, "id long", 2), path)
    assert got.count() == 90 and len([f for f in os.listdir(f"{tmp_path}/out/checkpoint/commits") if f.isdigit()]) == 2


@pytest.mark.parametrize("groups", [2])
def test_many_senders_share_a_call(spark, tmp_path, monkeypatch, groups):
    monkeypatch.setattr(lifecycle, "GROUPS", groups)
    test_lifecycle.test_a_stream_in_several_runs(spark, tmp_path)
