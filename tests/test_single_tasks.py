"""Listing and eviction without a task that gets all rows."""

from pyspark.sql import functions as F

from blockloom.operators import pool, tools
from blockloom.plans import views

from .conftest import SF


def test_listing_skips_without_a_global_limit(spark):
    df = spark.range(20_000).withColumnRenamed("id", "number")
    got = tools.listing(df, "number", 40, None, F.col("number") % 2 == 0, reverse=True)
    assert "GlobalLimit" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["number"] for r in got.collect()] == list(range(19_958, -1, -2))


def test_no_window_over_all_rows_of_a_pool(spark):
    """A sender with all transactions: rounds, priorities and ages are cut by totals."""
    rows = spark.range(9_000).select(F.col("id").alias("submission_id"), F.lit(1).alias("sender"), F.col("id").alias("nonce"), F.lit(10).alias("max_fee"), F.lit(1).alias("max_tip"), F.lit(7).alias("size"), F.lit(False).alias("is_local"))
    got = pool.evicted(rows, 5, 3_000, 10**9)
    assert got.count() == 6_000 and got.agg(F.min("submission_id")).first()[0] == 3_000 and got.agg(F.max("round")).first()[0] == 6_000


def test_ranges_of_blocks_open_their_folders_only(spark, monkeypatch):
    monkeypatch.setattr(views, "SEGMENT", 256)
    monkeypatch.setattr(views, "_stored", {})
    x = views.Ledger(spark, SF)
    for df, scans in ((x.headers_between(300, 700), 1), (x.enriched_between(300, 700), 1), (x.transactions_between(300, 700), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == scans and "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(number)" in plan and "Exchange" not in plan
        assert len({f.rsplit("/", 2)[1] for f in df.inputFiles()}) <= 6 and df.where("number < 300 OR number > 700").isEmpty()
    whole = x.headers.count()
    assert whole == spark.read.parquet(f"{SF}/orders.parquet").count() and x.headers_between(None, 99).count() == 100 == x.headers_between(whole - 100, None).count()
    assert views.Ledger(spark, SF).headers.inputFiles() == x.headers.inputFiles() and len(views._stored) == 2  # built once


def test_views_of_empty_and_of_changed_tables(spark, tmp_path):
    """Tables without rows give views without rows; other files of the same name are another state."""
    for name in ("orders", "lineitem", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    x = views.Ledger(spark, f"file://{tmp_path}")
    assert x.headers.isEmpty() and x.transactions.isEmpty() and x.logs.isEmpty() and x.account_changes.isEmpty() and x.of_hashes(["00"], "tx").isEmpty()
    spark.read.parquet(f"{SF}/orders.parquet").limit(7).write.mode("append").parquet(f"file://{tmp_path}/orders.parquet")
    assert views.Ledger(spark, f"file://{tmp_path}").headers.count() == 7
