"""Queries that list rows of a table list all of them."""

import pytest

from blockloom.plans.registry import QUERIES
from blockloom.plans.views import Ledger

from .conftest import SF

WHOLE = {
    "block_assembled": "headers", "block_of_transaction": "transactions", "segment_split_and_append": "headers",
    "storage_values_batch": "accounts", "pool_replacements": "pool", "hot_and_cold": "headers",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_one_row_for_each_of_the_table(spark, name):
    assert QUERIES[name](spark, SF).count() == getattr(Ledger(spark, SF), WHOLE[name]).count()


def test_rewards_of_all_blocks_and_prefixes_of_all_senders(spark):
    x = Ledger(spark, SF)
    assert QUERIES["trace_blocks_with_rewards"](spark, SF).count() == x.traces.count() + x.headers.count()
    got = QUERIES["pool_within_bytes"](spark, SF).join(x.pool.select("submission_id", "sender"), "submission_id")
    # A sender has a row exactly if its first transaction fits.
    first = x.pool.groupBy("sender").agg({"submission_id": "min"}).withColumnRenamed("min(submission_id)", "submission_id").join(x.pool, ["sender", "submission_id"]).where("size <= 2000")
    assert got.select("sender").distinct().count() == first.count()
