"""Streams over many files that are not in time order."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

from blockloom.plans.registry import ORACLES, QUERIES
from blockloom.streaming import changes

from .compare import connect, rows, sql_rows
from .conftest import SF

FILES = 250


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    """The events in 250 files, the last events in the oldest file."""
    top = tmp_path_factory.mktemp("many")
    folder = top / "events.parquet"
    folder.mkdir()
    events = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    step = -(-len(events) // FILES)
    for k, at in enumerate(range(0, len(events), step)):
        pq.write_table(events.slice(at, step), path := folder / f"part-{k:03}.parquet")
        os.utime(path, (1_700_000_000 - k, 1_700_000_000 - k))
    assert len(list(folder.iterdir())) > 200  # three batches of 100
    return str(top)


@pytest.mark.parametrize("name", ["stream_windows", "stream_balances"])
def test_more_files_than_a_batch_once_took(spark, many_files, name):
    assert rows(QUERIES[name](spark, many_files)) == sql_rows(connect(SF), ORACLES[name])[1]


def test_windows_count_at_the_nearest_second(spark, tmp_path):
    """Halves go to the even second, and a window closes with the whole second that its SQL asks for."""
    times = ["05:59:59.499999", "05:59:59.5", "05:59:59.7", "06:00:00", "06:00:00.5", "11:59:59.4", "11:59:59.6", "12:00:00"]
    for k, last in enumerate(["12:59:59.999", "13:00:00", "18:59:59.6", "19:00:00.0009"]):
        folder = tmp_path / str(k)
        folder.mkdir()
        rows_ = ", ".join(f"({n}, TIMESTAMP '2024-01-01 {t}', 'click')" for n, t in enumerate([*times, last]))
        con = duckdb.connect()
        con.execute(f"COPY (SELECT n::BIGINT AS event_id, ts, k AS event_type FROM (VALUES {rows_}) v(n, ts, k)) TO '{folder}/events.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        assert rows(QUERIES["stream_windows"](spark, str(folder))) == sql_rows(con, ORACLES["stream_windows"])[1]


def test_balances_do_not_depend_on_batches(spark, many_files):
    stream = changes.event_stream(spark, many_files, files_per_trigger=100).select("event_id", "user_id", "value")
    assert rows(changes.balance_changes(changes.run_once(stream))) == sql_rows(connect(SF), ORACLES["stream_balances"])[1]


def noted(events):
    return changes.notifications(events).select("event_id", "block", "seq", "op", "removed")


def test_a_feed_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over growing input, with blocks taken back and committed again in between, equal one batch."""
    folder, path = tmp_path / "events", f"file://{tmp_path}/feed"
    folder.mkdir()
    events = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = lambda: noted(spark.readStream.schema(schema).parquet(f"file://{folder}"))
    pq.write_table(events.slice(0, 600), folder / "a.parquet")
    first = changes.run_once(stream(), path).count()
    pq.write_table(events.slice(600, 150), folder / "b.parquet")
    pq.write_table(events.slice(750), folder / "c.parquet")
    changes.run_once(stream(), path)  # the checkpoint names what has been read
    whole = noted(spark.read.parquet(f"{SF}/events.parquet"))
    grown = spark.read.parquet(f"{path}/table")
    assert 0 < first < grown.count() and rows(grown) == rows(whole)
    assert rows(changes.run_once(stream(), path)) == rows(whole)  # a run without news adds nothing
    assert rows(changes.standing(grown).select("event_id")) == rows(spark.read.parquet(f"{SF}/events.parquet").select("event_id"))


def test_resumed_feeds_bring_any_branch_to_the_chain(spark):
    ours = spark.createDataFrame([(n, f"h{n}") for n in range(10)], "number long, hash string")
    for theirs in ([], [(0, "h0")], [(n, f"h{n}") for n in range(10)], [(0, "h0"), (1, "h1"), (2, "x2"), (3, "x3")], [(n, f"x{n}") for n in range(12)]):
        steps = sorted(changes.resumed(ours, spark.createDataFrame(theirs, "number long, hash string")).collect(), key=lambda r: r["seq"])
        assert [r["seq"] for r in steps] == list(range(len(steps)))
        chain = list(theirs)
        for r in steps:
            if r["op"] == "revert":
                assert chain.pop() == (r["number"], r["hash"])
            else:
                assert r["number"] == len(chain)
                chain.append((r["number"], r["hash"]))
        assert chain == [(n, f"h{n}") for n in range(10)]


def test_inverted_and_kept_notifications(spark):
    notes = noted(spark.read.parquet(f"{SF}/events.parquet"))
    back = changes.inverted(notes)
    assert rows(changes.inverted(back)) == rows(notes) and back.where("op = 'commit' AND NOT removed").count() == notes.where("op = 'revert'").count()
    height = notes.agg({"block": "max"}).first()[0] - 3
    assert {r["block"] for r in changes.kept_for(notes, height).select("block").collect()} <= {height + 1, height + 2, height + 3}
