"""Change log and reassembly: repeated and killed batches, restarts, truncation, order of arrival."""

import random

import pytest
from blockloom.sources.files import Folder
from blockloom.streaming import assembly, changes
from blockloom.streaming.changelog import ChangeLog

SCHEMA = "number long, hash string, parent_hash string, op string, seq long"


def blocks(spark, first, last, op="commit", seq=0, name="a"):
    return spark.createDataFrame([(n, f"{name}{n}", f"{name}{n - 1}", op, seq) for n in range(first, last + 1)], SCHEMA)


def test_files_are_replaced_whole(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/x")
    assert folder.read("a.json") is None and folder.names() == []
    for value in ({"k": 1}, {"k": [2, "ä"]}):
        folder.replace("a.json", value)
        assert folder.read("a.json") == value and [n for n in folder.names() if n.endswith(".json")] == ["a.json"]
    folder.delete("a.json")
    assert not folder.exists("a.json")


def test_a_batch_is_logged_once(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    assert log.append(blocks(spark, 1, 5), 0) and not log.append(blocks(spark, 1, 9), 0)
    assert log.read().count() == 5 and log.block("a3") == {"number": 3, "hash": "a3", "parent_hash": "a2"} and log.block("zz") is None


def test_a_kill_between_write_and_commit(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    log.append(blocks(spark, 1, 5), 0)
    log._write(blocks(spark, 6, 7), 1)  # the process ends here: rows are there, the commit isn't
    again = ChangeLog(spark, f"file://{tmp_path}/log")
    assert again.read().count() == 5 and list(again.commits()) == [0]
    assert again.append(blocks(spark, 6, 9), 1) and again.read().count() == 9  # the stream runs the batch again
    assert again.read(6, 7).count() == 2 and again.commits()[1] == {"rows": 4, "first": 6, "last": 9}


def test_truncation_and_what_stands(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    log.append(blocks(spark, 1, 5), 0)
    log.append(blocks(spark, 4, 5, "revert", 1).unionByName(blocks(spark, 4, 8, "commit", 2, "b")), 1)
    log.append(blocks(spark, 9, 12, name="b"), 2)
    assert {r["hash"] for r in log.standing().collect()} == {"a1", "a2", "a3", *[f"b{n}" for n in range(4, 13)]}
    assert log.truncate(4) == [] and log.truncate(7) == [0] and log.truncate(7) == []  # batch 1 reaches up to 8
    assert not log.append(blocks(spark, 1, 5), 0)  # what was finished doesn't come again
    assert {r["number"] for r in ChangeLog(spark, log.path).read().collect()} == set(range(4, 13))
    assert log.truncate(99) == [1, 2] and log.read().isEmpty() and log.block("b9") is None


def test_a_stream_that_goes_on_after_a_restart(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    for k, (a, b) in enumerate(((1, 10), (11, 15))):
        blocks(spark, a, b).coalesce(1).write.mode("append").parquet(source)
        ChangeLog(spark, log.path).sink(spark.readStream.schema(SCHEMA).parquet(source))
        assert log.read().count() == b and sorted(log.commits()) == list(range(k + 1))
    # The commit of the stream's last batch is lost, its rows are logged: the batch runs again and changes nothing.
    Folder(spark, f"{log.path}/checkpoints/feed").delete("commits/1")
    log.sink(spark.readStream.schema(SCHEMA).parquet(source))
    assert log.read().count() == 15


@pytest.mark.parametrize("seed", [1, 2])
def test_downloads_in_any_order(spark, tmp_path, seed):
    """Batches of ten in any order over restarted runs, one twice, one late and one missing."""
    numbers = [k for k in range(26) if k != 20]
    random.Random(seed).shuffle(numbers)
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in (numbers[:9], numbers[9:], numbers[:3]):
        rows = [(n, f"h{n}") for k in part for n in range(k * 10, k * 10 + 10)]
        spark.createDataFrame(rows, "number long, hash string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("number long, hash string").parquet(source)
        got = changes.run_once(assembly.assembled(stream, 64, 1), path)
    blocks_ = [(r["number"], r["hash"]) for r in got.where("kind = 'block'").collect()]
    # 256 to 259 are released by their own range, whatever the one before it lacks.
    assert sorted(blocks_) == [(n, f"h{n}") for n in [*range(200), *range(256, 260)]]
    assert [r["number"] for r in assembly.gapless(got, width=64).orderBy("number").collect()] == list(range(200))
    asked = {(r["number"], r["last"]) for r in got.where("kind = 'request' AND bucket = 3").collect()}
    assert (200, 209) in asked


def test_gapless_stops_at_a_whole_range_that_is_missing(spark):
    rows = [(n // 8, "block", n, n, f"h{n}") for n in [*range(16), *range(24, 32)]]
    assert assembly.gapless(spark.createDataFrame(rows, assembly.RELEASED), width=8).count() == 16
    assert assembly.gapless(spark.createDataFrame([], assembly.RELEASED)).count() == 0
