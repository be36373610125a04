"""Trees of blocks: long chains, forks, unknown parents."""

import pytest
from pyspark.sql import functions as F

from blockloom.operators import tree


def by_hand(rows):
    """hash -> (root, depth)."""
    at = {h: (n, p) for n, h, p in rows}
    found = {}
    for n, h, p in sorted(rows):
        found[h] = (found[p][0], found[p][1] + 1) if p in at and at[p][0] == n - 1 else (h, 0)
    return found


@pytest.fixture(scope="module")
def long_chains(spark):
    """A chain of 10,000 blocks, one of 3,000 that leaves it at 6,000, and one of 40 without a known parent."""
    rows = [(n, f"a{n}", f"a{n - 1}") for n in range(10_000)] + [(n, f"b{n}", f"b{n - 1}" if n > 6001 else "a6000") for n in range(6001, 9001)]
    rows += [(n, f"c{n}", f"c{n - 1}") for n in range(50, 90)]
    return rows, spark.createDataFrame(rows, "number long, hash string, parent_hash string")


def test_roots_and_depths(long_chains):
    rows, df = long_chains
    assert {r["hash"]: (r["root"], r["depth"]) for r in tree.rooted(df).collect()} == by_hand(rows)


def test_canonical_chain_and_ancestors(long_chains):
    rows, df = long_chains
    assert {r["hash"] for r in tree.canonical(df).collect()} == {f"a{n}" for n in range(10_000)}
    side = {f"a{n}" for n in range(6001)} | {f"b{n}" for n in range(6001, 9001)}
    assert {r["hash"] for r in tree.canonical(df, "b9000").collect()} == side
    for steps in (0, 1, 5, 63, 64):
        got = sorted(tree.ancestors(df, "b6010", steps).collect(), key=lambda r: r["depth"])
        assert [r["depth"] for r in got] == list(range(steps + 1)) and [r["number"] for r in got] == list(range(6010, 6009 - steps, -1))
    assert tree.ancestors(df, "none").collect() == [] and tree.canonical(df.limit(0)).collect() == []


def test_descent_and_finality(long_chains):
    rows, df = long_chains
    below = {r["hash"] for r in tree.descends(df, "a6000").collect() if r["descends"]}
    assert below == {f"a{n}" for n in range(6001, 10_000)} | {f"b{n}" for n in range(6001, 9001)}
    fate = {r["hash"]: r["fate"] for r in tree.after_finality(df, 6500, "a6500").collect()}
    assert len(fate) == len(rows) and fate["a6499"] == "below" and fate["b6400"] == "below" and fate["c89"] == "below"
    assert {h for h, f in fate.items() if f == "kept"} == {f"a{n}" for n in range(6500, 10_000)} and {h for h, f in fate.items() if f == "side"} == {f"b{n}" for n in range(6500, 9001)}
    assert {r["hash"]: r["fate"] for r in tree.after_finality(df, 49, "a49").collect()}["c50"] == "kept"  # nobody knows its parent


def test_links_need_numbers_that_follow(spark):
    """Hashes that name each other, or a block of the wrong height, make no link and no endless walk."""
    df = spark.createDataFrame([(1, "x", "y"), (1, "y", "x"), (5, "z", "x"), (2, "v", "x"), (None, "w", "v"), (3, "u", None)], "number long, hash string, parent_hash string")
    assert {r["hash"]: (r["root"], r["depth"]) for r in tree.rooted(df).collect()} == {"x": ("x", 0), "y": ("y", 0), "z": ("z", 0), "v": ("x", 1), "w": ("w", 0), "u": ("u", 0)}


@pytest.mark.parametrize("width", [64, 999])
def test_rounds_hold_only_links_that_leave_a_range(long_chains, monkeypatch, width):
    """What is written for a tree is about its blocks once, not once for each round."""
    rows, df = long_chains
    held = []
    monkeypatch.setattr(tree, "written", lambda made, write=tree.written: held.append(write(made)) or held[-1])
    assert {r["hash"]: (r["root"], r["depth"]) for r in tree.rooted(df, width=width).collect()} == by_hand(rows)
    assert sum(h.count() for h in held) < 2 * len(rows) + 40 * 13_000 // width
    assert {r["hash"] for r in tree.ancestors(df, "b9000", width=width).collect()} == {f"a{n}" for n in range(6001)} | {f"b{n}" for n in range(6001, 9001)}


def test_the_best_head_hashes_its_own_number_only(spark):
    """Hashes that a view works out are worked out where the highest number is, not for all blocks."""
    made = spark.sparkContext.accumulator(0)

    def hashed(n):
        made.add(1)
        return f"a{n:05}"

    df = spark.range(5000).select(F.col("id").alias("number"), F.udf(hashed)("id").alias("hash"))
    assert tree.best_head(df) == "a04999" and made.value == 1
    assert tree.best_head(df.limit(0)) is None
    assert tree.best_head(spark.createDataFrame([(3, "c"), (3, "b"), (2, "a"), (None, "0")], "number long, hash string")) == "b"


def test_a_range_is_walked_by_places_and_ids(spark):
    """Links count only where id and place both fit; one whose range is left keeps its way out, whatever the order of rows."""
    rows = [(12, 7, 11, 6), (11, 6, 10, 5), (10, 5, 3, 3), (13, 7, 11, 5), (14, 6, None, None), (9, 8, 12, 7)]
    links = spark.createDataFrame(rows, "id long, place long, up long, up_place long").repartition(3, "id")
    found = {r["id"]: tuple(r)[1:] for r in tree._walked(links, 4).collect()}
    assert found == {12: (7, 10, 2, 3, 3), 11: (6, 10, 1, 3, 3), 10: (5, 10, 0, 3, 3), 13: (7, 13, 0, None, None), 14: (6, 14, 0, None, None), 9: (8, 9, 0, 12, 7)}
    assert sorted(map(tuple, tree.followed(links, 9, width=4).collect())) == [(9, 8, 0), (10, 5, 3), (11, 6, 2), (12, 7, 1)]
