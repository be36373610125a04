"""Trees of blocks with forks, by walks within ranges and pointer doubling between them.

A block's parent is the block whose hash it names and whose number is one less, so links can't run in a
circle. Links are rows (id, place, up, up_place) with up_place below place. Rows of a range of places are walked
together, in the order of places: a row learns where the range ends for it, at a root or at a link that leaves the
range. Only those links (one for each range and fork) are doubled: in every round each learns from the one it has
reached what that one has reached, so n of them take log2(n) joins. Rounds are written to the shared folder, so
lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Places of a range; a task holds the rows of one range at a time.
WIDTH = 8192


def _links(headers: DataFrame, stop: Column | None = None) -> DataFrame:
    """id, place, up, up_place of headers with a number; no up where stop holds."""
    up = F.col("parent_hash") if stop is None else F.when(~F.coalesce(stop, F.lit(False)), F.col("parent_hash"))
    return headers.where("number IS NOT NULL").select(F.col("hash").alias("id"), F.col("number").alias("place"), up.alias("up"), (F.col("number") - 1).alias("up_place"))


def _parents(width: int):
    """A function of the rows of a range: where the row that each one's link names lies (its own place if it isn't
    there), and whether its link leaves the range. Nested, so that it goes to the workers by value."""

    def found(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n, ids, ups = rows.num_rows, *(rows.column(c).combine_chunks() for c in ("id", "up"))
        places, up_places = (rows.column(c).fill_null(0).to_numpy() for c in ("place", "up_place"))
        linked = ups.is_valid().to_numpy(zero_copy_only=False)
        leaves = linked & (up_places // width != places // width)
        codes = pa.concat_arrays([ids, ups]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
        keys, wanted = codes[:n] * width + places % width, codes[n:] * width + up_places % width
        order = np.argsort(keys, kind="stable")
        at = order[np.maximum(np.searchsorted(keys[order], wanted, "right") - 1, 0)]
        return np.where(linked & ~leaves & (up_places < places) & (keys[at] == wanted), at, np.arange(n)), leaves

    return found


def _walked(links: DataFrame, width: int) -> DataFrame:
    """id, place, top, depth, out, out_place: where a row's links end within its range, the steps to it, and the link
    that leaves the range there (null at a root)."""

    parents = _parents(width)

    def walk(rows: pa.Table) -> pa.Table:
        top, leaves = parents(rows)
        depth = (top != np.arange(len(top))).astype("int64")
        while not np.array_equal(further := top[top], top):
            top, depth = further, depth + depth[top]
        ends, left = pa.array(top), pa.array(leaves)
        out, out_place = (pc.if_else(left, rows.column(c).combine_chunks(), None).take(ends) for c in ("up", "up_place"))
        cols = [rows.column("id"), rows.column("place"), rows.column("id").combine_chunks().take(ends), pa.array(depth), out, out_place]
        return pa.table(cols, names=["id", "place", "top", "depth", "out", "out_place"])

    id_ = links.schema["id"].dataType.simpleString()
    schema = f"id {id_}, place long, top {id_}, depth long, out {id_}, out_place long"
    return written(_ranged(links, width).applyInArrow(walk, schema))


def _ranged(links: DataFrame, width: int):
    return links.groupBy(F.floor(F.col("place") / width).alias("range"))


def _of(local: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of local that wanted (out, out_place; small) names, as out, out_place and their top2, depth2, out2, out_place2."""
    renamed = {"id": "out", "place": "out_place", "top": "top2", "depth": "depth2", "out": "out2", "out_place": "out_place2"}
    return wanted.join(local.select(*[F.col(c).alias(new) for c, new in renamed.items()]), ["out", "out_place"])


def rooted(headers: DataFrame, stop: Column | None = None, width: int = WIDTH) -> DataFrame:
    """number, hash, root, depth: the first block that each block's parents lead to, and the steps to it.

    headers: number, hash (unique), parent_hash. Walks end at blocks whose parent is not there, and at those
    for which stop holds, which count as roots.
    """
    local = _walked(_links(headers, stop), width)
    leaving = written(local.where("depth = 0 AND out IS NOT NULL").select("id", "out", "out_place"))
    hops = leaving.join(written(_of(local, leaving.select("out", "out_place").distinct())), ["out", "out_place"], "left")
    # up: the next row whose link leaves its range, null once top is a root; depth: the steps to either.
    state = written(hops.select("id", F.when(F.col("out2").isNotNull(), F.col("top2")).alias("up"), F.when(F.col("depth2").isNull(), F.col("id")).otherwise(F.col("top2")).alias("top"), F.coalesce(F.col("depth2") + 1, F.lit(0)).alias("depth")))
    while not state.where("up IS NOT NULL").isEmpty():
        ends = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        near = state.where("up IS NOT NULL").join(ends, "up").select("id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"))
        state = written(state.where("up IS NULL").unionByName(near))
    further = state.select(F.col("id").alias("top"), F.col("top").alias("root"), F.col("depth").alias("more"))
    found = local.join(further, "top", "left").select(F.col("place").alias("number"), F.col("id").alias("hash"), F.coalesce("root", "top").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    unnumbered = headers.where("number IS NULL").select("number", "hash", F.col("hash").alias("root"), F.lit(0).cast("long").alias("depth"))
    return found.unionByName(unnumbered)


def followed(links: DataFrame, start, steps: int | None = None, width: int = WIDTH) -> DataFrame:
    """id, place, depth of what is reached from start (0) by links (id, place, up, up_place), so many steps at most.

    Where walks enter ranges is found by doubling: entries within 2 ^ k - 1 others are known, and their 2 ^ k-th
    successors are the next 2 ^ k. Then the ranges are walked from their entries.
    """
    local = _walked(links, width)
    first = local.where(F.col("id") == start).select(F.col("id").alias("out"), F.col("place").alias("out_place"))
    entries = written(local.where("depth = 0 AND out IS NOT NULL").select("out", "out_place").unionByName(first).distinct())
    state = written(_of(local, entries).select(F.col("out").alias("id"), F.col("out2").alias("up"), F.col("out_place2").alias("up_place"), (F.col("depth2") + 1).alias("far"), F.col("out_place").alias("place")))
    found, k = written(state.where(F.col("id") == start).select("id", "place", F.lit(0).cast("long").alias("depth"))), 0
    while steps is None or 1 << k <= steps:
        ends = state.select(F.col("id").alias("up"), F.col("place").alias("up_place"), F.col("up").alias("up2"), F.col("up_place").alias("up_place2"), F.col("far").alias("far2"))
        linked = written(state.join(ends, ["up", "up_place"]))  # a link to a row that isn't there is an end
        further = found.join(linked.select("id", "place", "up", "up_place", "far"), ["id", "place"]).select(F.col("up").alias("id"), F.col("up_place").alias("place"), (F.col("depth") + F.col("far")).alias("depth"))
        if further.isEmpty():
            break
        found = written(found.unionByName(further))
        state, k = written(linked.select("id", F.col("up2").alias("up"), F.col("up_place2").alias("up_place"), (F.col("far") + F.col("far2")).alias("far"), "place").unionByName(state.join(linked.select("id", "place"), ["id", "place"], "left_anti").select("id", F.lit(None).cast(state.schema["up"].dataType).alias("up"), F.lit(None).cast("long").alias("up_place"), "far", "place"))), k + 1

    parents = _parents(width)

    def walk(rows: pa.Table) -> pa.Table:
        nexts, depths, at, out = parents(rows)[0].tolist(), rows.column("entered").to_pylist(), [], []
        for k in [k for k, d in enumerate(depths) if d is not None]:
            at.append(k)
            out.append(depths[k])
            while nexts[k] != k:
                k = nexts[k]
                at.append(k)
                out.append(out[-1] + 1)
        return rows.select(["id", "place"]).take(pa.array(at, pa.int64())).append_column("depth", pa.array(out, pa.int64()))

    entered = links.select("id", "place", "up", "up_place").join(found.withColumnRenamed("depth", "entered"), ["id", "place"], "left")
    reached = _ranged(entered, width).applyInArrow(walk, T.StructType([links.schema["id"], T.StructField("place", T.LongType()), T.StructField("depth", T.LongType())]))
    return reached if steps is None else reached.where(F.col("depth") <= steps)


def ancestors(headers: DataFrame, hash_: str, steps: int | None = None, width: int = WIDTH) -> DataFrame:
    """number, hash, depth of a block (0) and its ancestors, so many steps at most; no rows if it isn't there."""
    return followed(_links(headers), hash_, steps, width).select(F.col("place").alias("number"), F.col("id").alias("hash"), "depth")


def best_head(headers: DataFrame) -> str | None:
    """The hash of the block with the highest number, of several the smallest."""
    top = headers.agg(F.max("number")).first()[0]  # hashes are looked at where this number is
    return headers.where(F.col("number").eqNullSafe(F.lit(top).cast("long"))).agg(F.min("hash")).first()[0]


def canonical(headers: DataFrame, head: str | None = None) -> DataFrame:
    """number, hash of the chain that leads to a head, the best one if none is given."""
    head = head or best_head(headers)
    return headers.select("number", "hash").limit(0) if head is None else ancestors(headers, head).select("number", "hash")


def descends(headers: DataFrame, hash_: str) -> DataFrame:
    """number, hash, descends: whether the parents of each block lead to a block; it isn't its own descendant."""
    found = rooted(headers, F.col("hash") == hash_)
    return found.select("number", "hash", ((F.col("root") == hash_) & (F.col("depth") > 0)).alias("descends"))


def after_finality(headers: DataFrame, number: int, hash_: str) -> DataFrame:
    """number, hash, fate of each block once a block is final.

    below: a smaller number; side: another block at its number, or a descendant of one; kept: all the rest,
    also blocks above it whose parents are not known.
    """
    tops = rooted(headers, F.col("number") == number)
    at = F.col("number") - F.col("depth") == number
    fate = F.when(F.col("number") < number, F.lit("below")).when(at & (F.col("root") != hash_), F.lit("side")).otherwise(F.lit("kept"))
    return tops.select("number", "hash", fate.alias("fate"))
