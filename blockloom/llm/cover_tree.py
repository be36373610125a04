"""Exact near-duplicate join of vectors by cosine, with cover trees traversed in pairs.

Vectors are compared only when labels (and lengths) are equal. Equal vectors are folded first, so
copies cost nothing further. A tree of cells is grown over all vectors by Spark, level by level: a cell
of more than `block` vectors (at first, a label) is dealt to the nearest of the pivots that a bounded
sample of that cell gives, and every child knows its center and covering radius. The tree is then
descended in pairs, by joins of the pairs that are left with their cells' children; pairs whose radii
rule every link out are dropped at each level, so pairs of leaves come from the bounds of the levels
above. A task holds one pair of leaves: it builds a cover tree over each (nested levels with halving
radii) and descends both at once, dropping node pairs that are too far apart for any link and counting
those that are close enough for every link; what is left is decided by the cosine in double precision.
Tasks return a count of links and one edge for each vector, never pairs, so rows stay in proportion to
the vectors in each task. The samples only decide where vectors are dealt; all are dealt and compared.

Defined results: a vector that is null, empty, zero, or has null or non-finite components, a null
label or a null id links with nothing: n_links 0, component_id its own id, kept. Rows that repeat id
and vector are copies like others (they link, and are kept together). An empty table gives no rows;
other columns are not read. At the threshold itself the plain formula in double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bayes_jaccard import _grouped
from .components import UnionFind, components
from .shared import written

THRESHOLD, BLOCK, PIVOT_SAMPLE, DEPTH, LEAF, SLACK = 0.98, 8192, 512, 16, 24, 1e-7  # slack: distances near 0 carry errors of 1e-8


@dataclass
class Node:
    center: int
    members: np.ndarray  # indices of the vectors below
    radius: float  # of the members around the center
    level: float  # covering radius asked of the children's parents
    children: list["Node"] | None = None


class CoverTree:
    """Nested nets over unit vectors: each child's members lie within half the parent's level."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(0, np.arange(len(x)), 2.0)

    def _node(self, center: int, members: np.ndarray, level: float) -> Node:
        d = self.distances(np.array([center]), members)[0]
        return Node(center, members, float(d.max()) if len(d) else 0.0, level)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * self.x[a] @ self.x[b].T))

    def children(self, node: Node) -> list[Node]:
        """The net at half the level, the node's own center first; built when first asked for."""
        if node.children is None:
            level = node.level / 2
            while level >= node.radius and level > 1e-6:  # levels with one and the same node
                level /= 2
            left = np.concatenate([[node.center], node.members[node.members != node.center]])
            node.children = []
            while len(left):
                # A batch of candidates at a time; each covers what is left within the level.
                batch = left[:128]
                d = self.distances(batch, left)
                free = np.ones(len(left), bool)
                for k in range(len(batch)):
                    if free[k]:
                        mine = free & (d[k] <= level)
                        mine[k] = True
                        free &= ~mine
                        node.children.append(Node(int(batch[k]), left[mine], float(d[k][mine].max()), level))
                left = left[free]
        return node.children


class Links:
    """Counts and connected sets over the vectors of one task."""

    def __init__(self, x: np.ndarray, raw: np.ndarray, weight: np.ndarray, threshold: float):
        self.tree_x, self.raw, self.weight, self.t = x, raw, weight, threshold
        self.count, self.sets = np.zeros(len(x), np.int64), UnionFind(len(x))
        self.reach = float(np.sqrt(2 - 2 * threshold))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        self.sets.link(i, j)

    def all_between(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        self.sets.link(np.concatenate([a, np.full(len(b), a[0])]), np.concatenate([np.full(len(a), b[0]), b]))

    def all_within(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        self.sets.link(a[1:], np.full(len(a) - 1, a[0]))

    def tested(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for k in range(0, len(a), 1024):
            part = a[k : k + 1024]
            c = self.tree_x[part] @ self.tree_x[b].T
            i, j = np.nonzero(c >= self.t - SLACK)
            near = np.abs(c[i, j] - self.t) <= SLACK
            i, j = part[i], b[j]
            if near.any():
                u, v = self.raw[i[near]], self.raw[j[near]]
                near[near] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) < self.t
                i, j = i[~near], j[~near]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                self.add(i, j)

    def traverse(self, ta: CoverTree, tb: CoverTree) -> None:
        """Both trees downwards; ta is tb for the pairs within one block."""
        stack = [(ta.root, tb.root)]
        while stack:
            a, b = stack.pop()
            if a is b:
                if 2 * a.radius <= self.reach - SLACK:
                    self.all_within(a.members)
                elif len(a.members) <= LEAF:
                    self.tested(a.members, a.members, True)
                else:
                    self._descend(stack, ta.children(a), ta.children(a), True)
            elif len(a.members) * len(b.members) <= LEAF * LEAF:
                self.tested(a.members, b.members, False)
            elif len(a.members) > 1 and (a.radius >= b.radius or len(b.members) == 1):
                self._descend(stack, ta.children(a), [b], False)
            else:
                self._descend(stack, [a], tb.children(b), False)

    def _descend(self, stack: list, left: list[Node], right: list[Node], same: bool) -> None:
        """Pushes the pairs that can hold both links and non-links; settles the others."""
        cl, cr = np.array([n.center for n in left]), np.array([n.center for n in right])
        rl, rr = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        sl, sr = np.array([len(n.members) for n in left]), np.array([len(n.members) for n in right])
        for k in range(0, len(left), 1024):
            d = np.sqrt(np.maximum(0, 2 - 2 * self.tree_x[cl[k : k + 1024]] @ self.tree_x[cr].T))
            i, j = np.nonzero(d <= self.reach + rl[k : k + 1024, None] + rr + SLACK)
            gap = d[i, j]
            i += k
            if same:
                ok = i <= j
                i, j, gap = i[ok], j[ok], gap[ok]
            single = (sl[i] == 1) & (sr[j] == 1)
            if same:
                single &= i != j
            if single.any():
                a, b = cl[i[single]], cr[j[single]]
                c = (self.tree_x[a] * self.tree_x[b]).sum(1)
                yes, near = c >= self.t, np.abs(c - self.t) <= SLACK
                if near.any():
                    u, v = self.raw[a[near]], self.raw[b[near]]
                    yes[near] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= self.t
                if yes.any():
                    self.add(a[yes], b[yes])
            for p, q, g, s in zip(i.tolist(), j.tolist(), gap.tolist(), single.tolist()):
                if s:
                    continue
                x, y = left[p], right[q]
                if x is y:
                    if len(x.members) > 1:
                        stack.append((x, y))
                elif g + x.radius + y.radius <= self.reach - SLACK:
                    self.all_between(x.members, y.members)
                else:
                    stack.append((x, y))


def scaled(v) -> np.ndarray | None:
    """The components as doubles, scaled by a power of two so that squares neither over- nor underflow; None if invalid."""
    if v is None or not len(v):
        return None
    try:
        x = np.array(v, np.float64)
    except (TypeError, ValueError):
        return None
    if not np.isfinite(x).all() or not x.any():
        return None
    top = np.abs(x).max()
    return x if 1e-100 < top < 1e100 else np.ldexp(x, -int(np.frexp(top)[1]))


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, dim, raw (doubles as bytes), node (128-bit key of label and vector); the last four null if invalid."""
    slim = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([slim.schema["vec_id"], T.StructField("label", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("raw", T.BinaryType()), T.StructField("node", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim, raw, node = [], [], [], []
            for key, name, v in zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["v"].to_pylist()):
                x = scaled(v) if key is not None and name is not None else None
                if x is not None:
                    x = x + 0.0  # no negative zeros
                label.append(None if x is None else name)
                dim.append(None if x is None else len(x))
                raw.append(None if x is None else x.tobytes())
                node.append(None if x is None else xxhash.xxh3_128_digest(f"{name}\x00".encode() + raw[-1]))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(label, pa.string()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary()), pa.array(node, pa.binary())], names=schema.names)

    return slim.mapInArrow(work, schema)


def _units(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw)).reshape(-1, dim)
    return x, x / np.sqrt((x * x).sum(1))[:, None]


@F.pandas_udf(T.DoubleType())
def chord(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance on the unit sphere of two columns of raw vectors; 0 where either is missing."""
    out = np.zeros(len(a))
    sizes = np.array([0 if u is None or v is None else len(u) for u, v in zip(a, b)])
    for size in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == size)
        (_, x), (_, y) = _units(a.iloc[at].tolist(), size // 8), _units(b.iloc[at].tolist(), size // 8)
        out[at] = np.sqrt(np.maximum(0, 2 - 2 * (x * y).sum(1)))
    return pd.Series(out)


PIVOT = T.StructType([T.StructField("cell", T.StringType()), T.StructField("child", T.IntegerType()), T.StructField("center", T.BinaryType())])


def net_of(sample: pa.Table) -> pa.Table:
    """The pivots of a cell: a net of its sample at the first level of a cover tree; none if the sample has no coarse structure."""
    raw = sorted(sample["raw"].to_pylist())
    _, x = _units(raw, len(raw[0]) // 8)
    tree = CoverTree(x)
    net = [n.center for n in tree.children(tree.root)] if len(raw) > 1 else []
    if not 1 < len(net) <= max(2, len(raw) // 8):
        net = []
    cell = sample["cell"].to_pylist()[:1] * len(net)
    return pa.table([pa.array(cell, pa.string()), pa.array(range(len(net)), pa.int32()), pa.array([raw[k] for k in net], pa.binary())], names=PIVOT.names)


def _nearest(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each vector's nearest pivot and its distance, from rows that come sorted: a cell's pivots, then its vectors."""
    for rows in _grouped(batches, ["cell", "salt"]):
        pivot = rows.filter(pc.invert(rows["member"]))
        _, centers = _units(pivot["raw"].to_pylist(), len(pivot["raw"][0].as_py()) // 8)
        children = np.asarray(pivot["child"])
        mine = rows.filter(rows["member"])
        for k in range(0, mine.num_rows, 4096):
            part = mine.slice(k, 4096)
            _, x = _units(part["raw"].to_pylist(), centers.shape[1])
            near = x @ centers.T
            at = near.argmax(1)
            d = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(at)), at]))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in names[:-2]], pa.array(children[at], pa.int32()), pa.array(d, pa.float64())], names=names)


def top_cell():
    """The cell of all vectors of a label and length; hashed, so that names of cells below can't clash with a label."""
    return F.md5(F.concat_ws(" ", "dim", "label"))


def cells(classes: DataFrame, block: int = BLOCK, sample: int = PIVOT_SAMPLE) -> tuple[DataFrame, list[DataFrame]]:
    """Vectors with their leaf cell (node, n, dim, raw, cell), and the children of each level (parent, cell, center, radius).

    A cell without coarse structure stays whole, and so does one at the deepest level.
    """
    rest = classes.select("node", "n", "dim", "raw", top_cell().alias("cell"))
    done, levels = [], []
    for level in range(DEPTH):
        sizes = rest.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
        large = written(rest.join(sizes, "cell")) if not sizes.isEmpty() else None
        if large is None:
            break
        done.append(rest.join(sizes, "cell", "left_anti"))
        draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 40))
        pivots = written(large.where(draw < F.lit(float(sample << 40)) / F.col("size")).select("cell", "raw").groupBy("cell").applyInArrow(net_of, PIVOT))
        whole = large.join(pivots.select("cell").distinct(), "cell", "left_anti").drop("size")
        done.append(whole)
        parts = F.ceil(F.col("size") / block).cast("int")
        names = ["node", "n", "dim", "raw", "cell", "child", "d"]
        blank = [F.lit(None).cast(large.schema[c].dataType).alias(c) for c in names[:3]]
        asked = pivots.join(sizes, "cell").select(*blank, F.col("center").alias("raw"), "cell", "child", F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        split = large.join(pivots.select("cell").distinct(), "cell", "left_semi")
        split = split.select(*names[:5], F.lit(None).cast("int").alias("child"), F.lit(True).alias("member"), F.pmod(F.xxhash64("node", F.lit(-1)), parts).cast("int").alias("salt"))
        schema = T.StructType([*[large.schema[c] for c in names[:5]], T.StructField("child", T.IntegerType()), T.StructField("d", T.DoubleType())])
        dealt = asked.unionByName(split).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "member", "child")
        dealt = written(dealt.mapInArrow(lambda b: _nearest(b, names), schema).withColumn("below", F.concat_ws(".", "cell", F.col("child").cast("string"))))
        radius = dealt.groupBy("cell", "child", "below").agg(F.max("d").alias("radius"))
        levels.append(written(radius.join(pivots, ["cell", "child"]).select(F.col("cell").alias("parent"), F.col("below").alias("cell"), "center", "radius")))
        rest = dealt.select("node", "n", "dim", "raw", F.col("below").alias("cell"))
    done.append(rest)
    leaves = done[0]
    for df in done[1:]:
        leaves = leaves.unionByName(df)
    return leaves, levels


def near_cells(tops: DataFrame, levels: list[DataFrame], reach: float) -> DataFrame:
    """a, b (a <= b) of the pairs of leaf cells that can hold a link, by descending the tree in pairs from its tops (cell)."""
    none = F.lit(None)
    pairs = tops.select(F.col("cell").alias("a"), F.col("cell").alias("b"), none.cast("binary").alias("ca"), none.cast("double").alias("ra"), none.cast("binary").alias("cb"), none.cast("double").alias("rb"))
    for below in levels:
        for side, c, r in (("a", "ca", "ra"), ("b", "cb", "rb")):
            child = below.select(F.col("parent").alias(side), F.col("cell").alias("x"), F.col("center").alias("cx"), F.col("radius").alias("rx"))
            pairs = pairs.withColumn("same", F.col("a") == F.col("b")) if side == "a" else pairs
            pairs = pairs.join(child, side, "left").withColumns({side: F.coalesce("x", side), c: F.coalesce("cx", c), r: F.coalesce("rx", r)}).drop("x", "cx", "rx")
        close = F.col("ca").isNull() | F.col("cb").isNull() | (F.col("a") == F.col("b")) | (chord("ca", "cb") <= F.col("ra") + F.col("rb") + reach)
        pairs = written(pairs.where(~F.col("same") | (F.col("a") <= F.col("b"))).where(close).drop("same"))
    return pairs.select("a", "b")


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, links, root) of the vectors of a pair of blocks that have links."""
    for rows in _grouped(batches, ["pair"]):
        raw, x = _units(rows["raw"].to_pylist(), rows["dim"][0].as_py())
        nodes, side = rows["node"].to_pylist(), np.asarray(rows["side"])
        links = Links(x, raw, np.asarray(rows["n"]), threshold)
        if rows["self"][0].as_py():
            tree = CoverTree(x)
            links.traverse(tree, tree)
        elif (side == side[0]).all():  # the hash left the other part empty
            continue
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            trees = []
            for part in (left, right):
                tree = CoverTree.__new__(CoverTree)
                tree.x = x
                tree.root = tree._node(int(part[0]), part, 2.0)
                trees.append(tree)
            links.traverse(*trees)
        root, use = links.sets.roots(), np.flatnonzero(links.count)
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in use], pa.binary()), pa.array(links.count[use], pa.int64()), pa.array([nodes[root[k]] for k in use], pa.binary())], ["node", "links", "root"])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept."""
    known = written(vectors(df, id_col, vector_col, label_col))
    classes = written(known.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw")))
    leaves, levels = cells(classes, block, sample)
    leaves = written(leaves)
    reach = float(np.sqrt(2 - 2 * threshold)) + 2 * SLACK
    # A leaf that is still too large is dealt to parts by hash, and its parts are compared part against part.
    sizes = written(leaves.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    split = leaves.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    pairs = near_cells(classes.select(top_cell().alias("cell")).distinct(), levels, reach)
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("cell").alias(side), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"p{side}")), side)
    pairs = written(pairs.where((F.col("a") != F.col("b")) | (F.col("pa") <= F.col("pb"))).withColumn("pair", F.concat_ws("|", "a", "pa", "b", "pb")))
    self = (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))
    sides = pairs.select("pair", F.col("a").alias("cell"), F.col("pa").alias("part"), F.lit(0).alias("side")).unionByName(pairs.where(~self).select("pair", F.col("b").alias("cell"), F.col("pb").alias("part"), F.lit(1).alias("side")))
    # Whether a pair is a leaf with itself is said by its rows, as a hash may leave a part empty.
    sides = sides.join(pairs.select("pair", self.alias("self")), "pair")
    tasks = split.join(sides, ["cell", "part"]).select("pair", "self", "side", "node", "n", "dim", "raw")
    found = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])
    linked = written(tasks.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda b: _compared(b, threshold), found))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = written(classes.select("node", "least", "n").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Written first, so that the join sees two shuffles and a very large component can be split.
    least = written(of_class.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = of_class.join(least, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = known.select("vec_id", "node").join(of_class, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
