"""Join of documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

Documents with one and the same set are taken together. Sets that agree in any of 32 bands of five
MinHash values are candidates (a pair at the threshold is missed with probability 3e-6). Candidates
are compared MinHash by MinHash, 32 at a time: under a uniform prior, the pair is dropped as soon as
the posterior probability that it reaches the threshold falls below the tolerance. Sets that
stay connected form clusters. A cluster of more than a few hundred sets is split into blocks along the
bands (sets of one crowded bucket lie together); of the pairs of blocks that share a bucket, the same
test on signatures alone tells which have any pair left, and only these fetch their
blocks' complete sets (packed and compressed, as near copies share most n-grams) to verify them
exactly. No pair of documents is ever a row: tasks count links and hand on one edge per set, so the rows
stay in proportion to the documents. Buckets beyond a task's share are compared block against block too.

The complete sets are worked out again from the texts of one document of each clustered set. Up to
FEW_WANTED of them, 64-bit keys are broadcast to leave all other texts out before the join, up to FILTERED
a Bloom filter of them (500 MB at most), which lets some 2 % of the others pass; beyond that the join
shuffles the texts once.

Words are what white space separates, in lower case; a text of fewer than n words has one n-gram of
all its words. Defined results: null and empty texts have no n-grams and link with nothing; repeated
rows are copies like others (they share a set); null ids rank after all others; texts of any length
have all their n-grams; an empty table gives no rows; other columns, whatever they are called, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import UnionFind, components
from .shared import text_or_empty, written

WORDS, THRESHOLD, TOLERANCE = 5, (4, 5), 1e-6
BANDS, ROWS, STEP = 32, 5, 32
HASHES = BANDS * ROWS
#: Members of a bucket that one task holds, and members and n-grams of a cluster that stay in one block.
BUCKET, CLUSTER_MEMBERS, CLUSTER_GRAMS = 4096, 256, 1_500_000
#: Larger clusters have blocks of at least so many members, about so many blocks, and blocks of at most so many.
BLOCK_LEAST, BLOCKS, BLOCK_MOST = 64, 40, 4096
#: The block of a cluster that has one only.
WHOLE = -1
#: Documents whose texts are read again, up to which their keys (8 bytes each), or a filter of them (10 bits each) are broadcast.
FEW_WANTED, FILTERED = 2_000_000, 400_000_000
GROUP_CHARS = 3_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def gram_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text."""
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS or k == len(texts) - 1:
            yield from _gram_group(group, words)
            group, size = [], 0


def _gram_group(texts: list[str], words: int) -> Iterator[np.ndarray]:
    split = [x.lower().split() for x in texts]
    flat = pa.array([w for ws in split for w in ws], pa.large_string()).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    h = hashes[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.uint64)
    at = 0
    for ws in split:
        mine = h[at : at + len(ws)]
        at += len(ws)
        n = min(words, len(ws))
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        g = np.full(len(ws) - n + 1, n, np.uint64)
        for k in range(n):
            g = (g ^ mine[k : len(ws) - n + 1 + k]) * _MIX
            g ^= g >> np.uint64(29)
        yield np.unique(g)


def minhashes(grams: np.ndarray) -> np.ndarray:
    """HASHES minima, in blocks of n-grams that stay in the processor's cache."""
    a, b = _permutations()
    best = np.full(HASHES, ~np.uint64(0))
    for k in range(0, len(grams), 256):
        np.minimum(best, (grams[k : k + 256, None] * a + b).min(0), out=best)
    return best


def signature(minima: np.ndarray) -> bytes:
    """A byte of each MinHash. A minimum over many n-grams has a top byte of zero, so all bits are mixed first."""
    return ((minima * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(minima: np.ndarray) -> list[int]:
    high = (minima >> np.uint64(16)).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ high[:, k]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


@lru_cache(8)
def least_matches(threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """[(values compared, matches needed to go on)].

    Values are compared by eight mixed bits, so a pair of similarity s matches with probability
    p = s + (1 - s) / 256; the posterior of s under a uniform prior follows from the likelihood
    p^m (1 - p)^(n - m) on a fine grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p, reached, out = s + (1 - s) / 256, s >= threshold[0] / threshold[1], []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[reached].sum() / weight.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) that no step of the comparison drops."""
    i = j = None
    matches, done = None, 0
    for n, least in rules:
        if i is None:
            i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
            matches = np.zeros(len(i), np.int16)
        matches = matches + (a[i, done:n] == b[j, done:n]).sum(1, dtype=np.int16)
        stay = matches >= least
        i, j, matches, done = i[stay], j[stay], matches[stay], n
    return i, j


def _tiles(na: int, nb: int) -> Iterator[tuple[slice, slice]]:
    side = 512
    for x in range(0, na, side):
        for y in range(0, nb, side):
            yield slice(x, x + side), slice(y, y + side)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key after another, from batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_pylist() for k in keys]
        rows = list(zip(*cols))
        begin = 0
        for k, row in enumerate(rows):
            if row != last:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held, begin, last = [], k, row
        held.append(batch.slice(begin))
    if held:
        yield pa.concat_batches(held)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, text_key (SHA-1), node (128-bit key of the n-gram set; null if empty), grams, sig, bands."""
    slim = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.unhex(F.sha1("text")))
    schema = T.StructType([
        T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("text_key", T.BinaryType()), T.StructField("node", T.BinaryType()),
        T.StructField("grams", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def sketch(batches):
        for batch in batches:
            node, grams, sig, bands = [], [], [], []
            for g in gram_sets(batch["text"].to_pylist(), words):
                grams.append(len(g))
                if not len(g):
                    node.append(None)
                    sig.append(None)
                    bands.append(None)
                    continue
                low = minhashes(g)
                node.append(xxhash.xxh3_128_digest(g.tobytes()))
                sig.append(signature(low))
                bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(node, pa.binary()), pa.array(grams, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return slim.mapInArrow(sketch, schema)


def _blocks(df: DataFrame, count: str, by: str) -> DataFrame:
    """A row for each pair of blocks (i <= j) that it takes part in; one row where one block holds all."""
    mine = F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    return df.withColumn("mine", mine).withColumn("other", other).select("*", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).drop("other", count)


def _linked_in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with a spanning tree of each group of plausible pairs, found breadth first."""
    rules, twos = least_matches(), []
    for rows in _grouped(batches, ["key", "i", "j"]):
        if rows.num_rows == 2:  # most buckets; tested together
            twos += zip(rows["node"].to_pylist(), rows["sig"].to_pylist())
            if len(twos) >= 20_000:
                yield _linked_twos(twos, rules)
                twos = []
            continue
        nodes, sig = rows["node"].to_pylist(), _matrix(rows["sig"], HASHES)
        open_, a, b = np.arange(len(nodes)), [], []
        while len(open_):
            queue, open_ = open_[:1], open_[1:]
            while len(queue) and len(open_):
                step, queue = queue[:64], queue[64:]
                i, j = [], []
                for y in range(0, len(open_), 2048):
                    p, q = plausible(sig[step], sig[open_[y : y + 2048]], rules)
                    i.append(p)
                    j.append(q + y)
                found, first = np.unique(np.concatenate(j), return_index=True)
                a += [nodes[x] for x in open_[found]]
                b += [nodes[x] for x in step[np.concatenate(i)[first]]]
                queue = np.concatenate([queue, open_[found]])
                open_ = np.delete(open_, found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    yield _linked_twos(twos, rules)


def _linked_twos(rows: list[tuple[bytes, bytes]], rules: list[tuple[int, int]]) -> pa.RecordBatch:
    """Those of the buckets with two members whose pair is plausible; a pair of several bands counts once."""
    pairs = list(dict(zip(zip((r[0] for r in rows[::2]), (r[0] for r in rows[1::2])), zip(rows[::2], rows[1::2]))).values())
    a, b = (np.frombuffer(b"".join(p[k][1] for p in pairs), np.uint8).reshape(-1, HASHES) for k in (0, 1))
    stay, matches, done = np.arange(len(pairs)), np.zeros(len(pairs), np.int16), 0
    for n, least in rules:
        matches = matches + (a[stay, done:n] == b[stay, done:n]).sum(1, dtype=np.int16)
        go = matches >= least
        stay, matches, done = stay[go], matches[go], n
    return pa.RecordBatch.from_arrays([pa.array([pairs[k][c][0] for k in stay], pa.binary()) for c in (0, 1)], ["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: nodes, documents of each, sizes, signatures, and the sets as a compressed payload."""
    for rows in _grouped(batches, ["cluster", "block"]):
        first: dict[bytes, int] = {}
        for k, node in enumerate(rows["node"].to_pylist()):  # rows that repeat id and text come twice
            first.setdefault(node, k)
        rows = rows.take(pa.array(first.values(), pa.int64()))
        join = lambda c: b"".join(rows[c].to_pylist())
        numbers = lambda c: np.asarray(rows[c]).astype(np.int64).tobytes()
        sets = pa.compress(join("set"), codec="zstd", asbytes=True)
        head = [rows["cluster"][:1], rows["block"][:1]]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array([x], pa.binary()) for x in (join("node"), numbers("docs"), numbers("grams"), join("sig"), sets))], names=_BLOCK.names)


_BLOCK = T.StructType([
    T.StructField("cluster", T.BinaryType()), T.StructField("block", T.LongType()),
    *(T.StructField(c, T.BinaryType()) for c in ("nodes", "docs", "sizes", "sigs", "sets")),
])
_PAIR = T.StructType([T.StructField("cluster", T.BinaryType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])


def _homes(chosen: DataFrame, classes: DataFrame, many: DataFrame) -> DataFrame:
    """cluster, node, block, keys of the sets in clusters of several blocks.

    A set's home is the fullest of its buckets, so that near copies share a block; a home with more sets or
    n-grams than a block holds is dealt to several. keys are the buckets that it shares with others.
    """
    members, grams = F.count(F.lit(1)), F.ceil(F.sum("grams") / CLUSTER_GRAMS)
    wide = F.when(members > CLUSTER_MEMBERS, F.greatest(F.least(F.ceil(members / BLOCK_LEAST), F.lit(BLOCKS)), F.ceil(members / BLOCK_MOST))).otherwise(F.lit(1))
    sizes = chosen.groupBy("cluster").agg(members.alias("members"), F.greatest(wide, grams).cast("long").alias("cells")).where("cells > 1")
    large = chosen.join(sizes, "cluster").select("cluster", "members", "cells", "node", "grams")
    keyed = large.join(classes.select("node", "bands"), "node").withColumn("key", F.explode("bands")).drop("bands").join(many, "key")
    first = ["cluster", "members", "cells", "grams"]
    homed = written(keyed.groupBy("node").agg(*[F.first(c).alias(c) for c in first], F.max(F.struct("n", "key"))["key"].alias("home"), F.collect_list("key").alias("keys")))
    most = F.least(F.greatest(F.ceil(F.col("members") / F.col("cells")), F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST))
    crowds = homed.groupBy("cluster", "home").agg(members.alias("n"), grams.alias("parts"), F.first(most).alias("most"))
    crowds = written(crowds.select("cluster", "home", F.greatest(F.ceil(F.col("n") / F.col("most")), "parts").alias("parts")))
    block = F.pmod(F.xxhash64("home"), F.col("cells")) * F.lit(1 << 24) + F.pmod(F.xxhash64("node"), F.col("parts"))
    return homed.join(crowds, ["cluster", "home"]).select("cluster", "node", block.cast("long").alias("block"), "keys")


def _block_pairs(homes: DataFrame) -> DataFrame:
    """cluster, i, j (i <= j): the blocks of which some sets share a bucket, each with itself included."""
    held = homes.select("cluster", "block", F.explode("keys").alias("key")).distinct()
    mine = held.groupBy("cluster", "key").agg(F.sort_array(F.collect_list("block")).alias("blocks"))  # a number for 4096 sets or so
    each = mine.select("cluster", "blocks", F.posexplode("blocks").alias("at", "i"))
    return each.select("cluster", "i", F.explode(F.expr("slice(blocks, at + 1, size(blocks))")).alias("j")).distinct()


def _of_keys(texts: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The texts whose (id, text_key) is among n keys, and perhaps few others; all of them beyond FILTERED keys.

    Up to FEW_WANTED keys are broadcast as they are, more as a Bloom filter of ten bits and three places a key,
    in blocks of 32,768 bits that Spark's bitmap aggregate builds.
    """
    if n > FILTERED:
        return texts
    texts = texts.withColumn("key", F.xxhash64("id", "text_key"))
    if n <= FEW_WANTED:
        return texts.join(F.broadcast(keys.distinct()), "key", "left_semi").drop("key")
    blocks = -(-10 * n // 32768)
    part = F.pmod("key", F.lit(blocks)).alias("part")
    places = F.transform(F.array(*map(F.lit, range(1, 4))), lambda k: F.pmod(F.xxhash64("key", k), F.lit(32768)))
    bits = keys.select(part, F.explode(places).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = lambda at: F.conv(F.hex(F.col("bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = texts.withColumn("part", part).join(F.broadcast(bits), "part")
    return near.where(F.forall(places, lambda at: F.getbit(byte(at), (at % 8).cast("int")) == 1)).drop("key", "part", "bits")


def _plausible_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, i, j) of the pairs of blocks with a pair of sets that no step drops."""
    rules, found = least_matches(), []
    for rows in _grouped(batches, ["cluster", "i", "j"]):
        sigs = [np.frombuffer(x, np.uint8).reshape(-1, HASHES) for x in rows["sigs"].to_pylist()]
        a, b, same = sigs[0], sigs[-1], rows["i"][0] == rows["j"][0]
        if any(((p + x.start < q + y.start) if same else np.ones(len(p), bool)).any() for x, y in _tiles(len(a), len(b)) for p, q in [plausible(a[x], b[y], rules)]):
            found.append([rows[c][0].as_py() for c in ("cluster", "i", "j")])
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["cluster", "i", "j"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, links, root): linked documents in other classes, and the smallest class reached."""
    rules, (num, den) = least_matches(), THRESHOLD
    for rows in _grouped(batches, ["cluster", "i", "j"]):
        join = lambda c: b"".join(rows[c].to_pylist())
        raw, at = join("nodes"), np.cumsum([0, *(len(x) // 16 for x in rows["nodes"].to_pylist())])
        nodes = [raw[k : k + 16] for k in range(0, len(raw), 16)]
        n = len(nodes)
        sig, size, docs = np.frombuffer(join("sigs"), np.uint8).reshape(-1, HASHES), np.frombuffer(join("sizes"), np.int64), np.frombuffer(join("docs"), np.int64)
        i0, j0 = 0, rows.num_rows - 1  # one block with itself, or two
        left, right = np.arange(at[i0], at[i0 + 1]), np.arange(at[j0], at[j0 + 1])
        grams = np.frombuffer(b"".join(pa.decompress(x, int(size[at[k] : at[k + 1]].sum()) * 8, codec="zstd", asbytes=True) for k, x in enumerate(rows["sets"].to_pylist())), np.uint64)
        begin = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(grams, kind="stable")
        new = np.concatenate([[True], np.diff(grams[order]) > 0]) if len(order) else np.zeros(0, bool)
        word = np.empty(len(grams), np.int64)
        word[order] = np.cumsum(new) - 1
        post = owner[order]
        bounds = np.append(np.flatnonzero(new), len(order))
        links, sets = np.zeros(n, np.int64), UnionFind(n)
        for x, y in _tiles(len(left), len(right)):
            p, q = plausible(sig[left[x]], sig[right[y]], rules)
            p, q = left[x][p], right[y][q]
            if i0 == j0:
                p, q = p[p < q], q[p < q]
            cut = np.flatnonzero(np.diff(p, prepend=-1))
            good_p, good_q = [], []
            for s, e in zip(cut, np.append(cut[1:], len(p))):
                one, others = p[s], q[s:e]
                if e - s == 1:
                    two = others[0]
                    both = np.array([len(np.intersect1d(grams[begin[one] : begin[one + 1]], grams[begin[two] : begin[two + 1]], assume_unique=True))])
                else:
                    w = word[begin[one] : begin[one + 1]]
                    m = bounds[w + 1] - bounds[w]
                    at = np.repeat(bounds[w] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                    both = np.bincount(post[at], minlength=n)[others]
                ok = both * den >= (size[one] + size[others] - both) * num
                good_q.append(others[ok])
                good_p.append(np.full(ok.sum(), one))
            if good_p:
                gp, gq = np.concatenate(good_p), np.concatenate(good_q)
                np.add.at(links, gp, docs[gq])
                np.add.at(links, gq, docs[gp])
                sets.link(gp, gq)
        root, use = sets.roots(), np.flatnonzero(links)
        least = np.full(n, -1)
        for k in sorted(use.tolist(), key=lambda k: nodes[k], reverse=True):
            least[root[k]] = k
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in use], pa.binary()), pa.array(links[use], pa.int64()), pa.array([nodes[least[root[k]]] for k in use], pa.binary())], ["node", "links", "root"])


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, kept, set_id.

    class_id is the smallest id that links reach, n_links the number of other documents at the
    threshold or above (copies included), set_id the smallest id with the same n-gram set.
    """
    known = written(sketches(df, id_col, text_col, words))
    classes = known.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("grams").alias("grams"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = written(classes)
    # Buckets with two classes or more, then the signatures of these classes only.
    bands = classes.select("node", F.explode("bands").alias("key"))
    # Counts are combined before their shuffle and written, so that the join can split a very common key.
    many = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = bands.join(many, "key")
    buckets = shared.withColumn("blocks", F.ceil(F.col("n") / BUCKET).cast("int")).drop("n").join(classes.select("node", "sig"), "node")
    pairs = _blocks(buckets, "blocks", "key").drop("mine").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edge = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    clusters = components(pairs.mapInArrow(_linked_in_bucket, edge)).withColumnRenamed("root", "cluster")
    # Each cluster's complete sets, in blocks.
    chosen = written(clusters.join(classes.select("node", "docs", "one", "grams", "sig"), "node"))
    homes = written(_homes(chosen, classes, many))
    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.unhex(F.sha1("text")))
    placed = chosen.join(homes.select("node", "block"), "node", "left")
    wanted = placed.select("cluster", F.coalesce("block", F.lit(WHOLE)).alias("block"), "node", "docs", "grams", "sig", F.col("one.doc_id").alias("one_id"), F.col("one.text_key").alias("one_key"))
    texts = _of_keys(texts, wanted.select(F.xxhash64("one_id", "one_key").alias("key")), chosen.count())
    ready = texts.join(wanted, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key"))).select("cluster", "block", "node", "docs", "grams", "sig", "text")
    with_set = T.StructType([*ready.drop("text").schema.fields, T.StructField("set", T.BinaryType())])

    def add_sets(batches):
        for batch in batches:
            sets = pa.array([g.tobytes() for g in gram_sets(batch["text"].to_pylist(), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in with_set.names[:-1]], sets], names=with_set.names)

    blocks = written(ready.mapInArrow(add_sets, with_set).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "node").mapInArrow(_packed, _BLOCK))
    split = blocks.where(F.col("block") != WHOLE)
    sides = F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    signed = split.select("cluster", "block", "sigs").join(_block_pairs(homes).select("cluster", "i", "j", sides), ["cluster", "block"])
    alive = signed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block").mapInArrow(_plausible_blocks, _PAIR)
    whole = blocks.where(F.col("block") == WHOLE).withColumns({"i": F.col("block"), "j": F.col("block")})
    tasks = whole.unionByName(split.join(alive.select("cluster", "i", "j", sides), ["cluster", "block"]))
    found = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])
    verified = written(tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block").mapInArrow(_verified, found))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = written(classes.select("node", "set_id", "docs").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Written first, so that the join sees two shuffles and a very large component can be split.
    least = written(of_class.groupBy("root").agg(F.min("set_id").alias("class_id")))
    of_class = of_class.join(least, "root").select("node", "set_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    out = known.select("doc_id", "text_key", "node").join(of_class, "node", "left")
    own = F.col("node").isNull()
    return out.select(
        "doc_id", "text_key", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (own | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), F.when(own, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
    )


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of df whose document stays: that with the smallest id of each group of linked ones.

    Rows that repeat both id and text stay or go together (exact deduplication comes first).
    """
    goes = jaccard_join(df, id_col, text_col, words).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same_text = F.unhex(F.sha1(F.coalesce(df[text_col].cast("string"), F.lit("")))) == goes["__key"]
    return df.join(goes, df[id_col].eqNullSafe(goes["__id"]) & same_text, "left_anti")
