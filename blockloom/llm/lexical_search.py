"""Ranked lexical search: the best documents for each item, scored in whole numbers by dense matrix products.

All documents are split once for a block of items: a row keeps its number of terms and how often it holds
each term of the block's vocabulary. N, L and the document frequencies are sums over those rows, so over all
documents. Then tasks score tiles of documents: the impacts of a tile's terms (dense, documents x terms) times
the items' weights (dense, terms x items), both whole numbers held in float64, by BLAS. Terms are dealt to
tiles in such a way that no partial sum of any item can reach 2^53, so that every product is exact, and the
tiles' sums are added as 64-bit integers. Of a tile, only terms that some of its documents hold take part.
Each task keeps every item's best k by (score, id), ties by the smaller id, so tiles and tasks may be cut
anywhere; the tasks' bests meet in two steps.

Items are taken in blocks whose terms, with repeats, are at most `BLOCK_TERMS`; only a block's distinct
terms and weights go to the driver and to all tasks (a few MB; an item is never split, so one with more terms is a block of its own). Further blocks read the documents again.

Defined results: null and empty texts have no terms; such documents don't count, such items have no rows;
null ids rank after all others among equal scores; repeated documents and items are documents and items like
others (an item_id that repeats, null included, is one item with the terms of all its rows); texts of any
length are read whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import prefix_sums
from .shared import text_or_empty, written

TOP = 20
#: Terms of a block of items, documents and terms of a tile.
BLOCK_TERMS, TILE_DOCS, TILE_TERMS = 50_000, 512, 1024
#: Cells of a dense tile; with many items, tiles have fewer documents and terms.
TILE_CELLS = 2_000_000
#: Sums of float64 below this are exact.
EXACT = 1 << 53
#: No impact reaches this: 10^9 tf div (1000 tf + 12 m) with m > 0.
MOST_IMPACT = 1_000_000
SLOTS = 64
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A to Z in lower case, as UTF-8."""
    return text.encode().translate(_TABLE).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> tuple[DataFrame, list[int]]:
    """block, item_id, term, qtf of all items, written, and the numbers of the blocks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                found, n = np.unique(np.array(terms(text), object), return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(found)), pa.array(found.tolist(), pa.binary()), pa.array(n, pa.int64())], names=["item_id", "term", "qtf"])

    slim = items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text"))
    schema = slim.select("item_id", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("qtf")).schema
    each = written(slim.mapInArrow(split, schema).groupBy("item_id", "term").agg(F.sum("qtf").alias("qtf")))
    # Items lie in the order of the first bits of their ids' hashes; those that share them share a block.
    sizes = each.groupBy(F.xxhash64("item_id").alias("hash")).agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftright("hash", 40))
    totals = prefix_sums(sizes.groupBy("range").agg(F.sum("n").alias("n")), "range", "n", "before")
    blocks = totals.select("range", F.floor(F.col("before") / block_terms).alias("block"))
    placed = written(each.withColumn("range", F.shiftright(F.xxhash64("item_id"), 40)).join(blocks, "range").select("block", "item_id", "term", "qtf"))
    return placed, sorted(r["block"] for r in placed.select("block").distinct().collect())


@dataclass
class Block:
    """The items of a block: ids, vocabulary, and weights (how often an item holds a term) as coordinates."""

    ids: list
    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    qtf: np.ndarray
    id_type: pa.DataType

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        ids = rows["item_id"].combine_chunks().dictionary_encode("encode")
        words = rows["term"].combine_chunks().dictionary_encode()
        vocabulary = {w: k for k, w in enumerate(words.dictionary.to_pylist())}
        return cls(ids.dictionary.to_pylist(), vocabulary, np.asarray(ids.indices, np.int64), np.asarray(words.indices, np.int64), np.asarray(rows["qtf"], np.int64), rows.schema.field("item_id").type)


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms), terms and tfs (of the vocabulary) of each document that has a term."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = slim.select("doc_id", F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("terms"), F.array().cast("array<int>").alias("tfs")).schema
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most BLOCK_TERMS words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for batch in batches:
            keep, n, ends, found, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column(1)):
                split = terms(text.as_py())
                if split:
                    codes = np.array([c for c in map(find, split) if c is not None], np.int32)
                    mine, tf = np.unique(codes, return_counts=True)
                    keep.append(k)
                    n.append(len(split))
                    found.append(mine)
                    tfs.append(tf.astype(np.int32))
                    ends.append(ends[-1] + len(mine))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=schema.names)

    return slim.mapInArrow(work, schema)


def term_tiles(weights: np.ndarray, item: np.ndarray, term: np.ndarray, n_items: int, most: int = TILE_TERMS, exact: int = EXACT) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Coordinates (item, term, weight) dealt to tiles of neighbouring terms whose sums stay exact for every item.

    A weight that alone could reach the bound is split into several, of tiles of their own.
    """
    limit = (exact - 1) // MOST_IMPACT
    tiles = []
    while len(weights):
        part = np.minimum(weights, limit)  # what is left of a larger weight goes on to the next round of tiles
        order = np.argsort(term, kind="stable")
        i, t, w = item[order], term[order], part[order]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        sums, begin = np.zeros(n_items, np.int64), 0
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(t)])):
            if k and ((sums[i[a:b]] + w[a:b] > limit).any() or t[a] - t[begin] >= most):
                tiles.append((i[begin:a], t[begin:a], w[begin:a]))
                sums[:], begin = 0, a
            sums[i[a:b]] += w[a:b]
        tiles.append((i[begin:], t[begin:], w[begin:]))
        left = weights > part
        item, term, weights = item[left], term[left], (weights - part)[left]
    return tiles


def tile_scores(starts: np.ndarray, codes: np.ndarray, impacts: np.ndarray, tiles: list, n_items: int, n_terms: int) -> np.ndarray:
    """documents x items: exact scores of documents given as rows (starts) of codes and impacts."""
    n_docs = len(starts) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    out = np.zeros((n_docs, n_items), np.int64)
    column = np.full(n_terms, -1)
    for item, term, weight in tiles:
        low = term[0]
        near = np.flatnonzero((codes >= low) & (codes <= term[-1]))
        present = np.unique(codes[near])
        if not len(present):
            continue
        column[present] = np.arange(len(present))
        held = column[term] >= 0
        impact, weights = np.zeros((n_docs, len(present))), np.zeros((len(present), n_items))
        impact[doc[near], column[codes[near]]] = impacts[near]
        weights[column[term[held]], item[held]] = weight[held]
        column[present] = -1
        out += (impact @ weights).astype(np.int64)
    return out


class Best:
    """The k best (score, id) of each item: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n_items)], np.zeros(n_items, np.int64)

    def add(self, scores: np.ndarray, ids: list) -> None:
        """A score equal to an item's k-th may still win by its id, so only lower ones are passed over."""
        hopeful = (scores > 0) & (scores >= self.least)
        for item in np.flatnonzero(hopeful.any(0)):
            column = scores[:, item]
            near = np.flatnonzero(hopeful[:, item])
            if len(near) > self.k:  # all that reach the k-th score of the tile, ties included
                near = near[column[near] >= np.partition(column[near], len(near) - self.k)[-self.k]]
            rows = self.rows[item] + [(-int(column[d]), ids[d] is None, ids[d]) for d in near]
            self.rows[item] = sorted(rows, key=lambda r: r[:2] if r[1] else r)[: self.k]
            if len(self.rows[item]) == self.k:
                self.least[item] = -self.rows[item][-1][0]


def scored(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """slot, item, doc_id, score: each task's best documents of each item (by number). docs: as counted, written."""
    sums = docs.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    total, length = sums["N"], sums["L"]
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # one for each word of the block
        df[r["term"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    n_items, n_terms = len(block.ids), len(df)
    tile_docs, tile_terms = (min(most, max(16, TILE_CELLS // n_items)) for most in (TILE_DOCS, TILE_TERMS))
    tiles = docs.sparkSession.sparkContext.broadcast(term_tiles(block.qtf * weight[block.term], block.item, block.term, n_items, tile_terms))
    schema = docs.select(F.lit(0).alias("slot"), F.lit(0).alias("item"), "doc_id", F.lit(0).cast("long").alias("score")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, slot, id_type = Best(n_items, top), 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, tile_docs):
                part = batch.slice(at, tile_docs)
                starts, n = np.concatenate([[0], np.cumsum(part.column(2).value_lengths())]), np.asarray(part.column(1), np.int64)
                tfs = np.asarray(part.column(3).flatten(), np.int64)
                m = 100 - 25 + (25 * n * total) // length
                impacts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, np.diff(starts)))
                best.add(tile_scores(starts, np.asarray(part.column(2).flatten()), impacts, tiles.value, n_items, n_terms), part.column(0).to_pylist())
                slot = (slot * 31 + int(n.sum())) % SLOTS
        rows = [(slot, item, r[2], -r[0]) for item, kept in enumerate(best.rows) for r in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), id_type, pa.int64()))], names=schema.names)

    return docs.mapInArrow(work, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    placed, blocks = item_blocks(items, item_col, item_text_col, block_terms)
    found = None
    for k in blocks:
        block = Block.of(placed.where(F.col("block") == k).drop("block").toArrow())
        rows = written(counted(docs, block.vocabulary, id_col, text_col))
        if rows.isEmpty():
            break
        best = scored(rows, block, top)
        for groups in (["item", "slot"], ["item"]):
            order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, block.id_type)}))
        named = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        found = named if found is None else found.unionByName(named)
    if found is None:
        empty = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("score")).limit(0)
        return empty.join(items.select(F.col(item_col).alias("item_id")).limit(0), F.lit(False)).select("item_id", "rank", "doc_id", "score")
    return found


SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
    s AS (SELECT count(*) AS total, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
    t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, total),
    r AS (SELECT item_id, doc_id, CAST(sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // length)))) AS BIGINT) AS score FROM t JOIN f USING (term) JOIN q USING (term), s GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
