"""Ranked search in whole numbers, against a plain loop."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import lexical_search, queries

from ..compare import connect, rows, sql_rows
from .test_decontamination import DOCS, ITEMS, LOWER

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(docs, items, top=20):
    held = [(i, w) for i, t in docs if (w := split(t))]
    total, length, df = len(held), sum(len(w) for _, w in held), Counter(t for _, w in held for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(split(text))
    out = []
    for item, query in asked.items():
        best = []
        for doc, w in held:
            tf, m, score = Counter(w), 75 + (25 * len(w) * total) // length, 0
            for t, q in query.items():
                if tf[t]:
                    score += q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score:
                best.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(best, key=lambda r: r[:3])[:top])]
    return sorted(out, key=repr)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_and_sql(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = queries.QUERIES["op13_lexical_search"](spark, SF)
    assert listed(got) == by_hand(docs, items)
    assert rows(got) == sql_rows(connect(SF), queries.ORACLES["op13_lexical_search"])[1]


def test_odd_tables_small_tiles_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"n": F.lit(1), "score": F.lit("s"), "terms": F.lit(0)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit(1))
    want = by_hand(DOCS, ITEMS)
    assert listed(lexical_search.search(docs, items)) == want
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 2)
    monkeypatch.setattr(lexical_search, "TILE_TERMS", 3)
    assert listed(lexical_search.search(docs.repartition(3), items, block_terms=4)) == want
    assert listed(lexical_search.search(docs.repartition(3), items, top=2)) == by_hand(DOCS, ITEMS, 2)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text IS NULL"), items), (docs, items.where("text IS NULL"))):
        assert lexical_search.search(a, b).collect() == []


def test_ties_across_tiles_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 7)
    rows_ = [((k * 37) % 500, "same words here" if k % 5 else "same words here and more") for k in range(500)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(6)
    assert listed(lexical_search.search(docs, spark.createDataFrame([(1, "words here")], "item_id long, text string"))) == by_hand(rows_, [(1, "words here")])


def test_partial_sums_stay_exact():
    """Weights near and beyond the bound, with the largest impacts; every tile's sum is below the bound."""
    rng = np.random.default_rng(3)
    n_terms, n_items = 40, 6
    item, term = (x.reshape(-1) for x in np.meshgrid(np.arange(n_items), np.arange(n_terms)))
    weight = rng.integers(1, 12_000_000_000, len(term))
    tiles = lexical_search.term_tiles(weight, item, term, n_items, 16)
    seen = np.zeros((n_items, n_terms), np.int64)
    for i, t, w in tiles:
        sums = np.zeros(n_items, np.int64)
        np.add.at(sums, i, w)
        assert (sums * (lexical_search.MOST_IMPACT - 1) < lexical_search.EXACT).all() and t.max() - t.min() < 16
        np.add.at(seen, (i, t), w)
    assert (seen == weight.reshape(n_terms, n_items).T).all()
    codes = np.tile(np.arange(n_terms), 3)
    impacts = rng.integers(900_000, lexical_search.MOST_IMPACT, len(codes))
    got = lexical_search.tile_scores(np.arange(4) * n_terms, codes, impacts, tiles, n_items, n_terms)
    want = [[sum(int(a) * int(b) for a, b in zip(impacts[d * n_terms : (d + 1) * n_terms], seen[i])) for i in range(n_items)] for d in range(3)]
    assert got.tolist() == want
