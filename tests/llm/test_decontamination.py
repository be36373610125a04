"""Benchmark windows in documents, against a plain loop."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontamination, queries

from ..compare import connect, rows, sql_rows

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = split(text)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in {len(g) for g in windows}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[g]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_and_sql(spark):
    table = lambda name: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select({"documents": "doc_id", "benchmark": "item_id"}[name], "text").collect()]
    got = queries.QUERIES["op12_decontamination"](spark, SF)
    assert listed(got) == by_hand(table("documents"), table("benchmark")) and any(r["contaminated"] for r in got.collect())
    assert rows(got) == sql_rows(connect(SF), queries.ORACLES["op12_decontamination"])[1]


ITEMS = [(7, "short Hit"), (70, "ONE two three four five six seven eight nine ten eleven"), (8, None), (9, "..."), (8, ""), (70, "another ONE"), (None, "lonely words"), (10, "short hit"), (11, "straße ÄÖ")]
DOCS = [
    (1, "Alpha one two, three! four five; six seven eight nine TEN end"), (1, None), (None, "x ÄÖ one"), (2, ""), (3, "short Hit here short hit."), (3, "short Hit here short hit."), (4, "short short hit hit short\nhit"),
    (5, "straße ÄÖ straße äö"), (6, "LONELY\x00words Ünd K lonely Words"), (8, "one two three four five six seven eight nine ten eleven one two three"), (9, "... !!! ,"), (12, "w" * 300_000 + " short hit"),
    (13, "one two three four five six seven eight nine ten " * 3000), (14, "two three four five six seven eight nine ten"),
]


@pytest.fixture
def odd(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"digest": F.lit("d"), "spans": F.lit(0), "row": F.lit("r"), "w": F.lit(1.5)})
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hash", F.lit(1))


def test_odd_tables(spark, odd):
    docs, items = odd
    assert listed(decontamination.report(docs, items)) == by_hand(DOCS, ITEMS)
    assert listed(decontamination.report(docs, items, 3)) == by_hand(DOCS, ITEMS, 3)
    assert listed(decontamination.report(docs, items.limit(0))) == by_hand(DOCS, [])
    assert decontamination.report(docs.limit(0), items).count() == 0


def test_blocks_of_hashes_give_the_same(odd, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 1)
    assert listed(decontamination.report(*odd)) == by_hand(DOCS, ITEMS)


def test_removal(odd):
    docs, items = odd
    kept = decontamination.decontaminate(docs, items)
    clean = {r[0:1] + (r[1],) for r in by_hand(DOCS, ITEMS) if not r[5]}
    assert kept.columns == docs.columns and {(r["doc_id"], len(split(r["text"]))) for r in kept.collect()} == clean and kept.count() == sum(not r[5] for r in by_hand(DOCS, ITEMS))
    rest = decontamination.decontaminate(docs, items, "spans")
    texts = {}
    for r in rest.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert rest.columns == docs.columns and rest.count() == len(DOCS)
    assert texts[1] == ["Alpha end", None] or texts[1] == [None, "Alpha end"]
    assert texts[3] == ["here ", "here "] and texts[4] == ["short hit "] and texts[None] == ["x ÄÖ one"] and texts[2] == [""] and texts[9] == ["... !!! ,"] and texts[13] == [""]
    again = [r[2] for r in by_hand([(r["doc_id"], r["text"]) for r in rest.collect()], ITEMS)]
    assert len(again) == len(DOCS)
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "lines")


def test_no_python_on_the_way(spark):
    plan = queries.QUERIES["op12_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and not any(x in plan for x in ("Python", "Arrow", "MapIn", "CartesianProduct", "NestedLoop"))
