"""Both classifiers against plain loops: gradient, description, features, prediction, whole operator."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from blockloom.llm import pu_learning, quality_pu, queries, toxicity_pu

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("prior, shift", [(0.1, 0.0), (0.5, 1.0), (0.9, -6.0)])
def test_gradient_equals_finite_differences(prior, shift):
    rng = np.random.default_rng(7)
    gp, gu = rng.normal(1, 1, 12), rng.normal(shift, 1, 15)
    cp, cu = rng.dirichlet(np.ones(12)), rng.dirichlet(np.ones(15))
    negative = pu_learning.nn_pu_risk(gp, gu, prior, cp, cu)[1]
    assert (negative < 0) == (shift < -1)  # the last case is the one that is held back

    def value(g):
        positive, part = pu_learning.nn_pu_risk(g[:12], g[12:], prior, cp, cu)
        return positive + part if negative >= 0 else -part

    g, step = np.concatenate([gp, gu]), 1e-6
    slopes = [(value(g + step * e) - value(g - step * e)) / (2 * step) for e in np.eye(27)]
    assert np.allclose(pu_learning.nn_pu_gradient(gp, gu, prior, cp, cu), slopes, atol=1e-7)


def described(text):
    """quality_pu.NAMES by their definitions, word by word."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * len(quality_pu.NAMES)
    chars = "".join(w)
    lines = [x for x in text.split("\n") if x]
    signs = lambda x: [c for c in x if not c.isalpha() and not c.isdigit()]
    share = lambda test: sum(map(test, w)) / n
    runs = lambda k: [tuple(w[i : i + k]) for i in range(n - k + 1)] or [tuple(w)]
    tail = lambda x: len(signs(x)) > 1 and len(x) > 2 and not x[-1].isalnum() and not x[-2].isalnum()
    return [
        math.log1p(n), len(set(w)) / n, (max(Counter(w).values()) - 1) / n, len(chars) / n, sum(map(str.isalpha, chars)) / len(chars), sum(map(str.isdigit, chars)) / len(chars), len(signs(chars)) / len(chars),
        share(lambda x: len(x) > 1 and sum(map(str.isalpha, x)) > 1 and x.isupper()), share(lambda x: len(signs(x)) == len(x)), share(tail), share(lambda x: len(x) <= 3), share(lambda x: x[0].isupper()),
        sum(a == b for a, b in zip(w, w[1:])) / max(1, n - 1), sum(a == b for a, b in zip(w, w[2:])) / max(1, n - 2), len(set(runs(2))) / len(runs(2)), len(set(runs(5))) / len(runs(5)),
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), math.log1p(len(text)),
    ]


def toxic_features(text, index):
    """Kept features of a text by their definition."""
    held = Counter()
    for w in {toxicity_pu.bare(x) for x in text.split()} - {""}:
        held.update({"=" + w, *(w[:k] for k in range(3, 8) if k <= len(w))})
    return {f for f in index if held[f] or f[-2:] in ("*2", "*3") and held[f[:-2]] >= int(f[-1])}


TEXTS = ["", "one", "one two", "one two three four", "a a a a a", "Hi!! THERE... 12 3x\nline\nline", "é ß\t\U0001f600", "w " * 5000]


def test_descriptions_equal_their_definitions(spark):
    texts = TEXTS + [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = quality_pu.describe(texts)
    for text, row in zip(texts, got):
        assert np.allclose(row, described(text)), text[:60]


@pytest.mark.parametrize("name, op, mod, rest, threshold", [("op1_quality_pu", quality_pu, 5, 0, 0.3), ("op6_toxicity_pu", toxicity_pu, 3, 1, 0.7)])
def test_registered_query_equals_a_plain_loop(spark, name, op, mod, rest, threshold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = op.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        if op is quality_pu:
            steps = []
            for x, knots in zip(described(text), model.knots):
                low = [knots[0] - 1, *knots[:-1]]
                steps += [min(1.0, max(0.0, (x - a) / max(b - a, 1e-9))) for a, b in zip(low, knots)]
            value = sum(a * b for a, b in zip(steps, model.weights)) + model.intercept
        else:
            value = sum(model.weights[model.index[f]] for f in toxic_features(text, model.index)) + model.intercept
        want = 1 / (1 + math.exp(-value))
        have = got[r["doc_id"]]
        assert have["score"] == pytest.approx(want, abs=1e-9)
        assert have["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and have["predicted"] == int(have["score"] >= threshold)


def test_a_tiny_table_is_learnt_and_held_out_labels_are_not_read(spark):
    mine = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, ("quiet words about trees " * 3) + ("you vile grumbo" if k % 4 == 0 else f"and rivers {k}")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = [(k, int(k % 4 == 0) if k in set(mine) else 1 - int(k % 4 == 0)) for k in range(400)]  # held-out labels are all wrong
    model = toxicity_pu.train(docs, spark.createDataFrame(table, "doc_id long, toxic int"))
    assert "=grumbo" in model.index and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in toxicity_pu.score(docs, model).collect())


@pytest.mark.parametrize("op, label", [(quality_pu, "quality"), (toxicity_pu, "toxic")])
@pytest.mark.parametrize("value", [0, 1])
def test_one_sided_labels_give_the_prior(spark, op, label, value):
    docs = spark.createDataFrame([(k, f"some text {k}") for k in range(60)], "doc_id long, text string")
    table = spark.createDataFrame([(k, value) for k in range(60)], f"doc_id long, {label} int")
    assert {r["score"] for r in op.score(docs, op.train(docs, table)).collect()} == {float(value)}


def test_the_sample_is_bounded_and_repeated_ids_count_once(spark):
    docs = spark.range(3000).selectExpr("id % 1000 AS doc_id", "concat('text ', id % 1000) AS text")
    table = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    sample, prior = pu_learning.training_sample(docs, table, "toxic", 3, 1, 50, 80)
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    assert n == {True: 50, False: 80} and 0.4 < prior < 0.6 and sample.distinct().count() == 130
