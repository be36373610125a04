"""Whitening against numpy over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def by_hand(vectors):
    """Deviations, shares of the variance, and whitened rows up to each component's sign."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, len(e))
    return ((n * x - s) ** 2).sum(1), (e / e.sum())[:k], centred @ u[:, :k] / np.sqrt(e[:k])


def check(rows, ids, vectors):
    deviation, shares, y = by_hand(vectors)
    k, got = len(shares), np.zeros((len(ids), len(shares)))
    place = {v: i for i, v in enumerate(ids)}
    assert len(rows) == len(ids) * k and len({(r["vec_id"], r["component"]) for r in rows}) == len(rows)
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["n"] == len(ids) and r["deviation"] == deviation[i] and abs(r["explained"] / shares[c] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-8
    assert np.abs(got - y * np.sign((got * y).sum(0))).max() < 1e-7


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries.QUERIES["op11_whitening"](spark, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_a_hot_vector_and_rows_that_do_not_count(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 3, 5).tolist() if i % 3 else [1.0, -2.0, 0.5, 0.25, 9.0]) for i in range(4500)]
    bad = [(9001, None), (9002, []), (9003, [1.0, None, 2.0, 3.0, 4.0]), (9004, [float("nan")] * 5), (9005, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (9006, [1.0, 2.0])]
    df = spark.createDataFrame(bad[:3] + good + bad[3:], "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "key": F.lit("x")}).repartition(5)
    out = whitening.listed(*whitening.whiten(df))
    check(out.collect(), [i for i, _ in good], [v for _, v in good])
    distinct = whitening.distinct_vectors(whitening.keyed(df))
    assert distinct.count() == 3001 and distinct.agg(F.max("n")).first()[0] == 1500


def test_fit_with_weights_of_one(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [5.0, 3.0])], "vec_id long, embedding array<float>")
    rows, model, error = whitening.whiten(df, weights="one")
    assert (model.n, model.sums) == (3, [7 * 64, 4 * 64]) and error < 1e-9 and rows.count() == 4
    assert whitening.whiten(df)[1].n == 4
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="rank")


def test_no_variance_no_rows_extreme_entries(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (None, [2.0, 3.0])]):
        assert whitening.listed(*whitening.whiten(make(rows))).count() == 0
    got = whitening.listed(*whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (None, [0.0, 0.0])]))).collect()
    assert {r["vec_id"] for r in got} == {1, 2, None} and all(r["deviation"] is None for r in got if r["vec_id"])
    flat = whitening.listed(*whitening.whiten(make([(k, [float(k), 1.0, 2.0 * k]) for k in range(9)]))).collect()
    assert {r["component"] for r in flat} == {1}  # one direction only


def test_exact_numbers_beyond_64_bits():
    model = whitening.Fit(10**9, [10**9, -(10**9)], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[1, -1], [5, 3]])) == [0, None]
    assert whitening.unpack([whitening.pack(np.array(x)) for x in ([1, -127], [300, -5], [1 << 40, 0])]).tolist() == [[1, -127], [300, -5], [1 << 40, 0]]
