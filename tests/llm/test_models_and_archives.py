"""Classifiers, secret scan, archives, vectors and the pipeline: small exact cases and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import bayes_jaccard, cover_tree, crf_secrets, grace_dedup, pu_learning, quality_pu, slack_packing, toxicity_pu, warc_index
from blockloom.llm.shared import shared_dir

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.1"


def accuracy(rows, labels, at):
    held = [(r["predicted"], labels[r["doc_id"]][at]) for r in rows if r["held_out"] and labels.get(r["doc_id"], (None, None))[at] is not None]
    return sum(p == y for p, y in held) / len(held)


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_held_out_accuracy(spark, labels):
    docs, table = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    quality = quality_pu.score(docs, quality_pu.train(docs, table)).collect()
    toxic = toxicity_pu.score(docs, toxicity_pu.train(docs, table)).collect()
    assert len(quality) == len(toxic) == docs.count()
    assert accuracy(quality, labels, 0) > 0.97 and accuracy(toxic, labels, 1) > 0.96
    for rows, mod, rest in ((quality, 5, 0), (toxic, 3, 1)):
        for r in rows[:500]:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1
        assert all(r["predicted"] == int(r["score"] >= (0.3 if mod == 5 else 0.7)) for r in rows)


@pytest.mark.parametrize("op", [quality_pu, toxicity_pu])
def test_scores_of_odd_rows_and_without_labels(spark, op):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "plain words here", "z"), (3, "plain words here", "z"), (None, "plain words here", "q"), (5, "w " * 100_000, "r")], "doc_id long, text string, score string")
    label = "quality" if op is quality_pu else "toxic"
    table = spark.createDataFrame([(3, 1), (3, None), (None, 1), (5, 0), (1, 0)], f"doc_id long, {label} int")
    for labels_ in (table, table.limit(0)):
        rows = op.score(docs, op.train(docs, labels_)).collect()
        assert len(rows) == 6 and all(r["score"] is not None and r["held_out"] is not None for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert all(len(s) == 1 for s in by.values()) and by[None] == by[3]
        assert op.score(docs.limit(0), op.train(docs.limit(0), labels_)).count() == 0


def test_quality_keep_has_all_columns_and_the_scores_decisions(spark):
    docs, table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_pu.train(docs, table)
    want = {r["doc_id"] for r in quality_pu.score(docs, model).where("predicted = 1").collect()}
    kept = quality_pu.keep(docs, model)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_nn_pu_finds_the_negatives_without_labels():
    rng = np.random.default_rng(2)
    positive, negative = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    unlabelled = np.vstack([positive[2000:2600], negative[:1400]])  # prior 0.3
    w, b = pu_learning.fit_nn_pu(positive[:2000], unlabelled, 0.3)
    assert (positive[3000:] @ w + b > 0).mean() > 0.97 and (negative[2000:] @ w + b < 0).mean() > 0.97
    assert pu_learning.nn_pu_risk(np.array([5.0]), np.array([-5.0]), 0.9, np.ones(1), np.ones(1))[1] < 0  # the part that is held at zero


def test_secret_patterns():
    text = "token=short; PASSWORD : 'Abcd1234+/' AKIA" + "Z" * 11 + " AKIA" + "B" * 12 + " " + "0a" * 16 + "g"
    kinds = [(k, text[s:e]) for s, e, k, _ in crf_secrets.pattern_spans(text)]
    assert kinds == [("assign", "PASSWORD : 'Abcd1234+/"), ("access", "AKIA" + "B" * 12), ("hex", "0a" * 16)]
    assert crf_secrets.pattern_spans("") == []
    # a match that is too short still takes its characters, as in the unfiltered search
    assert crf_secrets.pattern_spans("token:secret = abcdefgh1234") == []


def naive_viterbi(crf, unary):
    best = max(np.ndindex(*[3] * len(unary)), key=lambda t: crf.start[t[0]] + sum(unary[k][x] for k, x in enumerate(t)) + sum(crf.trans[a, b] for a, b in zip(t, t[1:])))
    return list(best)


@pytest.fixture(scope="module")
def crf():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    lines = []
    for k in range(400):
        text = " ".join(word() for _ in range(12))
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        lines += crf_secrets.training_windows(text + (f" token = \"{secret}\" " if k % 2 else f" {rng.randrange(10**6)} ") + text, k)
    return crf_secrets.Crf().fit(lines, steps=80)


def test_crf_adds_secrets_that_no_pattern_knows(crf):
    text = "plain words before\nsome key = \"Zx81kQpW04nVbT72LmRs\" and words after\nnothing here 12345"
    spans = crf_secrets.found_spans([text, "only plain words in here", ""], crf)
    assert [text[s:e] for s, e, k in spans[0] if k == "crf"] == ["Zx81kQpW04nVbT72LmRs"] and spans[1:] == [[], []]


def test_viterbi_and_the_bound_equal_full_decoding(crf):
    rng = np.random.default_rng(3)
    for _ in range(20):
        unary = rng.normal(0, 3, (rng.integers(1, 7), 3))
        assert crf.viterbi(unary) == naive_viterbi(crf, unary)
    pick = random.Random(9)
    texts = ["\n".join(" ".join(pick.choice(["word", "token", "=", "\"Ab12Cd34Ef56Gh78\"", "12345", "x@y.z", "it's", "key:", "9f8e7d6c5b4a39281706"]) for _ in range(pick.randrange(0, 9))) for _ in range(pick.randrange(0, 5))) for _ in range(200)]
    some = 0
    for x, got in zip(texts, crf.spans(texts)):
        every = range(x.count("\n") + 1)
        file = crf.doubtful([x])[0][1]
        assert got == crf.decode(x, [k for k in every if crf_secrets.TOKEN.search(x.split("\n")[k])], file)
        some += len(got)
    assert some > 50


def test_crf_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    unary, trans, start = rng.normal(0, 1, (4, 1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    mask = np.array([[True], [True], [True], [False]])
    marginal, pairs = crf_secrets._marginals(unary, trans, start, mask)
    total = np.zeros((3, 3))
    both, z = np.zeros((3, 3)), 0.0
    for t in np.ndindex(3, 3, 3):
        p = math.exp(start[t[0]] + sum(unary[k, 0, x] for k, x in enumerate(t)) + trans[t[0], t[1]] + trans[t[1], t[2]])
        z += p
        for k, x in enumerate(t):
            total[k, x] += p
        both[t[0], t[1]] += p
        both[t[1], t[2]] += p
    assert np.allclose(marginal[:3, 0], total / z) and np.allclose(pairs, both / z)


def test_scan_and_redact_tables(spark):
    rows = [(1, None, 0, "s"), (2, "", 0, "s"), (3, "password=abcdefgh12 x", 21, "s"), (3, "password=abcdefgh12 x", 21, "s"), (None, "AKIA" + "Q" * 16, 20, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string")
    model = crf_secrets.train(docs)
    got = crf_secrets.digest(crf_secrets.scan(docs, model)).collect()
    assert sorted(((r["doc_id"], r["n_assign"], r["n_access"]) for r in got), key=repr) == sorted([(1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (None, 0, 1)], key=repr)
    clean = crf_secrets.redact(docs, model)
    assert clean.schema == docs.schema
    assert sorted((r["text"] or "", r["n_chars"]) for r in clean.collect()) == [("", 0), ("", 0), ("[secret]", 8), ("[secret] x", 10), ("[secret] x", 10)]
    assert crf_secrets.scan(docs.limit(0), crf_secrets.train(docs.limit(0))).count() == 0


def test_url_keys():
    assert warc_index.url_key("http://www.Example.org:80/A?Q=1") == "org,example)/a?q=1"
    assert warc_index.url_key("https://a.b.c:8443") == "c,b,a:8443)/"
    assert warc_index.url_key(None) == ")/" and warc_index.url_key("http://[bad") == "http://[bad"


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 3000)  # several archives and index files
    long, other = "<p>é" * 500, "<b>" + "y" * 1200
    rows = [(1, "http://a.org/x", long), (2, "http://a.org/y", long), (9, "http://b.org/", long), (3, None, None), (4, "http://a.org/x", "short"), (5, "http://c.org/\r\n\r\n", "short"), (None, "http://n.org/", other), (7, "http://n.org/", other), (8, "http://d.org/", "a\r\n\r\nb" + "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc_index.build_index(warc_index.write_archives(pages, shared_dir(spark)), shared_dir(spark), per_block=2)
    got = {r["page_id"]: r for r in warc_index.look_up(directory, pages).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r, data = got[i], (html or "").encode()
        same = [k for k, _, h in rows if h == html]
        response = max((k for k in same if k is not None), default=None) if len(data) >= 1000 else i
        assert r["payload_bytes"] == len(data) and r["refers_to"] == (response if response != i else None)
        assert r["record_type"] == ("response" if response == i else "revisit")
        assert bytes(r["payload"]) == (data if response == i else b"")
    asked = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    assert sorted(r["page_id"] for r in warc_index.look_up(directory, asked("https://www.a.org/x", "http://a.org/x")).collect()) == [1, 4]
    assert warc_index.look_up(directory, asked("http://missing.org/", "http://zz.zz/", "http://a.a/")).count() == 0 and directory.count() >= 5
    empty = warc_index.archive(spark, pages.limit(0))
    assert warc_index.look_up(empty, pages).count() == 0 and warc_index.look_up(directory, asked()).count() == 0


def test_look_ups_open_no_block_without_a_wanted_key(spark):
    """All other blocks are overwritten: what is wanted is found all the same, and their keys are an error."""
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://host', id % 40, '.org/', id % 50) AS url", "concat('page ', id) AS html")
    directory = warc_index.build_index(warc_index.write_archives(pages, shared_dir(spark)), shared_dir(spark), per_block=5)
    wanted = "http://host7.org/7"
    key, spoilt = warc_index.url_key(wanted), 0
    for r in directory.collect():
        if not r["first_key"] <= key <= r["last_key"]:
            path = "/" + r["file"].split(":", 1)[-1].lstrip("/")
            with open(path, "r+b") as file:
                file.seek(r["offset"])
                file.write(b"\0" * r["length"])
            spoilt += 1
    assert spoilt > 70
    got = warc_index.look_up(directory, spark.createDataFrame([(wanted,)], "url string")).collect()
    assert sorted(r["page_id"] for r in got) == [k for k in range(400) if k % 40 == 7 and k % 50 == 7]
    with pytest.raises(Exception):
        warc_index.look_up(directory, pages.where("page_id = 0")).collect()


def test_a_hot_url_spans_parts_and_odd_pages_keep_their_rows(spark):
    same = [(k, "http://hot.org/", f"<p>{k % 3}" + "z" * 1500) for k in range(300)]
    odd = [(7, "http://hot.org/", "<p>1" + "z" * 1500), (7, "http://hot.org/", "<p>1" + "z" * 1500), (900, None, "x" * 3_000_000), (901, "\u00e4.example/\U0001f600?q=1 2", None), (None, None, "y" * 1200)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in same + odd], "page_id long, url string, html string, key string, offset int")
    found = warc_index.look_up(warc_index.build_index(warc_index.write_archives(pages, shared_dir(spark)), shared_dir(spark), per_block=7), pages, payloads=False).collect()
    assert sorted((r["page_id"] if r["page_id"] is not None else -1 for r in found)) == sorted(r[0] if r[0] is not None else -1 for r in same + odd)
    top = {f"<p>{c}": max(k for k, _, h in same if h.startswith(f"<p>{c}")) for c in range(3)}
    for r in found:
        html = next((h for k, _, h in same + odd if k == r["page_id"]), None) or ""
        response = top[html[:4]] if html.startswith("<p>") else r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response == r["page_id"] else ("revisit", response)) and r["payload"] is None


def brute_cosine(rows, t):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = {k: 0 for k in range(len(rows))}
    comp = list(range(len(rows)))
    pairs = []
    for i, (a, v, label) in enumerate(rows):
        for j, (b, w, other) in enumerate(rows):
            if i != j and a is not None and b is not None and label is not None and label == other and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= t:
                    links[i] += 1
                    pairs.append((i, j))
    for _ in rows:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j], key=lambda k: rows[k][0])
    return [(a, links[k], rows[comp[k]][0], rows[comp[k]][0] == a) for k, (a, _, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [8192, 20, 7])
def test_vectors_equal_brute_force(spark, block):
    rng, rows = np.random.default_rng(block), []
    for label in (1, 2):
        centers = rng.normal(0, 1, (6, 8))
        for k in range(90):
            spread = (0.02, 0.15, 1.0)[k % 3]
            rows.append((label * 1000 + k, (centers[k % 6] + rng.normal(0, spread, 8)).astype(np.float32).tolist(), label))
    rows += [(5000 + k, rows[3][1], 1) for k in range(5)] + [(5000, rows[3][1], 1)]  # copies, and a repeated row
    rows += [(1, None, 1), (2, [0.0] * 8, 1), (3, [1.0, None] + [0.0] * 6, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [1.0] * 7, 1), (6, rows[0][1], None), (7, [], 1), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (None, rows[0][1], 1), (10, [float(np.float32(2.0 * x)) for x in rows[0][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit("clash"), "cell": F.lit(1)})
    got = [tuple(r) for r in cover_tree.near_duplicates(df, block=block, sample=64).collect()]
    assert sorted(got, key=repr) == sorted(brute_cosine(rows, 0.98), key=repr)
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_far_cells_are_never_paired(spark):
    """Tight groups far apart: the tree over all vectors grows several levels, and its leaves meet near ones only."""
    rng, rows = np.random.default_rng(8), []
    for k in range(64):
        center = rng.normal(0, 1, 16)
        rows += [(100 * k + c, (center + rng.normal(0, 0.01, 16)).astype(np.float32).tolist(), "1.5") for c in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    known = cover_tree.vectors(df).selectExpr("node", "1 AS n", "label", "dim", "raw")
    leaves, levels = cover_tree.cells(known, 60, 400)
    assert levels and leaves.count() == len(rows) and leaves.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 60
    tops = known.select(cover_tree.top_cell().alias("cell")).distinct()
    n, pairs = leaves.select("cell").distinct().count(), cover_tree.near_cells(tops, levels, 0.2).collect()
    assert len(pairs) < 0.2 * n * (n + 1) / 2 and len(set(pairs)) == len(pairs) and sum(p["a"] == p["b"] for p in pairs) == n
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, block=60, sample=400).collect()}
    want = {i: (links, c) for i, links, c, _ in brute_cosine(rows, 0.98)}
    assert got == want and min(w[0] for w in want.values()) >= 24


def test_cover_tree_is_nested_and_covers():
    x = np.random.default_rng(1).normal(0, 1, (400, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.CoverTree(x)
    stack = [tree.root]
    while stack:
        node = stack.pop()
        assert np.linalg.norm(x[node.members] - x[node.center], axis=1).max() <= node.radius + 1e-7
        if len(node.members) > 10:
            children = tree.children(node)
            assert children[0].center == node.center and sorted(np.concatenate([c.members for c in children])) == sorted(node.members)
            assert all(c.level <= node.level / 2 and c.radius <= c.level for c in children)
            stack += children


def test_pipeline_stages_equal_their_operators(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    raw = docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == raw.columns
        if name == "exact_dedup":
            assert ids == {r["doc_id"] for r in grace_dedup.mark(before).where("kept").collect()} and docs.count() == len(ids)
        if name == "near_dedup":
            assert ids == {r["doc_id"] for r in bayes_jaccard.jaccard_join(before).where("kept").collect()}
        if name == "secrets":
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
            assert not any(crf_secrets.pattern_spans(r["text"] or "") for r in docs.select("text").collect())
        if name == "packing":
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {slack_packing.CAPACITY}").isEmpty()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
