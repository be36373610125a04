"""Every registered corpus query over a whole small table, against brute force."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from blockloom.llm import crf_secrets, quality_pu, queries, streaming_viterbi
from blockloom.llm.bpe import vocabulary_path

from .test_dedup_and_packing import full_viterbi, jaccard_by_hand, norm
from .test_models_and_archives import brute_cosine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_op2(spark, docs, tokenizer):
    got = defaultdict(int)
    for r in queries.QUERIES["op2_token_attribution"](spark, SF).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in docs}


def test_op3(spark, docs):
    links, component = jaccard_by_hand(docs)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_bayes_jaccard"](spark, SF).collect()}
    assert {i: (r["n_links"], r["class_id"]) for i, r in got.items()} == {i: (len(near), c) for (i, _), near, c in zip(docs, links, component)}


def pieces_of(rows, tokenizer):
    """The contract's pieces: doc_id, piece, start, length, crc of the ids."""
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        a, b, k = 0, len(ids) % 1024 or min(1024, len(ids)), 0
        while a < len(ids):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            a, b, k = b, b + 1024, k + 1
    return out


def check_packing(rows, got, tokenizer):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(pieces_of(rows, tokenizer))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_op4(spark, docs, tokenizer):
    got = queries.QUERIES["op4_slack_packing"](spark, SF).collect()
    assert check_packing(docs, got, tokenizer) <= -(-sum(r["length"] for r in got) // 1024) + 5


def test_op5(spark, docs):
    model = streaming_viterbi.piece_model()
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_streaming_viterbi"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        t = t or ""
        ids = list(array("I", bytes(got[i]["ids"])))
        assert model.decode(bytes(got[i]["ids"])) == t and got[i]["round_trip"] and got[i]["n_ids"] == len(ids) and got[i]["decoded_crc32"] == zlib.crc32(t.encode())
        if 0 < len(t) < 700:
            assert ids == full_viterbi(model, t)


def test_op8(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    top = {}
    for i, data in pages:
        top[data] = max(i, top.get(data, i))
    want = []
    for i, data in pages:
        response = top[data] if len(data) >= 1000 else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if response == i else "revisit", None if response == i else response))
    got = queries.QUERIES["op8_warc_index"](spark, SF).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)


def test_op9(spark, docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[norm(t)].append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in queries.QUERIES["op9_grace_dedup"](spark, SF).collect()) == want


def test_op10(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op10_cover_tree"](spark, SF).collect())) == sorted(brute_cosine(rows, 0.98))


def chain_by_hand(rows, kept, crf):
    """(id, text) after all stages but packing: what quality keeps, one of equal texts, one of near copies, masked."""
    rows = [(i, t) for i, t in rows if kept(t)]
    first = {}
    for i, t in rows:
        k = norm(t)
        if k not in first or (i is not None and (first[k][0] is None or i < first[k][0])):
            first[k] = (i, t)
    rows = sorted(first.values(), key=lambda r: (r[0] is None, r[0]))
    _, component = jaccard_by_hand(rows)
    out = []
    for (i, t), c in zip(rows, component):
        if i == c:
            masked, end = [], 0
            for s, e, _ in crf_secrets.found_spans([t or ""], crf)[0]:
                if s >= end:
                    masked += [(t or "")[end:s], "[secret]"]
                end = max(end, e)
            out.append((i, "".join(masked) + (t or "")[end:]))
    return out


def test_pipeline_on_an_odd_table_equals_brute_force(spark, tmp_path, tokenizer):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    near = words(60)
    texts = [words(40) for _ in range(60)] + [near, near + " one", near + " two", "same  text here", "same text here", "same text\nhere", "long " * 30_000 + words(2000), "a secret = 'Abcd1234Efgh' in " + words(20)]
    texts += ["!! !! !!", "?? ?? ?? ??", "junk junk junk junk junk"] * 8
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, None), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", None if i % 5 else "s", None if i % 7 else len(t or ""), i, "x", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, __id string, score double")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k < 68)) for k in range(len(texts))] + [(None, 1), (7, None)], "doc_id long, quality int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, table = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    model = quality_pu.train(table, labels)
    kept = lambda t: model.scores([t or ""])[0] >= quality_pu.THRESHOLD
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-2]:
        out = stage(spark, docs, sf)
        assert out.columns == table.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    crf = crf_secrets.train(docs)
    want = chain_by_hand(rows, kept, crf)
    assert 20 < len(want) < len(rows) - 20
    check_packing(want, corpus_pipeline.run(spark, sf).collect(), tokenizer)
    empty = spark.createDataFrame([], table.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
