"""Exact dedup, Jaccard join, packing and tokens against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import bayes_jaccard, grace_dedup, slack_packing, streaming_viterbi, token_attribution
from blockloom.llm.bpe import WordBpe, vocabulary_path
from blockloom.llm.components import components

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a  b"), (5, "a\tb"), (6, "a b"), (6, "a b"), (None, "a b"), (7, "x" * 200_000), (8, "é \U0001f600 z"), (9, "a b ")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_marks_equal_brute_force(spark):
    rows = ODD + [(100 + k, "copy of\nit") for k in range(40)]
    got = grace_dedup.mark(spark.createDataFrame(rows, DOCS)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t in rows:
        ids = groups[norm(t)]
        want.append((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept, key=repr) == sorted([1, 3, 4, 7, 8, 9, 100], key=repr)  # repeated rows: one stays


def test_exact_keep_passes_clashing_columns_through(spark):
    df = spark.createDataFrame([(k, f"t{k % 3}", k, str(k), 1.5) for k in range(30)], "doc_id long, text string, _h long, _n string, c0 double")
    kept = grace_dedup.keep(df)
    assert kept.schema == df.schema
    assert sorted(map(tuple, kept.collect())) == [(k, f"t{k}", k, str(k), 1.5) for k in range(3)]
    assert grace_dedup.keep(df.limit(0)).count() == 0 and grace_dedup.mark(df.limit(0)).count() == 0


def test_grace_spills_and_recurses():
    rng = random.Random(1)
    texts = [f"text {rng.randrange(3000)} " + "y" * 200 for _ in range(12_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 500)), pa.array(texts[k : k + 500])], ["id", "text"]) for k in range(0, 12_000, 500)]
    local = list(grace_dedup.combine(iter(batches), "id", "text", 40_000))
    out = list(grace_dedup.grace(iter(local), "id", "text", 30_000))
    assert len(out) > 16  # several buckets, some of them dealt again
    got = {t: (i, n) for b in out for i, t, n in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["_n"].to_pylist())}
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert got == {t: (min(i), len(i)) for t, i in want.items()} and sum(b.num_rows for b in out) == len(want)


def test_equal_hashes_are_told_apart_by_content():
    table = grace_dedup.ContentTable(8)
    assert table.entry(5, b"a") == (0, True) and table.entry(5, b"b") == (1, True) and table.entry(21, b"c") == (2, True) and table.entry(5, b"b") == (1, False)
    same = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "b"]), pa.array([7, 7]), pa.array([1, 1])], ["id", "text", "_h", "_n"])
    assert sum(b.num_rows for b in grace_dedup.grace(iter([same] * 50), "id", "text", 100)) == 2  # bits used up: folded together


def jaccard_by_hand(rows, words=5):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset())
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    seen = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            for j in near:
                seen[i] = seen[j] = min(seen[i], seen[j], key=lambda k: rows[k][0])
    return links, [rows[k][0] for k in seen]


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "one two three four five")]
    passage = [word() for _ in range(30)]
    for k in range(12):
        base = [word() for _ in range(90)]
        for c in range(8):
            copy = list(base)
            for _ in range(c // 2):
                copy[rng.randrange(90)] = word()
            rows.append((100 * k + c + 10, " ".join(copy + (passage if c % 3 == 0 else []))))
    links, component = jaccard_by_hand(rows)
    for bucket, members, least, blocks in ((4096, 256, 64, 40), (3, 3, 2, 3), (4096, 1, 1, 40)):  # also with buckets and clusters split into blocks
        for name, value in (("BUCKET", bucket), ("CLUSTER_MEMBERS", members), ("BLOCK_LEAST", least), ("BLOCKS", blocks), ("FEW_WANTED", 10**6 if members > 3 else 0), ("FILTERED", 0 if members == 1 else 10**9)):
            monkeypatch.setattr(bayes_jaccard, name, value)
        got = {r["doc_id"]: r for r in bayes_jaccard.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()}
        for (i, _), near, c in zip(rows, links, component):
            assert (got[i]["n_links"], got[i]["class_id"], got[i]["kept"]) == (len(near), c, i == c), i


def test_a_chain_of_texts_compares_few_pairs_of_blocks(spark, monkeypatch):
    """Each text shares 95 of 100 words with the next: one cluster, but only blocks that share a bucket meet."""
    monkeypatch.setattr(bayes_jaccard, "CLUSTER_MEMBERS", 8)
    monkeypatch.setattr(bayes_jaccard, "BLOCK_LEAST", 4)
    seen = []
    pairs = bayes_jaccard._block_pairs
    monkeypatch.setattr(bayes_jaccard, "_block_pairs", lambda homes: (seen.append((pairs(homes).count(), homes.select("cluster", "block").distinct().count())), pairs(homes))[1])
    rows = [(k, " ".join(f"w{x}" for x in range(5 * k, 5 * k + 100))) for k in range(240)]
    links, component = jaccard_by_hand(rows)
    got = {r["doc_id"]: r for r in bayes_jaccard.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(got[k]["n_links"], got[k]["class_id"]) for k, _ in rows] == [(len(near), c) for near, c in zip(links, component)] and len(set(component)) == 1
    n_pairs, n_blocks = seen[0]
    assert n_blocks >= 10 and n_pairs < n_blocks * (n_blocks + 1) / 4


def test_the_filter_of_keys_passes_all_wanted_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(bayes_jaccard, "FEW_WANTED", 0)
    texts = spark.range(20_000).select("id", F.unhex(F.sha1(F.col("id").cast("string"))).alias("text_key"))
    wanted = texts.where("id % 4 = 1")
    got = {r["id"] for r in bayes_jaccard._of_keys(texts, wanted.select(F.xxhash64("id", "text_key").alias("key")), 5000).collect()}
    assert {k for k in range(20_000) if k % 4 == 1} <= got and len(got) < 5000 + 0.04 * 15_000


def test_jaccard_keep_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text, 5, 0), (2, text + " more", 6, 0), (3, "", 7, 0), (4, None, 8, 0), (None, "lonely text of its own here", 9, 0)], "doc_id long, text string, node long, __id long")
    assert sorted(r["node"] for r in bayes_jaccard.keep(df).collect()) == [5, 7, 8, 9]
    assert bayes_jaccard.keep(df).columns == df.columns
    assert bayes_jaccard.jaccard_join(df.limit(0)).count() == 0
    assert bayes_jaccard.jaccard_join(df.where("doc_id = 3")).first()["n_links"] == 0


def test_jaccard_of_very_long_and_repeated_texts(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long), (2, long.replace("w77 ", "x ")), (2, long.replace("w77 ", "x ")), (3, " ".join(f"v{k}" for k in range(90_000))), (None, long)]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in bayes_jaccard.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 0, True), (None, 1, 3, False)], key=repr)


def test_bayes_rules_keep_pairs_at_the_threshold():
    rules = bayes_jaccard.least_matches()
    assert [n for n, _ in rules] == list(range(32, 161, 32)) and all(0 < m < 0.8 * n for n, m in rules)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (2000, 160), dtype=np.uint8)
    agree = rng.random((2000, 160)) < 0.8
    b = np.where(agree, a, rng.integers(0, 256, (2000, 160), dtype=np.uint8))
    kept = sum(len(bayes_jaccard.plausible(a[k : k + 1], b[k : k + 1], rules)[0]) for k in range(2000))
    far = sum(len(bayes_jaccard.plausible(a[k : k + 1], a[k + 1 : k + 2], rules)[0]) for k in range(1999))
    assert kept == 2000 and far == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 140)} == {100} and {got[k] for k in (200, 201, 202)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["", " ", "\n", "a", " lead", "trail ", "two  blanks", "line\nline\n\nnext\n x", "tab\tin\r\nit", "it's we'll 12ab,.!", "é ß\U0001f600　z", "\x00nul \x00 x", "<|endoftext|>", "hi <|endoftext|> you<|endoftext|><|endoftext|>\n", "<|endoftext|", "x" * 3000, "word " * 2000]


def test_ids_equal_the_tokenizer_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    texts = TEXTS + [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, bounds = WordBpe().encode(texts)
    for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k][:50]


def test_packing_is_gapless_whole_and_close_to_the_bound(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a"), (3, "a"), (99, None)] + [(1000 + k, "some words " * (k * 7 % 400)) for k in range(150)]
    df = spark.createDataFrame(rows, DOCS)
    got = slack_packing.pack(df, ids=True).collect()
    bpe, total = WordBpe(), 0
    want = defaultdict(int)
    for i, t in rows:
        ids = [*bpe.encode([t or ""])[0].tolist(), 2]
        total += len(ids)
        a, b = 0, len(ids) % 1024 or min(1024, len(ids))
        k = 0
        while a < len(ids):
            bits = np.array(ids[a:b], "<u4").tobytes()
            want[i, k, a, b - a, zlib.crc32(bits), bits] += 1
            a, b, k = b, b + 1024, k + 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 2
    assert slack_packing.pack(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 AS piece", "'x' AS part", "2 AS rank", "3 AS length", "4 AS sequence_id")
    places = lambda rows: sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert places(slack_packing.pack(clash).collect()) == places(got)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_combination_equals_brute_force(seed):
    rng = random.Random(seed)
    room = rng.randrange(5, 40)
    counts = [0] * (room + 1)
    for _ in range(rng.randrange(1, 6)):
        counts[rng.randrange(1, room + 1)] += rng.randrange(1, 3)
    sums = {0}
    for length, n in enumerate(counts):
        for _ in range(n):
            sums |= {s + length for s in sums}
    best = slack_packing.fullest(list(counts), room)
    assert sum(k * n for k, n in best.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in best.items())


def test_plan_uses_every_piece_and_repeats_in_bulk():
    plan = slack_packing.bin_plan({1024: 10**9, 700: 10**9, 324: 10**9, 5: 3})
    used = defaultdict(int)
    for chosen, bins in plan:
        assert sum(k * n for k, n in chosen.items()) <= 1024
        for k, n in chosen.items():
            used[k] += n * bins
    assert used == {1024: 10**9, 700: 10**9, 324: 10**9, 5: 3} and sum(b for _, b in plan) == 2 * 10**9 + 1
    assert slack_packing.bin_plan({}) == []


def test_token_counts_by_line_equal_offsets_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = [(k, x) for k, x in enumerate(TEXTS)] + [(50, None)]
    got = defaultdict(dict)
    for r in token_attribution.count_tokens(spark.createDataFrame(rows, DOCS)).collect():
        got[r["doc_id"]][r["section"]] = r["n_tokens"]
    for i, x in rows:
        x = x or ""
        spans = token_attribution.line_sections(x)
        assert "".join(x[a:b] for a, b in spans) == x
        want = dict.fromkeys(range(len(spans)), 0)
        for s, e in t.encode(x, add_special_tokens=False).offsets:
            held = [min(e, b) - max(s, a) for a, b in spans]
            want[max(range(len(spans)), key=lambda k: (held[k], -k))] += 1
        assert got[i] == want, x[:40]


def test_tokens_that_cross_boundaries_follow_the_rule(spark):
    df = spark.createDataFrame([(1, "hello wonderful", [(0, 8), (8, 12)]), (2, "hello", []), (3, None, None)], "doc_id long, text string, spans array<struct<start:long,end:long>>")
    majority = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in token_attribution.count_tokens(df, spans_col="spans").collect()}
    first = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in token_attribution.count_tokens(df, spans_col="spans", rule="first").collect()}
    assert majority == {(1, 0): (1, 0), (1, 1): (1, 1), (2, -1): (1, 0)}
    assert first == {(1, 0): (2, 1), (1, 1): (0, 0), (2, -1): (1, 0)}
    with pytest.raises(ValueError):
        token_attribution.count_tokens(df, rule="other")


def test_odd_sections_and_tables(spark):
    schema = "doc_id long, text string, spans array<struct<start:long,end:long>>, section string, n_tokens int"
    rows = [
        (1, "hello wonderful", [(8, 15), None, (0, 8)], "x", 7),  # unsorted, a null span
        (1, "hello wonderful", [(8, 15), None, (0, 8)], "x", 7),  # a repeated row
        (2, "hello wonderful", [(None, 4), (3, None), (9, 2)], None, None),  # all absent
        (3, "hello wonderful", [(0, 15), (5, 15)], "y", 1),  # the first ends where the second begins
        (4, "hello", [(-3, 100)], "z", 1), (5, "next text", [(0, 9)], "z", 1),  # reaches no neighbour
        (6, "", [(0, 3)], "w", 1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in token_attribution.count_tokens(df, spans_col="spans").select("doc_id", "section", "start", "end", "n_tokens").collect()), key=repr)
    one = [(1, 0, 8, 15, 1), (1, 1, None, None, 0), (1, 2, 0, 8, 1)]
    want = one + one + [(2, -1, 0, 0, 2), (2, 0, None, 4, 0), (2, 1, 3, None, 0), (2, 2, 9, 2, 0), (3, 0, 0, 15, 1), (3, 1, 5, 15, 1), (4, 0, -3, 100, 1), (5, 0, 0, 9, 2), (6, 0, 0, 3, 0)]
    assert got == sorted(want, key=repr)
    assert token_attribution.count_tokens(df.limit(0), spans_col="spans").count() == token_attribution.count_tokens(df.limit(0)).count() == 0
    by_line = token_attribution.count_tokens(df)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in by_line.collect()) == [(0, 0), (1, 2), (1, 2), (2, 2), (3, 2), (4, 1), (5, 2), (6, 0)]


def full_viterbi(model, text):
    s = streaming_viterbi.MARK + text.replace(" ", streaming_viterbi.MARK)
    best = [(0.0, None, None)]
    for e in range(1, len(s) + 1):
        top = None
        for b in range(max(0, e - model.longest), e):
            p = model.pieces.get(s[b:e])
            if p and (top is None or best[b][0] + p[1] > top[0]):
                top = (best[b][0] + p[1], b, [p[0]])
        if s[e - 1] not in model.pieces and (top is None or best[e - 1][0] + model.unknown > top[0]):
            top = (best[e - 1][0] + model.unknown, e - 1, [model.byte_ids[x] for x in s[e - 1].encode()])
        best.append(top)
    out, e = [], len(s)
    while e:
        out.append(best[e][2])
        e = best[e][1]
    return [i for ids in reversed(out) for i in ids]


def test_streaming_viterbi_equals_the_whole_table():
    from array import array

    model, rng = streaming_viterbi.PieceModel(), random.Random(5)
    texts = [x[:2500] for x in TEXTS if x and "\x00" not in x] + ["".join(rng.choice("aeinrst  \nüß") for _ in range(300)) for _ in range(20)]
    for x in texts:
        assert list(array("I", model.encode(x))) == full_viterbi(model, x), x[:40]
        assert model.decode(model.encode(x)) == x
    stream, out = model.stream(), []
    for c in streaming_viterbi.MARK + ("abcdefghij" * 500):
        out += stream.feed(c)
        assert len(stream.back) <= 2 * model.longest  # the window, whatever the length
    assert out + stream.finish() == full_viterbi(model, "abcdefghij" * 500)


@pytest.mark.parametrize("piece", ["a\u2581b", "a\n", "\n\n", "\u2581\n"])
def test_models_whose_pieces_cross_stretches_are_refused(piece, monkeypatch):
    import sentencepiece

    class Model(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return piece if i == 300 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="run across"):
        streaming_viterbi.PieceModel()


def test_sentencepiece_tables(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)] + [(None, None), (1, " ")], DOCS)
    coded = streaming_viterbi.encode(df)
    assert all(r["round_trip"] for r in coded.collect())
    assert {r["doc_id"]: r["text"] for r in streaming_viterbi.decode(coded.where("doc_id > 3")).collect()} == {k: x for k, x in enumerate(TEXTS) if k > 3}
    for r in coded.where("doc_id > 3").collect():
        assert len(r["ids"]) == 4 * r["n_ids"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and zlib.crc32(TEXTS[r["doc_id"]].encode()) == r["decoded_crc32"]
    assert streaming_viterbi.encode(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "'x' AS ids", "1 AS n_ids", "2 AS round_trip")
    assert sorted(map(repr, streaming_viterbi.encode(clash).collect())) == sorted(map(repr, coded.collect()))
