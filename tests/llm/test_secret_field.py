"""The secret scan on whole tables: base spans by brute force, and planted secrets that only the field can find."""

import hashlib
import random
import re

import pytest

from blockloom.llm import crf_secrets, queries

SF = "/root/testdata/sf0.001"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def base_spans(text):
    """The contract's base spans, word for word."""
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0) if len(m[group]) >= least]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(out)]


ODD = [None, "", "token=short", "x" * 300_000 + " secret = 'abcdefgh12' ", "é\U0001f600 AKIA" + "A" * 12 + "0" * 31, "0f" * 16 + "G" + "0f" * 15, "token:secret = abcdefgh1234", "passWORD\"  :  'a+/=_.-9", "AKIAAKIA" + "Z" * 10]


def test_base_spans_of_tables_equal_brute_force(spark, tmp_path):
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(1, ""), (None, ODD[6])], "doc_id long, text string")
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    for sf in (SF, f"file://{tmp_path}"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        want = []
        for r in docs.collect():
            spans = base_spans(r["text"] or "")
            want.append((r["doc_id"], *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(spans).encode()).hexdigest()))
        got = queries.QUERIES["op7_crf_secrets"](spark, sf).collect()
        assert sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
        texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id IS NOT NULL").collect()}
        assert all(set(base_spans(texts[r["doc_id"]])) <= set(r["spans"].split(",")) for r in got if r["doc_id"] is not None)


@pytest.fixture(scope="module")
def model(spark):
    return crf_secrets.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_planted_secrets_that_no_pattern_knows(spark, model):
    """Precision and recall over documents with planted values, and clean ones with look-alikes."""
    rng = random.Random(11)
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    secret = [
        lambda: ("Authorization: Bearer ", draw(LOWER + UPPER + DIGITS, 40)), lambda: ('pwd => "', draw(LOWER + UPPER + DIGITS, 20)), lambda: ("credentials: '", draw(LOWER + DIGITS, 24)), lambda: ("the access key is ", draw(UPPER + DIGITS, 32)),
        lambda: ("auth = ", draw("ABCDEF" + DIGITS, 40)), lambda: ("login pass: ", draw(LOWER + UPPER + DIGITS, 18)), lambda: ('private key = "', draw(LOWER + UPPER + DIGITS + "+/", 44)), lambda: ("bearer ", ".".join(draw(LOWER + UPPER + DIGITS, n) for n in (20, 40, 30))),
    ]
    plain = [
        lambda: "released on 2023-05-17 as v2.11.3", lambda: "see docs/guide/chapter12 for more", lambda: f"call 555-{draw(DIGITS, 4)} or +49 30 {draw(DIGITS, 7)}", lambda: f"order A{draw(DIGITS, 6)} shipped", lambda: f"mail john.{draw(LOWER, 5)}@example.org today",
        lambda: f"https://example.org/{draw(LOWER, 6)}/{draw(LOWER, 8)}?page={draw(DIGITS, 2)}", lambda: "the secret of a good password is its length", lambda: "token economies and key results", lambda: f"ISBN 978-3-16-{draw(DIGITS, 6)}-0",
    ]
    base = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 50 AND 1500").orderBy("doc_id").collect()]
    base = [t for t in base if not base_spans(t)]
    rows, planted = [], {}
    for k in range(800):
        lines = base[k % len(base)].split("\n")
        at = rng.randrange(len(lines) + 1)
        if k % 2:
            before, planted[k] = secret[k % len(secret)]()
            while base_spans(before + planted[k]):
                before, planted[k] = secret[k % len(secret)]()
            lines.insert(at, f"{draw(LOWER, 5)} {before}{planted[k]} {draw(LOWER, 4)}")
        else:
            lines.insert(at, plain[k % len(plain)]())
        rows.append((k, "\n".join(lines)))
    found = crf_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    texts, hits, added = dict(rows), 0, 0
    for r in found:
        values = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["found"] if s["kind"] == "crf"]
        added += len(values)
        hits += planted.get(r["doc_id"]) in values
    precision, recall = hits / max(1, added), hits / len(planted)
    print(f"planted secrets: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.95 and recall > 0.9


def test_forms_that_no_code_draws(spark, model):
    """Values and look-alikes of forms that neither training nor the test above plants; two forms are not found (see README)."""
    rng = random.Random(5)
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    hexes = "0123456789abcdef"
    secret = {
        "url": lambda: ("clone https://bot:", draw(LOWER + UPPER + DIGITS, 20), "@git.example.org/repo"), "connection": lambda: ("Server=db1;User Id=app;Pwd=", draw(LOWER + UPPER + DIGITS, 16), ";Timeout=30"),
        "key line": lambda: ("-----BEGIN PRIVATE KEY----- ", draw(LOWER + UPPER + DIGITS + "+/", 64), " -----END PRIVATE KEY-----"), "header": lambda: ("X-Auth-Key: ", draw(LOWER + DIGITS, 31), ""),
    }
    plain = [
        lambda: f"session {draw(hexes, 8)}-{draw(hexes, 4)}-4{draw(hexes, 3)}-a{draw(hexes, 3)}-{draw(hexes, 12)} ended", lambda: f"fixed in commit {draw(hexes, 12)} by review", lambda: f"src data:image/png;base64,{draw(LOWER + UPPER + DIGITS, 60)} alt",
        lambda: f"pay to DE{draw(DIGITS, 20)} today", lambda: f"serial number {draw(UPPER + DIGITS, 12)} of the device",
    ]
    base = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 50 AND 1500").orderBy("doc_id").collect()]
    base, rows, planted = [t for t in base if not base_spans(t)], [], {}
    for k in range(240):
        lines = base[k % len(base)].split("\n")
        if k % 2:
            form = list(secret)[k // 2 % len(secret)]
            value = secret[form]()
            planted[k] = form, value[1]
            lines.insert(rng.randrange(len(lines) + 1), "".join(value))
        else:
            lines.insert(rng.randrange(len(lines) + 1), plain[k // 2 % len(plain)]())
        rows.append((k, "\n".join(lines)))
    hits, texts = dict.fromkeys(secret, 0), dict(rows)
    for r in crf_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        values = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["found"]]
        if r["doc_id"] in planted:
            form, value = planted[r["doc_id"]]
            hits[form] += value in values
        else:
            assert not values
    assert all(n >= 24 for n in hits.values()), hits  # of 30 each


def test_windows_lose_no_token_and_keep_their_neighbours():
    text = " ".join(f"w{k}" for k in range(205)) + ' token = "abcdefgh1234" end\nshort line'
    windows = crf_secrets.training_windows(text, 1, window=50, copies=0)
    assert [len(w.tags) for w in windows] == [50, 50, 50, 50, 11, 2] and sum(crf_secrets.B in w.tags for w in windows) == 1
    assert windows[1].signatures[:2] == windows[0].signatures[-3:-1] and windows[0].signatures[-1] == windows[1].signatures[2]
    assert any(windows[4].near) and not any(windows[0].near)


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id % 500 AS doc_id", "CASE WHEN id % 500 < 100 THEN concat('token = abcdefgh1234', id % 500) ELSE concat('plain words 12 ', id % 500) END AS text")
    seen = []
    monkeypatch.setattr(crf_secrets.Crf, "fit", lambda self, windows, steps: seen.extend(windows) or self)
    crf_secrets.train(docs, max_marked=20, max_plain=30, max_windows=40)
    marked = [w for w in seen if crf_secrets.B in w.tags]
    assert len(marked) == 80 and 0 < len(seen) - len(marked) <= 80
