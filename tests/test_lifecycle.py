"""The pool's life-cycle: a stream in several runs against a plain loop over all rows."""

import random

from blockloom.streaming import changes, lifecycle

SCHEMA = "sender long, seq long, kind string, nonce long, id long, max_fee long"


def by_hand(rows):
    """All events, from the rules as they are written: standing is worked out anew after each row."""
    out, pools, next_, told = [], {}, {}, {}
    for sender, seq, kind, nonce, id_, fee in sorted(rows, key=lambda r: r[1]):
        pool, step = pools.setdefault(sender, {}), []
        first = next_.setdefault(sender, 0)
        if kind == "submit":
            if nonce < first or (nonce in pool and fee * 100 < pool[nonce][1] * 110):
                step.append((id_, "refused"))
            else:
                if nonce in pool:
                    step.append((pool[nonce][0], "replaced"))
                pool[nonce] = (id_, fee)
        elif kind == "drop":
            for n in [n for n in pool if pool[n][0] == id_]:
                del pool[n]
                step.append((id_, "discarded"))
        elif nonce >= first:
            for n in sorted(pool):
                if n <= nonce:
                    step.append((pool[n][0], "discarded" if n == nonce and pool[n][0] != id_ else "mined"))
                    del pool[n]
            next_[sender] = nonce + 1
        for n in sorted(pool):
            now = "pending" if all(m in pool for m in range(next_[sender], n)) else "queued"
            if told.get(pool[n][0]) != now:
                told[pool[n][0]] = now
                step.append((pool[n][0], now))
        out += [(sender, seq, k, i, e) for k, (i, e) in enumerate(step)]
    return sorted(out)


def test_rules():
    s = lifecycle.Sender()
    assert s.take("submit", 1, 11, 100) == [(11, "queued")] and s.take("submit", 0, 10, 100) == [(10, "pending"), (11, "pending")]
    assert s.take("submit", 0, 12, 109) == [(12, "refused")] and s.take("submit", 0, 13, 110) == [(10, "replaced"), (13, "pending")]
    assert s.take("drop", 0, 13, 0) == [(13, "discarded"), (11, "queued")] and s.take("drop", 0, 13, 0) == []
    assert s.take("included", 0, 99, 0) == [(11, "pending")] and s.take("submit", 0, 14, 900) == [(14, "refused")]
    assert s.take("included", 1, 98, 0) == [(11, "discarded")] and s.next == 2 and not s.waiting


def test_a_stream_in_several_runs(spark, tmp_path):
    rng, rows, ids = random.Random(8), [], 0
    for seq in range(400):
        sender, kind = rng.randrange(6), rng.choice(["submit"] * 6 + ["drop", "included"])
        ids += 1
        mine = [r for r in rows if r[0] == sender and r[2] == "submit"]
        pick = rng.choice(mine) if mine and kind != "submit" else None
        if kind != "submit" and pick is None:
            continue
        rows.append((sender, seq, kind, pick[3] if pick else rng.randrange(12), pick[4] if pick else ids, rng.randrange(90, 130)))
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for a, b in ((0, 150), (150, 151), (151, 400)):
        part = [r for r in rows if a <= r[1] < b]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        got = changes.run_once(lifecycle.events(spark.readStream.schema(SCHEMA).parquet(source)), path)
    assert sorted(map(tuple, got.select("sender", "seq", "step", "id", "event").collect())) == by_hand(rows)
    last = {i: e for _, _, _, i, e in sorted(by_hand(rows), key=lambda r: r[1:3])}
    assert {r["id"]: r["event"] for r in lifecycle.standing(got).collect()} == last
