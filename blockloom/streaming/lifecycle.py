"""What happens to transactions in the pool, from a stream of submissions, drops and included blocks.

The stream is keyed by groups of senders, so that a call takes the rows of many and fetches and keeps their state at
once; a sender's state is its next nonce and the transactions that wait for it, so it is bounded by the pool's
limits. Only groups that have rows in a micro-batch are read and written. Rows of one micro-batch are taken in the order of `seq`, whatever files they
come from; across batches seq must not go back for a sender.

Input rows: seq, kind, sender, nonce, id, max_fee. Kinds: submit; drop (id); included (all nonces up to nonce
are in a block; id names the transaction that was). Output rows: seq, step, id, event:

* pending or queued: added, and whether all nonces before it are there; again whenever that changes;
* replaced: another transaction with the same nonce took its place, its fee higher by the bump at least;
* refused: it didn't bid enough to replace, or its nonce is in a block already;
* mined: it is the one that was included; discarded: another with its nonce was, or it was dropped.

A transaction that goes takes its successors back to queued; they stay in the pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .assembly import STATE_STORE

BUMP = 10
#: Groups of senders; a checkpoint is bound to their number.
GROUPS = 8192
EVENTS = "sender long, seq long, step int, id long, event string"


class Sender:
    """The waiting transactions of one sender: nonce -> id, fee, and whether it was last told to be pending."""

    def __init__(self, next_nonce: int = 0, waiting: dict[int, tuple[int, int, bool]] | None = None):
        self.next, self.waiting = next_nonce, waiting or {}

    def take(self, kind: str, nonce: int, id_: int, fee: int) -> list[tuple[int, str]]:
        """The events of one row, in order."""
        out = []
        if kind == "submit":
            old = self.waiting.get(nonce)
            if nonce < self.next or (old and fee * 100 < old[1] * (100 + BUMP)):
                return [(id_, "refused")]
            if old:
                out.append((old[0], "replaced"))
            self.waiting[nonce] = (id_, fee, None)
        elif kind == "drop":
            gone = next((n for n, w in self.waiting.items() if w[0] == id_), None)
            if gone is None:
                return []
            del self.waiting[gone]
            out.append((id_, "discarded"))
        elif nonce >= self.next:
            for n in sorted(n for n in self.waiting if n <= nonce):
                mine = self.waiting.pop(n)[0]
                out.append((mine, "mined" if mine == id_ or n < nonce else "discarded"))
            self.next = nonce + 1
        return out + self._moved()

    def _moved(self) -> list[tuple[int, str]]:
        """Those whose standing has changed, by nonce."""
        out, expected = [], self.next
        for n in sorted(self.waiting):
            id_, fee, told = self.waiting[n]
            ready = n == expected
            expected += ready
            if ready != told:
                self.waiting[n] = (id_, fee, ready)
                out.append((id_, "pending" if ready else "queued"))
        return out


class Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        # A row for each sender in senders and nexts, for each waiting transaction in the others (of: its sender's place).
        self.state = handle.getValueState("state", "senders array<long>, nexts array<long>, of array<long>, nonces array<long>, ids array<long>, fees array<long>, told array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, pool, batch = [], self._held(), pd.concat(list(rows)).sort_values(["sender", "seq"], kind="stable")
        columns = [batch[c].tolist() for c in ("sender", "seq", "kind", "nonce", "id", "max_fee")]
        for who, mine in groupby(zip(*columns), key=itemgetter(0)):
            sender = pool.setdefault(who, Sender())
            for _, seq, kind, nonce, id_, fee in mine:
                for step, (about, event) in enumerate(sender.take(kind, nonce, id_, fee)):
                    out.append((who, seq, step, about, event))
        waiting = [(place, nonce, *w) for place, sender in enumerate(pool.values()) for nonce, w in sorted(sender.waiting.items())]
        self.state.update((list(pool), [s.next for s in pool.values()], *([w[k] for w in waiting] for k in range(5))))
        yield pd.DataFrame(out, columns=["sender", "seq", "step", "id", "event"]).astype({"sender": "int64", "seq": "int64", "step": "int32", "id": "int64", "event": object})

    def _held(self) -> dict[int, Sender]:
        if not self.state.exists():
            return {}
        senders, nexts, *waiting = self.state.get()
        pool = [Sender(int(n)) for n in nexts]
        for place, nonce, id_, fee, told in zip(*waiting):
            pool[place].waiting[int(nonce)] = (int(id_), int(fee), bool(told))
        return dict(zip((int(s) for s in senders), pool))

    def close(self) -> None:
        pass


def events(stream: DataFrame) -> DataFrame:
    """Streaming: sender, seq, step, id, event."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = stream.select("sender", "seq", "kind", "nonce", "id", "max_fee", F.pmod(F.xxhash64("sender"), F.lit(GROUPS)).alias("group"))
    return keyed.groupBy("group").transformWithStateInPandas(Lifecycle(), EVENTS, "append", "none")


def standing(told: DataFrame) -> DataFrame:
    """id, event: what each transaction was told last."""
    return told.groupBy("id").agg(F.max_by("event", F.struct("seq", "step")).alias("event"))
