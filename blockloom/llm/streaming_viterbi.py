"""SentencePiece encoding and decoding by Viterbi search over a stream of characters.

The public model's pieces and scores are read from its file; a text becomes a blank marker and its
characters, blanks made markers, and its ids are those of the segmentation with the largest sum of
scores, a character that no piece has going to its bytes. Only a window about as long as the longest
piece is held: at every character the ends that a piece can still start from are known, and as soon as
all their backward paths meet at one boundary, what lies before it is committed. No piece runs across the
place before a marker or a character without a piece, so the state there is always a single path, and
the segmentation of each stretch in between is kept for its next occurrence.

The public model was trained as merges: its library's own ids follow the order of merges and differ
where the best sum does; both decode to the same text. Ties go to the longer last piece. Defined
results: null and empty texts have no ids; the marker itself (U+2581) reads as a blank, as in the
library; repeated rows get equal results; a text of any length goes through the same window; an empty
table gives no rows; other columns, whatever they are called, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import vocabulary_path
from .shared import text_or_empty

MARK, STRETCHES_KEPT, _NOTHING = "▁", 300_000, (None, None, 0.0)
_STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
#: What no piece may hold, as texts are cut there: a marker after another character, a line feed but at the beginning.
_TORN = re.compile(f"[^{MARK}]{MARK}|.\n", re.DOTALL)


class PieceModel:
    """Pieces, scores and bytes of a SentencePiece model file."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        if torn := [p for p in self.pieces if _TORN.search(p)]:
            raise ValueError(f"pieces that run across a blank or a line feed, such as {torn[0]!r}, are not supported")
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        self.bytes = [b""] * n
        self.trie: dict = {}  # character -> [next level, piece id or None, score]
        for p, (i, score) in self.pieces.items():
            level = self.trie
            for c in p:
                node = level.setdefault(c, [{}, None, 0.0])
                level = node[0]
            node[1:] = i, score
            self.bytes[i] = p.encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self._kept = _Stretches(self)

    def stream(self) -> "Stream":
        return Stream(self)

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit little-endian integers."""
        if not text:
            return b""
        try:
            return b"".join(map(self._kept.__getitem__, text.replace("\n", " \n").split(" ")))
        except _Bound:
            stretches = _STRETCH.findall(MARK + text.replace(" ", MARK))
            return b"".join(self._kept[x[1:]] if x[0] == MARK and x[1:2] not in ("", MARK) else self.ids(x) for x in stretches)

    def ids(self, stretch: str) -> bytes:
        stream = self.stream()
        return array("I", stream.feed(stretch) + stream.finish()).tobytes()

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        raw = b"".join([table[i] for i in array("I", ids)])
        return raw.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


class _Bound(Exception):
    """White space in other forms than single blanks and line feeds."""


class _Stretches(dict):
    """Word, or line feed and word -> ids of its stretch (a word's begins with the marker)."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, key: str) -> bytes:
        if not key or MARK in key:
            raise _Bound
        found = self.model.ids(key if key[0] == "\n" else MARK + key)
        if len(self) < STRETCHES_KEPT:
            self[key] = found
        return found


class Stream:
    """Viterbi state of one text; feed and finish return the ids that are committed.

    back[k] is the best way to the k-th boundary after the last committed one: where its last piece
    starts, and that piece's id (or the ids of a character's bytes).
    """

    def __init__(self, model: PieceModel):
        self.m = model
        self.score = 0.0  # of the best way to the boundary that was read last
        self.back: list[tuple[int, int | list[int]] | None] = [None]
        self.open: list[tuple[float, int, dict]] = []  # (score, start, level) of pieces that may still grow, the longest first

    def feed(self, characters: str) -> list[int]:
        trie, unknown, longest = self.m.trie, self.m.unknown, self.m.longest
        back, open_, score, out = self.back, self.open, self.score, []
        for c in characters:
            grown, top, way, n = [], -1e300, None, len(back) - 1
            for held, start, level in open_:
                if c in level:
                    below, piece, gain = level[c]
                    if below:
                        grown.append((held, start, below))
                    if piece is not None and held + gain > top:
                        top, way = held + gain, (start, piece)
            below, piece, gain = trie.get(c, _NOTHING)
            if below:
                grown.append((score, n, below))
            if piece is None:
                if score + unknown > top:
                    top, way = score + unknown, (n, [self.m.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")])
            elif score + gain > top:
                top, way = score + gain, (n, piece)
            back.append(way)
            score, open_ = top, grown
            if not grown:
                out += self._commit(n + 1)
            elif n + 1 >= longest:
                meet = self._meeting({n + 1, *(s for _, s, _ in grown)})
                if meet:
                    out += self._commit(meet)
                    open_ = [(held, start - meet, below) for held, start, below in grown]
        self.open, self.score = open_, score
        return out

    def _meeting(self, ends: set[int]) -> int:
        """The last boundary at which the backward paths of all ends meet; 0 if that is the last committed one."""
        while len(ends) > 1 and min(ends):
            last = max(ends)
            ends.remove(last)
            ends.add(self.back[last][0])
        return min(ends)

    def _commit(self, meet: int) -> list[int]:
        """Ids before a boundary, which becomes the first of the window."""
        back, out, at = self.back, [], meet
        while at:
            at, piece = back[at]
            if piece.__class__ is int:
                out.append(piece)
            else:
                out += reversed(piece)
        del back[:meet]
        if meet:
            back[0] = None
            for k in range(1, len(back)):
                back[k] = (back[k][0] - meet, back[k][1])
        out.reverse()
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.back) - 1)


@lru_cache(2)
def piece_model(path: str | None = None) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (decoding gives the text again), decoded_crc32 (of the decoded
    text in UTF-8) and ids (32 bits each, little-endian); no shuffle."""
    slim = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("decoded_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            coded = [model.encode(x) for x in texts]
            back = [model.decode(c) for c in coded]
            same = [y == x.replace(MARK, " ") for y, x in zip(back, texts)]
            crc = lambda rows: pa.array(map(zlib.crc32, rows), pa.int64())
            columns = [batch["doc_id"], pa.array([len(c) >> 2 for c in coded], pa.int64()), crc(coded), pa.array(same), crc(y.encode("utf-8", "replace") for y in back), pa.array(coded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(work, schema)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with its ids (32-bit little-endian) as text; null ids give a null text."""
    out = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else piece_model(path).decode(bytes(x))), T.StringType())
    return df.withColumn("text", out(F.col(ids_col)))
