"""Token counts of a text's sections by offset-mapped attribution.

Every text is encoded once and whole. Its tokens tile its bytes, so running sums give each token's
span of code points (a token that holds part of a character's bytes spans that character). These
spans are interval-joined with the sections by binary search, and a token that crosses a boundary is
allocated by an explicit rule: "majority" gives it to the section that holds most of its characters,
the earlier one on a tie; "first" to the one where it begins. A token outside of all sections counts
for section -1.

Sections are half-open spans of code points; by default the lines, each with its line feed. They are
numbered as they stand in the array, and may be unsorted: of spans that overlap, each ends for the
count where the next one (by start, then by place in the array) begins. What lies outside of the text holds nothing; a span that is
null, has a null bound or ends before it begins is absent and holds nothing either, but keeps its number
and has a row with 0 tokens. Defined results: null and empty texts have one empty section 0 with no tokens
(lines) or the sections given, all without tokens; repeated rows are counted each; an empty table gives no
rows; other columns, whatever they are called, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import word_bpe
from .shared import text_or_empty

RULES, GROUP_CHARS = ("majority", "first"), 4_000_000


def token_spans(data: bytes, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point spans of tokens that tile data (UTF-8)."""
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts)])  # characters that begin before each byte
    ends = np.cumsum(token_bytes)
    begins = ends - token_bytes
    inside = ~np.append(starts, True)[begins]  # begins within a character
    return chars[begins] - inside, chars[ends]


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """For each token its section (-1: none), and whether it crosses a boundary of one."""
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, np.maximum(begin, end - 1), "right") - 1
    inside = (first >= 0) & (begin < ends[np.maximum(first, 0)])
    out = np.where(inside, first, -1)
    odd = (first != last) | (inside & (end > ends[np.maximum(first, 0)]))
    if rule == "majority":
        for k in np.flatnonzero(odd):
            best, most = -1, 0
            for s in range(max(0, first[k]), last[k] + 1):
                held = min(end[k], ends[s]) - max(begin[k], starts[s])
                if held > most:
                    best, most = s, held
            out[k] = best
    return out, odd


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines with their line feeds; an empty text has one empty line."""
    at, out = 0, []
    for line in text.splitlines(keepends=True) if "\n" not in text else [x + "\n" for x in text.split("\n")]:
        out.append((at, at + len(line)))
        at += len(line)
    if not out:
        return [(0, 0)]
    if "\n" in text:  # the last line has no line feed
        out[-1] = (out[-1][0], out[-1][1] - 1)
        if out[-1][0] == out[-1][1]:
            out.pop()
    else:
        out = [(0, len(text))]
    return out


OUT = [T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "majority", ranks_path: str | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: a row per section, and one for section -1 where tokens lie outside.

    spans_col names an array of structs (start, end) with the sections of each row; without it lines are counted.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    slim = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else []))
    schema = T.StructType([slim.schema["doc_id"], *OUT])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            spans = [[(s["start"], s["end"]) if s else (None, None) for s in x or []] for x in batch["spans"].to_pylist()] if spans_col else [line_sections(x) for x in texts]
            k = 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and size < GROUP_CHARS:
                    size += len(texts[end])
                    end += 1
                yield _count(batch["doc_id"].slice(k, end - k), texts[k:end], spans[k:end], rule, ranks_path, schema.names)
                k = end

    return slim.mapInArrow(work, schema)


def _count(ids: pa.Array, texts: list[str], spans: list[list[tuple[int, int]]], rule: str, ranks_path: str | None, names: list[str]) -> pa.RecordBatch:
    bpe = word_bpe(ranks_path)
    tokens, bounds = bpe.encode(texts)
    begin, end = token_spans("".join(texts).encode(), bpe.token_bytes[tokens])
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    n = np.array([len(s) for s in spans])
    owner = np.repeat(np.arange(len(texts)), n)
    given = [x for s in spans for x in s]
    flat = np.array([(0, 0) if None in x else x for x in given], np.int64).reshape(-1, 2)
    size = np.diff(at)[owner]
    starts, ends = np.clip(flat[:, 0], 0, size) + at[owner], np.clip(flat[:, 1], 0, size) + at[owner]
    order = np.lexsort((np.arange(len(flat)), starts))
    real = order[ends[order] > starts[order]]  # empty sections hold nothing and would hide their neighbours
    ends[real[:-1]] = np.minimum(ends[real[:-1]], starts[real[1:]])  # overlaps end where the next one begins
    real = real[ends[real] > starts[real]]
    where, odd = allocate(begin, end, starts[real], ends[real], rule) if len(real) else (np.full(len(begin), -1), np.zeros(len(begin), bool))
    held = np.where(where >= 0, real[np.maximum(where, 0)], -1) if len(real) else where
    counts = np.bincount(held[held >= 0], minlength=len(flat))
    crossing = np.bincount(held[(held >= 0) & odd], minlength=len(flat))
    out = np.flatnonzero(held < 0)
    doc = np.searchsorted(bounds, out, "right") - 1
    lost = np.bincount(doc, minlength=len(texts))
    lost_odd = np.bincount(doc[odd[out]], minlength=len(texts))
    more = np.flatnonzero(lost)
    first = np.cumsum(n) - n
    section = np.arange(len(flat)) - np.repeat(first, n)
    join = lambda a, b: pa.array(np.concatenate([a, b]))
    zero = np.zeros(len(more), np.int64)
    bound = lambda k: pa.array([x[k] for x in given] + [0] * len(more), pa.int64())  # noqa: E731  as given, nulls included
    return pa.RecordBatch.from_arrays(
        [ids.take(join(owner, more)), pa.array(np.concatenate([section, zero - 1]), pa.int32()), bound(0), bound(1), join(counts, lost[more]), join(crossing, lost_odd[more])], names=names
    )
