"""Byte-level BPE ids of many whole texts, worked out once per distinct word of a batch.

The public vocabulary splits a text into letters, digits, signs and white space before its merges,
and a single blank before a word always belongs to that word. So a text cut before each such blank
and before each single line feed has the ids of its parts, one after another. A text where white
space comes in any other form is encoded whole, and so is one that holds a special token of the
tokenizer file: there, as in that file's own library, the token's text has the token's one id. The
rank file holds the same vocabulary as the tokenizer file, and the tests hold the ids of both against
each other.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, and characters encoded at a time.
WORDS_KEPT, GROUP_CHARS = 300_000, 3_000_000

_PLAIN = re.compile(r"[\x00\n]?\S+").fullmatch


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_tokens(tokenizer_path: str) -> dict[str, int]:
    """The special tokens that a tokenizer file adds, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens") or () if t.get("special")}


class WordBpe:
    """encode(texts) gives all ids and where each text's ids begin.

    tokenizer_path names the file whose special tokens count; with a rank file of one's own and no such
    file there are none.
    """

    def __init__(self, ranks_path: str | None = None, tokenizer_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if tokenizer_path is None and ranks_path is None:
            tokenizer_path = vocabulary_path("byte_bpe_50k.json")
        self.specials = special_tokens(tokenizer_path) if tokenizer_path else {}
        encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        self._encode, self._encode_special = encoding.encode_ordinary, lambda x: encoding.encode(x, allowed_special="all")
        self.token_bytes = np.zeros(max([*ranks.values(), *self.specials.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.specials.items())]:
            self.token_bytes[i] = len(token)
        self._kept: dict[str, bytes | None] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._encode_special(text) if self.has_special(text) else self._encode(text), np.uint32)

    def has_special(self, text: str) -> bool:
        return any(t in text for t in self.specials)

    def _word(self, key: str) -> bytes | None:
        """Ids of a part; None if its white space binds it to its neighbours."""
        if not _PLAIN(key):
            return None
        part = key[1:] if key[0] == "\x00" else key if key[0] == "\n" else " " + key
        return array("I", self._encode(part)).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, ends, group, size = [], [np.zeros(1, np.int64)], [], 0
        for k, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS or k == len(texts) - 1:
                found, lengths = self._group(group)
                ids.append(found)
                ends.append(lengths)
                group, size = [], 0
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum(np.concatenate(ends))

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pa.array(["\x00" + x.replace("\n", " \n") for x in texts], pa.large_string()), " ")
        bounds = np.asarray(parts.offsets)
        words = parts.flatten().dictionary_encode()
        at = np.asarray(words.indices)
        kept, values = self._kept, []
        for key in words.dictionary.to_pylist():
            v = kept.get(key, kept)
            if v is kept:
                v = self._word(key)
                if len(kept) < WORDS_KEPT:
                    kept[key] = v
            values.append(v)
        bound = np.fromiter((v is None for v in values), bool, len(values))
        flat = np.frombuffer(b"".join(v or b"" for v in values), np.uint32)
        sizes = np.fromiter((len(v or b"") >> 2 for v in values), np.int64, len(values))
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])]
        ends = before[bounds]
        odd = {int(i) for i in np.searchsorted(bounds, np.flatnonzero(bound[at]), "right") - 1} if bound.any() else set()
        odd |= {k for k, x in enumerate(texts) if "\x00" in x or self.has_special(x)}
        if not odd:
            return ids, np.diff(ends)
        out = [self.whole(x) if k in odd else ids[ends[k] : ends[k + 1]] for k, x in enumerate(texts)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


@lru_cache(2)
def word_bpe(ranks_path: str | None = None) -> WordBpe:
    """One encoder per worker and vocabulary."""
    return WordBpe(ranks_path)
