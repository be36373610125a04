"""Scalar functions: order-preserving keys, Keccak-256, nibble paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def be_key(column: Column, width: int = 8) -> Column:
    """A non-negative number as big-endian hex of fixed width: text order is number order."""
    return F.lpad(F.lower(F.hex(column)), 2 * width, "0")


def from_be_key(column: Column) -> Column:
    return F.conv(column, 16, 10).cast("long")


def compact_path(column: Column, width: int = 64) -> Column:
    """A nibble path padded to a fixed width, with its length in the last byte."""
    return F.concat(F.rpad(column, width, "0"), F.lpad(F.lower(F.hex(F.length(column))), 2, "0"))


# Keccak-f[1600] rotation offsets by lane (x, y).
ROTATIONS = {
    (0, 0): 0, (1, 0): 1, (2, 0): 62, (3, 0): 28, (4, 0): 27, (0, 1): 36, (1, 1): 44, (2, 1): 6, (3, 1): 55, (4, 1): 20, (0, 2): 3, (1, 2): 10, (2, 2): 43,
    (3, 2): 25, (4, 2): 39, (0, 3): 41, (1, 3): 45, (2, 3): 15, (3, 3): 21, (4, 3): 8, (0, 4): 18, (1, 4): 2, (2, 4): 61, (3, 4): 56, (4, 4): 14,
}


def _round_constants() -> list[int]:
    """From the linear feedback shift register of the standard."""
    out, r = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            if r & 1:
                constant |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(constant)
    return out


RATE = 136


def keccak256_rows(rows: list[bytes]) -> list[bytes]:
    """Keccak-256 of many byte strings at once: lanes are arrays over the rows."""
    out: list[bytes] = [b""] * len(rows)
    by_blocks: dict[int, list[int]] = {}
    for k, b in enumerate(rows):
        by_blocks.setdefault(len(b) // RATE + 1, []).append(k)
    constants = [np.uint64(c) for c in _round_constants()]
    for blocks, at in by_blocks.items():
        padded = np.zeros((len(at), blocks * RATE), np.uint8)
        for i, k in enumerate(at):
            padded[i, : len(rows[k])] = np.frombuffer(rows[k], np.uint8)
            padded[i, len(rows[k])] ^= 0x01
        padded[:, -1] ^= 0x80
        words = padded.view("<u8").reshape(len(at), blocks, RATE // 8)
        a = {(x, y): np.zeros(len(at), np.uint64) for x in range(5) for y in range(5)}
        for block in range(blocks):
            for w in range(RATE // 8):
                a[w % 5, w // 5] = a[w % 5, w // 5] ^ words[:, block, w]
            for constant in constants:
                c = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
                d = [c[x - 1] ^ _rotated(c[(x + 1) % 5], 1) for x in range(5)]
                b = {(y, (2 * x + 3 * y) % 5): _rotated(a[x, y] ^ d[x], ROTATIONS[x, y]) for x in range(5) for y in range(5)}
                a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & b[(x + 2) % 5, y]) for x in range(5) for y in range(5)}
                a[0, 0] = a[0, 0] ^ constant
        digest = np.stack([a[0, 0], a[1, 0], a[2, 0], a[3, 0]], 1).astype("<u8")
        for i, k in enumerate(at):
            out[k] = digest[i].tobytes()
    return out


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x if n == 0 else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


@F.pandas_udf(T.StringType())
def keccak256_hex(s: pd.Series) -> pd.Series:
    """Keccak-256 of UTF-8 text or bytes as lower-case hex; null stays null."""
    real = s.dropna()
    hashes = keccak256_rows([x.encode() if isinstance(x, str) else bytes(x) for x in real])
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    out[real.index] = [h.hex() for h in hashes]
    return out
