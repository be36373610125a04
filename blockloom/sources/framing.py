"""The framed form of snappy streams: chunks of at most 64 KiB with checksums of their plain bytes.

A stream begins with an identifier; a chunk is a type, a length of three bytes, and its bytes: a masked CRC-32C,
then data, compressed or (where that saves nothing) plain. Unknown chunks that may be left out are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

# The identifier, types of chunks, the largest chunk, the reflected polynomial and the mask of its checksums.
IDENTIFIER = b"\xff\x06\x00\x00sNaPpY"
COMPRESSED, PLAIN, SKIPPABLE, IDENTIFIED = 0x00, 0x01, 0x80, 0xFF
CHUNK, POLYNOMIAL, MASK = 65536, 0x82F63B78, 0xA282EAD8
#: Bytes of a row of crc32c: rows advance side by side, a byte of each at a time.
ROW = 256
#: Bytes below which a plain loop is faster.
FEW = 16 * ROW


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[int], np.ndarray]:
    """Of each byte, the state it leads to, as an array and as a list; and, for the four bytes of a state, the state a row of zeros later."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    later = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(ROW):
        later = table[later & 255] ^ (later >> np.uint32(8))
    return table, table.tolist(), later


def crc32c(data: bytes) -> int:
    """The checksum is linear in the data: rows are worked out together from 0, then joined one after another."""
    table, each, later = _tables()
    state, full = 0xFFFFFFFF, len(data) // ROW if len(data) >= FEW else 0
    if full:
        rows = np.frombuffer(data, np.uint8, full * ROW).reshape(full, ROW)
        own = np.zeros(full, np.uint32)
        for column in rows.T:
            own = table[(own ^ column) & 255] ^ (own >> np.uint32(8))
        for x in own.tolist():
            state = int(later[0, state & 255] ^ later[1, state >> 8 & 255] ^ later[2, state >> 16 & 255] ^ later[3, state >> 24]) ^ x
    for b in data[full * ROW :]:
        state = each[(state ^ b) & 255] ^ state >> 8
    return state ^ 0xFFFFFFFF


def masked(data: bytes) -> bytes:
    """The checksum as a chunk carries it."""
    c = crc32c(data)
    return (((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF).to_bytes(4, "little")


def framed(data: bytes) -> bytes:
    out = [IDENTIFIER]
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        kind, body = COMPRESSED, pa.compress(part, codec="snappy", asbytes=True)
        if len(body) >= len(part):
            kind, body = PLAIN, part
        out += [bytes([kind]), (len(body) + 4).to_bytes(3, "little"), masked(part), body]
    return b"".join(out)


def _plain_size(body: bytes) -> int:
    """The length that compressed data begins with: seven bits a byte, the lowest first."""
    size = 0
    for k, b in enumerate(body[:5]):
        size |= (b & 127) << 7 * k
        if b < 128:
            return size
    raise ValueError("a chunk without a length")


def unframed(data: bytes) -> bytes:
    """The plain bytes; damage, a missing identifier or a chunk that must be understood is an error."""
    if not data.startswith(IDENTIFIER):
        raise ValueError("no snappy stream")
    out, at = [], 0
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        if at + 4 > len(data) or len(body) < size:
            raise ValueError(f"chunk at {at} is cut off")
        if kind in (COMPRESSED, PLAIN):
            part = body[4:]
            if kind == COMPRESSED:
                plain = _plain_size(part)
                if plain > CHUNK:
                    raise ValueError(f"chunk at {at} is too long")
                part = pa.decompress(part, plain, codec="snappy", asbytes=True)
            if len(part) > CHUNK or masked(part) != body[:4]:
                raise ValueError(f"chunk at {at} is damaged")
            out.append(part)
        elif kind < SKIPPABLE:
            raise ValueError(f"chunk at {at} has the unknown type {kind}")
        elif kind == IDENTIFIED and body != IDENTIFIER[4:]:
            raise ValueError(f"chunk at {at} is no identifier")
        at += 4 + size
    return b"".join(out)
