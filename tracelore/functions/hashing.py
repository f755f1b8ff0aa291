"""Identifiers from tokens. What another engine must reproduce uses md5; the rest uses xxhash64."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_id(token: Column) -> Column:
    """A 64-bit identifier of a token, inside this engine."""
    return F.xxhash64(token)


def portable_id(token: Column) -> Column:
    """The first 32 bits of the token's md5, as any engine can compute them; null for null."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def seeded(seed: Column | int, token: Column) -> Column:
    """portable_id of a token under a seed."""
    return portable_id(F.concat(seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.lit(":"), token))


def seeded_hex(seed: int, token: Column) -> Column:
    """seeded() as eight hexadecimal digits, which order as the numbers do."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), token)), 1, 8)


def action_hash(normal: Column) -> Column:
    """Identity of an action: the hash of its normal form."""
    return portable_id(normal)


def rounded(score: Column) -> Column:
    """Scores to six digits: sums of logarithms depend on the order of their terms."""
    return F.round(score, 6)


#: MD5's constants, and by how much its rounds rotate.
SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476


def md5_heads(words: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block each, as a number; words: 16 arrays, the padded block's words of four bytes."""
    a, b, c, d = (np.full(len(words[0]), x, np.uint32) for x in START)
    f = np.empty_like(a)
    for i in range(64):
        r = i // 16
        if r == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif r == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif r == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += SINES[i]
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[r] % 16]
        turn = TURNS[r][i % 4]
        np.left_shift(f, np.uint32(turn), out=a)
        f >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(START[0])).byteswap()


def seeded_heads(seeds: list[int], tokens: pa.Array, step: int = 8192) -> np.ndarray:
    """seeded() of each token (none is null) under each seed, as an array of len(tokens) by len(seeds)."""
    tokens = tokens.cast(pa.large_binary())
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    out = np.empty((len(tokens), len(seeds)), np.uint32)
    starts = [f"{s}:".encode() for s in seeds]
    most = 55 - max(map(len, starts))  # what is longer has no place in one block
    short = np.flatnonzero(size <= most)
    for at in range(0, len(short), step):
        rows = short[at : at + step]
        n, wide = size[rows], int(size[rows].max())
        text = np.zeros((len(rows), wide), np.uint8)
        inside = np.arange(wide) < n[:, None]
        text[inside] = data[(ends[rows][:, None] + np.arange(wide))[inside]]
        for k, start in enumerate(starts):
            block = np.zeros((len(rows), 64), np.uint8)
            block[:, : len(start)] = np.frombuffer(start, np.uint8)
            block[:, len(start) : len(start) + wide] = text
            block[np.arange(len(rows)), n + len(start)] = 0x80
            words = list(np.ascontiguousarray(block.view("<u4").T))
            words[14] = ((n + len(start)) * 8).astype(np.uint32)
            out[rows, k] = md5_heads(words)
    for i in np.flatnonzero(size > most):
        token = tokens[int(i)].as_py()
        out[i] = [int.from_bytes(hashlib.md5(start + token).digest()[:4], "big") for start in starts]
    return out
