"""Seeded draws that any engine can repeat: the leading bits of a digest of the seed and a row's keys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 28
#: The digest's rotations by round, added constants and first state (RFC 1321).
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def draw_int(seed: int | str, *keys: Column | str) -> Column:
    """A number from 0 to 2^28 - 1 of the keys (null keys are skipped)."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, BITS // 4), 16, 10).cast("long")


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) of the keys."""
    return draw_int(seed, *keys) / F.lit(float(1 << BITS))


def _steps(state: list[np.ndarray], words: list[np.ndarray | int], last: bool) -> list[np.ndarray]:
    """The digest's rounds over one block, on arrays; of the last block only as far as the first word needs."""
    a, b, c, d = (x.copy() for x in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif part == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[part] % 16]
        np.add(f, a, out=f)
        np.add(f, np.uint32((word + _SINES[i]) % 2**32) if isinstance(word, int) else word + np.uint32(_SINES[i]), out=f)
        turn = _SHIFTS[part][i % 4]
        np.left_shift(f, np.uint32(turn), out=g), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    if last:  # b is the first word, which three more steps would only move
        return [b + state[0]]
    return [x + y for x, y in zip((a, b, c, d), state, strict=True)]


def draws_of(firsts: list[bytes], lasts: list[bytes]) -> np.ndarray:
    """What draw_int reads from the digest of each first joined to each last, as rows by first; the firsts are of one length, the lasts too."""
    start, size = len(firsts[0]), len(firsts[0]) + len(lasts[0])
    blocks = (size + 8) // 64 + 1
    p, q = (np.zeros((len(x), blocks * 64), np.uint8) for x in (firsts, lasts))
    p[:, :start] = np.frombuffer(b"".join(firsts), np.uint8).reshape(len(firsts), start)
    q[:, start:size] = np.frombuffer(b"".join(lasts), np.uint8).reshape(len(lasts), size - start)
    q[:, size] = 0x80
    q[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    p, q = p.view("<u4"), q.view("<u4")
    state = [np.full((len(firsts), len(lasts)), x, np.uint32) for x in _BEGIN]
    for k in range(blocks):
        words = []
        for w in range(16 * k, 16 * k + 16):
            mine, yours = p[:, w].any(), (q[:, w] != q[0, w]).any()
            words.append(p[:, w, None] | q[None, :, w] if mine and yours else p[:, w, None] | q[0, w] if mine else q[None, :, w] if yours else int(q[0, w]))
        state = _steps(state, words, k == blocks - 1)
    return state[0].byteswap() >> np.uint32(32 - BITS)


def least(p: float) -> int:
    """What the number of a draw stands below, exactly if the draw is less than p."""
    return min(max(math.ceil(p * (1 << BITS)), 0), 1 << BITS)


def draw_sql(seed: int | str, *keys: str) -> str:
    """The same in SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('-', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, {BITS // 4}) AS BIGINT) / {float(1 << BITS)})"


def draw_int_sql(seed: int | str, *keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, {BITS // 4}) AS BIGINT)"
