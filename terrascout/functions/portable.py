"""Deterministic uniform and normal numbers that every SQL engine can repeat.

Spark's ``rand`` depends on the partitioning.  Sampling here orders rows by the
leading 52 bits of a mixed hash of (id, seed) instead; ids may be numbers or text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits: 52 bits, whole in a double


def uniform(id_col: Column, seed: int | Column = 0) -> Column:
    """A number in [0, 1) from an id and a seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat(id_col.cast("string"), F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16 ** _DIGITS))


def uniform_sql(id_expr: str, seed: int | str = 0) -> str:
    """The same number as SQL text."""
    return (f"(cast(cast('0x' || substr(md5(cast({id_expr} as varchar) || ':' || cast({seed} as varchar)), 1, {_DIGITS}) as bigint) as double)"
            f" / {16 ** _DIGITS}.0::double)")


# MD5's constants (RFC 1321): additions and rotations of its 64 steps.
_ADD = np.array([int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)], np.uint32)
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_BLOCK = 55  # bytes of a text that MD5 takes in one block
_AT_ONCE = 32_768  # hashes whose steps stay in a core's cache


def _first_words(words: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the MD5 of many blocks, given as their 16 words."""
    start = a = np.uint32(0x67452301)
    b, c, d = np.uint32(0xEFCDAB89), np.uint32(0x98BADCFE), np.uint32(0x10325476)
    for i in range(64):
        if i < 16:
            mixed, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        mixed = mixed + (a + (words[word] + _ADD[i]))
        a, d, c = d, c, b
        b = b + ((mixed << np.uint32(_TURN[i])) | (mixed >> np.uint32(32 - _TURN[i])))
    return a + start, b + np.uint32(0xEFCDAB89)


def _bytes_at(texts: Sequence[bytes], at: int, end: bool) -> np.ndarray:
    """Texts of one length as words of blocks, from byte ``at`` on; the last part ends the message."""
    block = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    block[:, at:at + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    if end:
        block[:, at + size] = 0x80
        block[:, 56:64] = np.frombuffer((8 * (at + size)).to_bytes(8, "little"), np.uint8)
    return block.view("<u4")


def low_halves(ids: Sequence[str | None], seeds: Sequence[int]) -> np.ndarray:
    """``uniform(id, seed) < 0.5`` for every id (rows) and seed (columns); never for an id that is NULL.

    The number is below one half when the first bit of the hash is 0.  Hashes of texts of
    one length are computed side by side.
    """
    out = np.zeros((len(ids), len(seeds)), bool)
    heads: dict[int, list[tuple[int, bytes]]] = {}
    for k, text in enumerate(ids):
        if text is not None:
            head = f"{text}:".encode()
            heads.setdefault(len(head), []).append((k, head))
    tails: dict[int, list[tuple[int, bytes]]] = {}
    for k, seed in enumerate(seeds):
        tails.setdefault(len(str(seed)), []).append((k, str(seed).encode()))
    for size, own in heads.items():
        for length, these in tails.items():
            columns = np.array([k for k, _ in these])
            if size + length > _BLOCK:
                for k, head in own:
                    out[k, columns] = [hashlib.md5(head + tail, usedforsecurity=False).digest()[0] < 128 for _, tail in these]
                continue
            right = _bytes_at([t for _, t in these], size, True)
            step = max(1, _AT_ONCE // len(these))
            with np.errstate(over="ignore"):
                for i in range(0, len(own), step):
                    part = own[i:i + step]
                    left = _bytes_at([h for _, h in part], 0, False)
                    # A word that only one side fills stays as short as that side.
                    words = [left[:, [w]] | right[None, :, w] if left[:, w].any() and right[:, w].any() else
                             left[:, [w]] if left[:, w].any() else right[None, :, w] for w in range(16)]
                    rows = np.array([k for k, _ in part])
                    out[rows[:, None], columns[None, :]] = _first_words(words)[0] & np.uint32(0x80) == 0
    return out


def normals(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Two independent standard normals from two uniforms, u1 > 0 (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u1))
    angle = F.lit(2.0) * F.pi() * u2
    return radius * F.cos(angle), radius * F.sin(angle)


def rounding(col: Column, digits: int) -> Column:
    """``round`` of a double.  Spark's goes through decimal text; only numbers near a tie or too large need that."""
    scaled = col * F.lit(10.0 ** digits)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(1e12)) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(plain, whole / F.lit(10.0 ** digits) + F.lit(0.0)).otherwise(F.round(col, digits))


def fraction(col: Column) -> Column:
    return col - F.floor(col)


def fixed(col: str, digits: int) -> Column:
    """Fixed notation from the exact binary value, as C's printf rounds it."""
    return F.expr(f"format_number(`{col}`, '0.{'0' * digits}')")


def _sides(n: int) -> tuple[int, int, int]:
    """(a, b, steps): a * b is at least ``n`` and hardly more, and after how many steps no number is left at n or
    above, but for one case in 10^30."""
    a = max(2, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    over = (a * b - n) / (a * b)
    return a, b, 1 if not over else math.ceil(30 / -math.log10(over))


def uniforms(ids: np.ndarray, seed: int) -> np.ndarray:
    """``uniform`` of many whole numbers from 0 on, whose hashes are computed side by side."""
    out, tail = np.zeros(len(ids)), f":{seed}".encode()
    if not len(ids):
        return out
    length = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), ids, side="right") + 1
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        end = _bytes_at([tail], int(size), True)
        for i in range(0, len(own), _AT_ONCE):
            some = own[i:i + _AT_ONCE]
            block = np.zeros((len(some), 64), np.uint8)
            block[:, :size] = ids[some, None] // 10 ** np.arange(size - 1, -1, -1, dtype=np.int64) % 10 + 48
            block = block.view("<u4")
            filled = (int(size) + 3) // 4
            words = [block[:, w] | end[0, w] if w < filled else end[0, [w]] for w in range(16)]
            with np.errstate(over="ignore"):
                first, second = (w.byteswap().astype(np.int64) for w in _first_words(words))
            out[some] = ((first << 20) | (second >> 12)) / float(16 ** _DIGITS)
    return out


def permuted(rank: Column, n: int, seed: int) -> Column:
    """Where a keyed bijection of 0..n-1 sends a whole number: four rounds of an unbalanced Feistel network over
    a * b numbers, walked on while the result is not below ``n``.

    Only numbers that are not below ``n`` walk on; one that none of the steps brought below n raises an error.
    NULL stays NULL.
    """
    a, b, steps = _sides(n)

    def network(m: np.ndarray) -> np.ndarray:
        left, right = m % a, m // a
        for j in range(4):
            size = a if j % 2 == 0 else b
            left, right = right, (left + np.floor(uniforms(right, 4 * seed + j) * size).astype(np.int64)) % size
        # After an even number of rounds the sides have their sizes again.
        return right * a + left

    def walk(ranks: pd.Series) -> pd.Series:
        known = ranks.notna().to_numpy()
        m = network(ranks[known].to_numpy().astype(np.int64))
        for _ in range(steps - 1):
            far = m >= n
            if not far.any():
                break
            m[far] = network(m[far])
        if (m >= n).any():
            raise ValueError("permutation walked too far")
        out = pd.Series(pd.NA, index=ranks.index, dtype="Int64")
        out[known] = m
        return out

    return F.pandas_udf(walk, "bigint")(rank.cast("bigint"))


def permuted_sql(m: str, a: str, b: str, seed: int) -> str:
    """One walk of the same bijection over a * b numbers as SQL text; repeat it while the result is not below n."""
    left, right = f"({m} % {a})", f"({m} // {a})"
    for j in range(4):
        size = a if j % 2 == 0 else b
        left, right = right, f"(({left} + cast(floor({uniform_sql(right, 4 * seed + j)} * {size}) as bigint)) % {size})"
    return f"({right} * {a} + {left})"
