"""Reproducible random numbers: a splittable SHA-1 generator (columns) and a 46-bit congruential one (Python)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1 << 46
MULTIPLIER = 5**13


def sha_root(seed: int) -> Column:
    return F.unhex(F.sha1(F.unhex(F.lit("00" * 16 + f"{seed:08X}"))))


def sha_child(state: Column, i: Column) -> Column:
    return F.unhex(F.sha1(F.concat(state, F.unhex(F.lpad(F.hex(i.cast("long")), 8, "0")))))


def sha_uniform(state: Column) -> Column:
    """The last four bytes without their sign, as a number in [0, 1)."""
    return F.conv(F.substring(F.hex(state), 33, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647)) / F.lit(2147483648.0)


def root(seed: int) -> bytes:
    """The same states in Python."""
    return hashlib.sha1(bytes(16) + seed.to_bytes(4, "big")).digest()


def child(state: bytes, i: int) -> bytes:
    return hashlib.sha1(bytes(state) + i.to_bytes(4, "big")).digest()


def uniform(state: bytes) -> float:
    return (int.from_bytes(bytes(state)[16:20], "big") & 0x7FFFFFFF) / 2147483648.0


def lcg(x: int) -> int:
    return x * MULTIPLIER % MODULUS


def lcg_jump(x: int, steps: int) -> int:
    """The number `steps` draws after x, by binary powers; exact integers."""
    return x * pow(MULTIPLIER, steps, MODULUS) % MODULUS


def lcg_powers(n: int) -> np.ndarray:
    """Multipliers of 1 .. n draws.  Products wrap at 2^64, of which 2^46 is a divisor, so their lower bits are exact."""
    out, mask = np.full(n, MULTIPLIER, np.uint64), np.uint64(MODULUS - 1)
    made = 1
    while made < n:
        more = min(made, n - made)
        out[made : made + more] = out[:more] * np.uint64(pow(MULTIPLIER, made, MODULUS)) & mask
        made += more
    return out


def lcg_many(x: int, powers: np.ndarray) -> np.ndarray:
    """The draws after x, one for each of `powers`."""
    return np.uint64(x) * powers & np.uint64(MODULUS - 1)
