"""Seeded draws: functions of (seed, offsets) alone, whatever the partitioning."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.storage import ship

#: Bits between the places of two offsets in the seed.
OFFSET_BITS = 64


def generator(seed: int, *offsets: int) -> random.Random:
    """A generator for the seed and offsets; leaving out trailing offsets is the same as giving zeros."""
    return random.Random(seed + sum(x << (OFFSET_BITS * i) for i, x in enumerate(offsets, 1)))


def array_generator(seed: int, *offsets: int) -> np.random.RandomState:
    """A numpy generator for the seed and offsets; the seed counts, and left-out offsets are not zeros."""
    words = [w for x in (seed, *offsets) for w in (x & 0xFFFFFFFF, (x >> 32) & 0xFFFFFFFF)]
    return np.random.RandomState(words)


def uniform(seed: int, *offsets: Column) -> Column:
    """First draw from [0, 1) of the generator for each row's offsets; an Arrow batch at a time."""
    ship(SparkSession.active())

    @pandas_udf("double")
    def draw(*cols: pd.Series) -> pd.Series:
        return pd.Series([generator(seed, *map(int, row)).random() for row in zip(*cols)])

    return draw(*offsets)


def array_uniform(seed: int, *offsets: Column) -> Column:
    """First draw from [0, 1) of numpy's generator for each row's offsets; an Arrow batch at a time."""
    ship(SparkSession.active())

    @pandas_udf("double")
    def draw(*cols: pd.Series) -> pd.Series:
        words = [w for x in (seed, *cols) for w in _words(x)]
        n = len(cols[0])
        key = np.empty((len(words), n), np.uint32)
        for at, w in enumerate(words):
            key[at] = w
        return pd.Series(np.concatenate([_first_draws(key[:, k : k + TOGETHER]) for k in range(0, n, TOGETHER)] or [np.empty(0)]))

    return draw(*offsets)


#: Generators whose states (2.5 kB each) are set up together.
TOGETHER = 2048


def _words(x: int | pd.Series) -> tuple:
    """The low and the high 32 bits of the low 64."""
    if isinstance(x, int):
        return x & 0xFFFFFFFF, (x >> 32) & 0xFFFFFFFF
    try:
        whole = x.astype("int64").to_numpy().view(np.uint64)
    except OverflowError:  # decimals beyond 64 bits
        whole = np.array([int(v) & 0xFFFFFFFFFFFFFFFF for v in x], np.uint64)
    return (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32), (whole >> np.uint64(32)).astype(np.uint32)


def _first_draws(key: np.ndarray) -> np.ndarray:
    """First draw of MT19937 (53 bits) seeded by the array in each column of ``key``: as ``RandomState(column)``, for all
    columns at once. Only the words of the next state that make up the first two outputs are worked out."""
    u, size, middle = np.uint32, 624, 397
    state = np.empty((size, key.shape[1]), u)
    state[:] = np.array(_START, u)[:, None]
    shift, mixed = np.empty_like(state[0]), np.empty_like(state[0])

    def mix(i: int, factor: int) -> None:
        np.right_shift(state[i - 1], u(30), out=shift)
        np.bitwise_xor(state[i - 1], shift, out=mixed)
        np.multiply(mixed, u(factor), out=mixed)
        np.bitwise_xor(state[i], mixed, out=state[i])

    i, added = 1, [row + u(j) for j, row in enumerate(key)]
    for k in range(max(size, len(key))):
        mix(i, 1664525)
        np.add(state[i], added[k % len(key)], out=state[i])
        i += 1
        if i == size:
            state[0], i = state[size - 1], 1
    for _ in range(size - 1):
        mix(i, 1566083941)
        np.subtract(state[i], u(i), out=state[i])
        i += 1
        if i == size:
            state[0], i = state[size - 1], 1
    state[0] = u(0x80000000)
    halves = []
    for k, bits in ((0, 5), (1, 6)):
        y = (state[k] & u(0x80000000)) | (state[k + 1] & u(0x7FFFFFFF))
        y = state[k + middle] ^ (y >> u(1)) ^ ((y & u(1)) * u(0x9908B0DF))
        y ^= y >> u(11)
        y ^= (y << u(7)) & u(0x9D2C5680)
        y ^= (y << u(15)) & u(0xEFC60000)
        y ^= y >> u(18)
        halves.append((y >> u(bits)).astype(np.float64))
    return (halves[0] * 67108864.0 + halves[1]) / 9007199254740992.0


def _start() -> list[int]:
    """The state that seeding by an array begins with."""
    out = [19650218]
    for i in range(1, 624):
        out.append((1812433253 * (out[-1] ^ (out[-1] >> 30)) + i) & 0xFFFFFFFF)
    return out


_START = _start()


def native_uniform(seed: int, *offsets: Column) -> Column:
    """A draw from [0, 1) by hash: as deterministic, without Python, not the same numbers."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *offsets), 11) / F.lit(float(1 << 53))
