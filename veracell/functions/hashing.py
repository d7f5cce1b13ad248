"""Repeatable random draws and fingerprints from row keys, stable under task retries."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def unit_hash(*cols, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from the key; the same key always gives the same number."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)


def poisson_one(*cols, seed: int = 0) -> Column:
    """A Poisson(1) count by inversion of the unit draw (counts over 8 have mass under 1e-6)."""
    u = unit_hash(*cols, seed=seed)
    acc, mass, out = 0.0, 0.36787944117144233, None
    for k in range(9):
        acc += mass
        out = F.when(u < acc, k) if out is None else out.when(u < acc, k)
        mass /= k + 1
    return out.otherwise(9)


def fingerprint(*cols) -> Column:
    """128 bits over columns cast to text, where a null differs from every string."""
    parts = [F.coalesce(c, F.lit("\u0000null")) for c in cols]
    return F.struct(
        F.xxhash64(F.lit(11), *parts).alias("h1"), F.xxhash64(F.lit(29), *parts).alias("h2")
    )


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, for draws inside tasks."""
    x = x.astype(np.uint64)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))
