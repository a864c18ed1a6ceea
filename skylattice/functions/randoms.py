"""Repeatable random numbers from a digest of their key, the same in every engine and retry."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2147483647
_WORD = 4294967296.0


def _words(seed: int, name: str, draws: int, stream: str) -> np.ndarray:
    """Two 32-bit words per draw."""
    hexes = [hashlib.md5(f"{seed}|{name}|{d}|{stream}".encode()).hexdigest() for d in range(draws)]
    return np.array([(int(h[:8], 16), int(h[8:16], 16)) for h in hexes], dtype=np.int64)


def uniforms(seed: int, name: str, draws: int, stream: str) -> np.ndarray:
    """In [0, 1) with 32 bits."""
    return _words(seed, name, draws, stream)[:, 0] / _WORD


def normals(seed: int, name: str, draws: int, stream: str) -> np.ndarray:
    """Standard normal by the Box-Muller transform of two digest words."""
    w = _words(seed, name, draws, stream)
    return np.sqrt(-2.0 * np.log((w[:, 0] + 0.5) / _WORD)) * np.cos(2 * np.pi * (w[:, 1] / _WORD))


def pool_starts(seed: int, name: str, draws: int) -> np.ndarray:
    """A 31-bit starting number per draw for its index sequence."""
    return _words(seed, name, draws, "pool")[:, 0] % _PRIME


def pool_indices(start: int, n: int, size: int) -> np.ndarray:
    """``n`` indices below ``size`` by multiplicative scrambling in 31-bit arithmetic."""
    a = (start + np.arange(1, n + 1, dtype=np.int64) * 7919) % _PRIME * 48271 % _PRIME
    return (a + a // 65536) * 69621 % _PRIME % size


def order_key(seed: int, key: Column) -> Column:
    """Text that orders rows at random but repeatably."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
