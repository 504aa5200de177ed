"""Hashed character n-grams of whole texts, by NumPy over blocks of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points handled at once; n-grams that cross a block's border are kept by an overlap.
BLOCK = 1 << 18


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of every n-gram of points, by a multiplicative hash."""
    if len(points) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(points) - n + 1, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def blocks(points: np.ndarray, n: int) -> Iterator[np.ndarray]:
    for at in range(0, max(1, len(points)), BLOCK):
        yield points[at : at + BLOCK + n - 1]
