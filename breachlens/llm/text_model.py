"""Hashed features of texts for the classifiers: code points of whole texts, and n-grams over them."""

import numpy as np

_U32 = np.uint32
_PLACE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], _U32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U32(15))) * _U32(0x2C1B3C6D)
    return values ^ (values >> _U32(13))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of every run of ``n`` code points."""
    if len(points) < n:
        return np.empty(0, _U32)
    total = points[: len(points) - n + 1] * _PLACE[0] + _U32(n)
    for k in range(1, n):
        total += points[k : len(points) - n + 1 + k] * _PLACE[k]
    return scrambled(total)
