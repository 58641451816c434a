"""Vectorised 64-bit hashes of runs and windows of bytes. All arithmetic wraps modulo 2^64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for every byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


class Polynomials:
    """Powers of the base and its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = powers(1, 0)

    def grow(self, count: int) -> None:
        if len(self.up) < count:
            self.up, self.down = powers(_BASE, count), powers(_INVERSE, count)


_POLY = Polynomials()


def inverse_powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    _POLY.grow(count)
    return _POLY.up[:count], _POLY.down[:count]


def run_edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    padded = np.zeros(len(inside) + 2, dtype=np.int8)
    padded[1:-1] = inside
    edges = np.flatnonzero(np.diff(padded))
    return edges[::2], edges[1::2]


def _running_sums(data: np.ndarray) -> np.ndarray:
    _POLY.grow(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.take(BYTE_VALUES, data, out=sums[1:], mode="clip")
    sums[1:] *= _POLY.up[:len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each segment; equal bytes give equal hashes wherever they lie."""
    sums = _running_sums(data)
    found = (sums[ends] - sums[starts]) * _POLY.down[starts]
    return mix64(found + (ends - starts).astype(np.uint64))


class Windows:
    """Hashes of windows of one buffer at chosen positions, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.sums = _running_sums(data)

    def at(self, positions: np.ndarray, width: int) -> np.ndarray:
        found = self.sums[positions + width] - self.sums[positions]
        found *= _POLY.down[positions]
        return mix64(found + np.uint64(width))
