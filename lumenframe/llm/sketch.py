"""Parity sketches of sets: an exact lower bound of a symmetric difference from a few bytes.

Each member flips one bit. Members in both sets flip the same bit of both sketches, so the bits in which two sketches differ are
at most as many as the members that only one of the sets has. A pair whose sketches differ in more bits than its similarity allows
can be left out without looking at the sets, and none that is similar enough is ever left out.
"""

from __future__ import annotations

import numpy as np

BITS = 1024


def parity(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """Sketch of distinct 64-bit hashes; ``bits`` is a power of two of at least 64."""
    at = (hashes >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def matrix(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of unsigned 64-bit words."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1) if sketches else np.zeros((0, 1), np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of corresponding rows: a lower bound of the size of the symmetric difference."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def may_differ(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most members that only one of two sets of n and m members can have when their intersection is at least num / den of their union."""
    both = -(-(num * (n + m)) // (num + den))
    return n + m - 2 * both
