"""Samplers: a plane flattened to a signal by a fixed permutation of its pixels, or by means over spiral cells.

A map from pixels to signal depends on the size of the plane alone; ``planes.sampled`` makes it once in each task.
"""

from __future__ import annotations

import math

import numpy as np


def raster(width: int, height: int) -> list[int]:
    return list(range(width * height))


def weave(width: int, height: int) -> list[int]:
    """Rows in turn from left and from right."""
    return [y * width + (width - 1 - x if y % 2 else x) for y in range(height) for x in range(width)]


def zigzag(width: int, height: int) -> list[int]:
    """Anti-diagonals in turn downwards and upwards."""
    cells = [(x, y) for y in range(height) for x in range(width)]
    return [y * width + x for x, y in sorted(cells, key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 else c[0]))]


def spiral_points(width: int, height: int, a_rate: float, r_rate: float) -> np.ndarray:
    """Whole-pixel points of a spiral from the centre to the first that leaves the plane, repeats of the last one left out."""
    cx, cy, a, r = width // 2, height // 2, 0.0, 1.0
    last, out = (0, 0), []
    while True:
        p = (cx + int(math.sin(a) * r), cy + int(math.cos(a) * r))
        a, r = a + a_rate / r, r + r_rate / r
        if p == last:
            continue
        if not (0 <= p[0] < width and 0 <= p[1] <= height):
            return np.array(out, np.int64).reshape(-1, 2)
        out.append(p)
        last = p


def nearest_tags(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """For every pixel in raster order the number of the nearest point; of points equally near the least."""
    y, x = np.divmod(np.arange(width * height), width)
    best = np.full(len(x), np.iinfo(np.int64).max)
    tag = np.zeros(len(x), np.int64)
    for i, (px, py) in enumerate(points.tolist()):
        d = (x - px) ** 2 + (y - py) ** 2
        near = d < best
        best[near], tag[near] = d[near], i
    return tag


def spiral(width: int, height: int, a_rate: float = 1.0, r_rate: float = 1.0, area_limit: float = 3.0, edge_trim: bool = False) -> list[list[int]]:
    """Pixels of the Voronoi cell of each spiral point. Cells over ``area_limit`` times the mean area are emptied, and with
    ``edge_trim`` those that touch the border; empty cells at the end are left off.
    """
    points = spiral_points(width, height, a_rate, r_rate)
    if not len(points):
        return []
    tag = nearest_tags(points, width, height)
    cells: list[list[int]] = [[] for _ in points]
    for p, t in enumerate(tag.tolist()):
        cells[t].append(p)
    most = (width * height // len(points)) * area_limit
    border = {t for p, t in enumerate(tag.tolist()) if p % width in (0, width - 1) or p // width in (0, height - 1)} if edge_trim else set()
    cells = [[] if len(c) > most or i in border else c for i, c in enumerate(cells)]
    while cells and not cells[-1]:
        cells.pop()
    return cells


def named(name: str):
    """The sampler of that name."""
    if name not in REGISTRY:
        raise ValueError(f"no sampler is named {name}")
    return REGISTRY[name]


REGISTRY = {"raster": raster, "weave": weave, "zigzag": zigzag, "spiral": spiral}
