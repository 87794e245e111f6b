"""Points of one block against all points of the blocks it has to be compared with, as arrays.

Squared distances are one matrix product over coordinates relative to the middle
of the block. Those too near the limit for its rounding are looked at again with
the arithmetic of ``grid.within``, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from placelab.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE

# left and right rows of one matrix product
_LEFT, _RIGHT = 256, 4096


def _space(a: np.ndarray, b: np.ndarray, reach: np.ndarray, noise: float) -> tuple[np.ndarray, ...]:
    """(left, right, low, high): squared distances are left @ right, and certain outside of low to high."""
    finite = a[np.isfinite(a).all(axis=1)]
    middle = finite.mean(axis=0) if len(finite) else 0.0
    a, b = a - middle, b - middle
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 1e-14 * (a2.max() + b2[np.isfinite(b2)].max(initial=0))
    low = np.maximum(reach * (1 - 1e-9) - noise, 0) ** 2 - slack
    high = (reach * (1 + 1e-9) + noise) ** 2 + slack
    left = np.column_stack([-2 * a, a2, np.ones(len(a))])
    return left, np.vstack([b.T, np.ones(len(b)), b2]), low[:, None], high[:, None]


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])


def _within(mode: str, radius: float, a_lat: np.ndarray, a_lon: np.ndarray, b_lat: np.ndarray, b_lon: np.ndarray) -> np.ndarray:
    """The point predicate of ``grid.within``, pair by pair."""
    inside = np.ones(len(a_lat), bool)
    if mode != "sphere":
        inside &= (b_lat - a_lat) ** 2 + (b_lon - a_lon) ** 2 <= (radius / (METRES_PER_DEGREE * np.cos(np.radians(a_lat)))) ** 2
    if mode != "planar":
        chord = np.sin(np.radians(b_lat - a_lat) / 2) ** 2 + np.cos(np.radians(a_lat)) * np.cos(np.radians(b_lat)) * np.sin(
            np.radians(b_lon - a_lon) / 2) ** 2
        with np.errstate(invalid="ignore"):
            inside &= EARTH_RADIUS_M * 2 * np.arcsin(np.sqrt(chord)) <= radius
    return inside


def _parts(mode: str, radius: float, a: tuple[np.ndarray, np.ndarray],
           b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rectangles of the (left, right) pairs with what is inside."""
    spaces = []
    if mode != "planar":
        reach = np.full(len(a[0]), 2 * np.sin(min(radius / (2 * EARTH_RADIUS_M), np.pi / 2)))
        spaces.append(_space(_on_sphere(*a), _on_sphere(*b), reach, 4e-15))
    if mode != "sphere":
        reach = radius / (METRES_PER_DEGREE * np.cos(np.radians(a[0])))
        spaces.append(_space(np.column_stack(a), np.column_stack(b), reach, 1e-12))
    for i in range(0, len(a[0]), _LEFT):
        for j in range(0, len(b[0]), _RIGHT):
            rows, columns = slice(i, i + _LEFT), slice(j, j + _RIGHT)
            inside = maybe = None
            for left, right, low, high in spaces:
                squares = left[rows] @ right[:, columns]
                sure, possible = squares <= low[rows], squares <= high[rows]
                inside, maybe = (sure, possible) if inside is None else (inside & sure, maybe & possible)
            x, y = np.nonzero(inside != maybe)
            if len(x):
                inside[x, y] = _within(mode, radius, a[0][rows][x], a[1][rows][x], b[0][columns][y], b[1][columns][y])
            yield rows, columns, inside


def _folded(mode: str, radius: float, a, b, value: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(which left points have partners, ``how`` over the partners' values)."""
    found = np.zeros(len(a[0]), bool)
    if how == "sum":
        total, weights = np.zeros(len(found)), value.astype(float)
        for rows, columns, inside in _parts(mode, radius, a, b):
            total[rows] += inside.astype(float) @ weights[columns]
            found[rows] |= inside.any(axis=1)
        return found, total
    least = how == "min"
    worst = value.max() if least else value.min()
    best = np.full(len(found), worst)
    for rows, columns, inside in _parts(mode, radius, a, b):
        seen = np.where(inside, value[columns], worst)
        best[rows] = np.minimum(best[rows], seen.min(axis=1)) if least else np.maximum(best[rows], seen.max(axis=1))
        found[rows] |= inside.any(axis=1)
    return found, best


def fold_block(how: str, mode: str, schema: pa.Schema, left: pa.Table, right: pa.Table) -> pa.Table:
    """(cfg, id, value) of the points of one left block that have partners among ``right``."""
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    a = left["lat"].to_numpy(), left["lon"].to_numpy()
    b = right["b_lat"].to_numpy(), right["b_lon"].to_numpy()
    found, value = _folded(mode, left["radius"][0].as_py(), a, b, right["b_value"].to_numpy(), how)
    kept = left.filter(pa.array(found))
    out = pa.array(value[found]).cast(schema.field("value").type)
    return pa.Table.from_arrays([kept["cfg"], kept["id"], out], schema=schema)
