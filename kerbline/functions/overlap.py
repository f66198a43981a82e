"""Area shared by a polygon and a convex region, as an Arrow-batched function.

The polygon is cut into triangles that fan out from a point inside the convex
region.  Seen from that point both outlines are distances by direction, so each
(polygon edge, region edge) pair contributes a closed-form area over the
directions they share; triangles that wind the other way subtract.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions.planar import point

TWO_PI = 2 * np.pi
TOUCH_SQFT = 1e-6  # shared edges leave rounding noise, not area


def _cross(a, b):
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def fan_areas(p: np.ndarray, q: np.ndarray, owner: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Signed area each directed edge p -> q shares, as a fan, with the region of its row.

    ``owner`` is the row of an edge; ``regions`` holds one convex counter-clockwise
    outline per row (rows x corners x 2, not closed), all with the same number of corners.
    """
    centre = regions.mean(axis=1)
    p, q = p - centre[owner], q - centre[owner]
    turn = _cross(p, q)
    flip = turn < 0
    sign, turn = np.sign(turn), np.abs(turn)
    p, q = np.where(flip[:, None], q, p), np.where(flip[:, None], p, q)
    a0 = np.arctan2(p[:, 1], p[:, 0])
    a1 = a0 + np.arctan2(turn, (p * q).sum(axis=1))
    v = regions - centre[:, None, :]
    w = np.roll(v, -1, axis=1)
    wedge = _cross(v, w)
    b0 = np.arctan2(v[..., 1], v[..., 0])
    b1 = b0 + np.arctan2(wedge, (v * w).sum(axis=2))
    total = np.zeros(len(p))
    for shift in (-TWO_PI, 0.0, TWO_PI):
        lo = np.maximum(a0[:, None], b0[owner] + shift)
        hi = np.minimum(a1[:, None], b1[owner] + shift)
        i, k = np.nonzero((hi - lo > 1e-15) & (turn > 1e-12)[:, None])
        if len(i) == 0:
            continue
        row = owner[i]
        side, rim = q[i] - p[i], w[row, k] - v[row, k]
        u0, u1 = (np.stack([np.cos(t), np.sin(t)], axis=1) for t in (lo[i, k], hi[i, k]))
        e0, e1 = turn[i] / _cross(u0, side), turn[i] / _cross(u1, side)
        c0, c1 = wedge[row, k] / _cross(u0, rim), wedge[row, k] / _cross(u1, rim)
        near0, near1 = np.minimum(e0, c0)[:, None] * u0, np.minimum(e1, c1)[:, None] * u1
        area = 0.5 * _cross(near0, near1)
        swap = (e0 - c0) * (e1 - c1) < 0
        if swap.any():
            from_e, to_e = e0[swap, None] * u0[swap], e1[swap, None] * u1[swap]
            from_c, to_c = c0[swap, None] * u0[swap], c1[swap, None] * u1[swap]
            t = _cross(from_c - from_e, to_c - from_c) / _cross(to_e - from_e, to_c - from_c)
            x = from_e + t[:, None] * (to_e - from_e)
            area[swap] = 0.5 * (_cross(near0[swap], x) + _cross(x, near1[swap]))
        np.add.at(total, i, sign[i] * area)
    return total


def shared_areas(xy: np.ndarray, sizes: np.ndarray, ring_rows: np.ndarray, outer: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Shared area per row.  Rings lie one after another in ``xy``; holes (``outer`` False) subtract."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.ones(len(xy), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False  # the last vertex of a ring starts no edge
    at = np.nonzero(inner)[0]
    areas = fan_areas(xy[at], xy[at + 1], ring_rows[ring[at]], regions)
    per_ring = np.abs(np.bincount(ring[at], weights=areas, minlength=len(sizes)))
    out = np.bincount(ring_rows, weights=np.where(outer, per_ring, -per_ring), minlength=len(regions))
    return np.where(out > TOUCH_SQFT, np.round(out, 6), 0.0)


@F.pandas_udf(T.DoubleType())
def _overlap(coords: pd.Series, sizes: pd.Series, region: pd.Series) -> pd.Series:
    out = np.full(len(coords), np.nan)
    known = np.array([c is not None and g is not None and len(c) > 0 for c, g in zip(coords, region)])
    corners = np.array([len(g) // 2 - 1 if g is not None else 0 for g in region])
    for m in np.unique(corners[known]):
        rows = np.nonzero(known & (corners == m))[0]
        regions = np.stack([region.iat[r] for r in rows]).reshape(len(rows), -1, 2)[:, :m, :]
        xy = np.concatenate([coords.iat[r] for r in rows]).reshape(-1, 2)
        per_row = [np.asarray(sizes.iat[r]) for r in rows]
        counts = np.array([len(n) for n in per_row])
        outer = np.concatenate([np.arange(n) == 0 for n in counts])
        out[rows] = shared_areas(xy, np.concatenate(per_row), np.repeat(np.arange(len(rows)), counts), outer, regions)
    return pd.Series(out).where(~np.isnan(out), None).astype(float)


# Keeps the optimizer from repeating the costly call in a pushed-down filter, below
# the shuffle that spreads the pairs.
_overlap = _overlap.asNondeterministic()


def _flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p.x, p.y)))


def overlap_area(rings: Column | str, region: Column | str) -> Column:
    """Shared area of a polygon (outer ring, then holes) and a convex counter-clockwise ring; NULL in, NULL out."""
    rings, region = (F.col(c) if isinstance(c, str) else c for c in (rings, region))
    area = _overlap(_flat(F.flatten(rings)), F.transform(rings, F.size), _flat(region))
    return F.when(~F.isnan(area), area)


def disc(x: Column, y: Column, r: Column, segments: int = 32) -> Column:
    """Closed regular polygon inscribed in a circle (eight segments per quarter by default)."""
    angles = [TWO_PI * i / segments for i in range(segments)]
    pts = [point(x + r * F.lit(float(np.cos(a))), y + r * F.lit(float(np.sin(a)))) for a in angles]
    return F.array(*pts, pts[0])


def stadium(x0: Column, y0: Column, x1: Column, y1: Column, r: Column, segments: int = 16) -> Column:
    """Closed outline of all points within ``r`` of a segment, half circles at both ends."""
    heading = F.atan2(y1 - y0, x1 - x0)
    steps = [np.pi * i / segments for i in range(segments + 1)]
    end = [point(x1 + r * F.cos(heading - np.pi / 2 + a), y1 + r * F.sin(heading - np.pi / 2 + a)) for a in steps]
    start = [point(x0 + r * F.cos(heading + np.pi / 2 + a), y0 + r * F.sin(heading + np.pi / 2 + a)) for a in steps]
    return F.array(*end, *start, end[0])
