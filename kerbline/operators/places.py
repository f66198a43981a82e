"""Viewport and recency filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_bbox(bbox: str | None) -> tuple[float, float, float, float] | None:
    """'west,south,east,north' -> numbers; anything malformed means no filter."""
    try:
        w, s, e, n = (float(p) for p in (bbox or "").split(","))
    except ValueError:
        return None
    return w, s, e, n


def bbox_filter(df: DataFrame, bbox: str | None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside the viewport; rows without coordinates are dropped when a viewport is given."""
    box = parse_bbox(bbox)
    if box is None:
        return df
    w, s, e, n = box
    return df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n))


def recent(df: DataFrame, ts: str, hours: float | None, as_of: int) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``; no window, no filter."""
    return df if not hours or hours <= 0 else df.where(F.col(ts) >= int(as_of - hours * 3600))
