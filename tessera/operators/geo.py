"""Geographic predicates over struct<lat, lon> columns, on a grid of 32 bits a coordinate so that edges are inclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import EARTH_M, haversine
from ..plans.errors import RequestError


def grid(value: Column | float, span: float) -> Column:
    """The cell of a coordinate among 2^32 over -span to span."""
    c = value if isinstance(value, Column) else F.lit(float(value))
    cell = F.floor((c + span) * (float(1 << 32) / (2 * span)))
    return F.least(cell, F.lit((1 << 32) - 1))


def box(p: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Edges included; from a left edge east of the right one, across the date line."""
    if bottom > top:
        raise RequestError("bad_geo", "bottom is above top")
    lat = grid(p["lat"], 90).between(grid(bottom, 90), grid(top, 90))
    low, high, at = grid(left, 180), grid(right, 180), grid(p["lon"], 180)
    return lat & (at.between(low, high) if left <= right else (at >= low) | (at <= high))


def near(p: Column, lat: float, lon: float, meters: float) -> Column:
    """Within `meters`, included. The latitude band comes first: it is a plain comparison."""
    band = meters / EARTH_M * 57.29577951308232 + 1e-6
    return p["lat"].between(lat - band, lat + band) & (haversine(p["lat"], p["lon"], F.lit(float(lat)), F.lit(float(lon))) <= meters)


def polygon(p: Column, rings: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Inside by the even-odd rule over all rings: outlines unite, rings within them are holes. Points are [lon, lat]."""
    edges = []
    for ring in rings:
        if len(ring) < 3:
            raise RequestError("bad_geo", "a ring needs three points")
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2:
                edges.append((float(x1), float(y1), float(x2), float(y2)))
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("abcd", e))) for e in edges))
    crossed = lambda e: ((e.b > p["lat"]) != (e.d > p["lat"])) & (p["lon"] < (e.c - e.a) * (p["lat"] - e.b) / (e.d - e.b) + e.a)
    return F.size(F.filter(made, crossed)) % 2 == 1


def point(value) -> tuple[float, float]:
    """(lat, lon) of the forms that requests and documents use: [lon, lat], {lat, lon}, GeoJSON, "lat,lon" or WKT."""
    if isinstance(value, dict):
        if "coordinates" in value:
            return float(value["coordinates"][1]), float(value["coordinates"][0])
        return float(value["lat"]), float(value["lon"])
    if isinstance(value, str):
        if value.strip().upper().startswith("POINT"):
            lon, lat = value[value.index("(") + 1 : value.index(")")].split()[:2]
            return float(lat), float(lon)
        lat, lon = value.split(",")[:2]
        return float(lat), float(lon)
    return float(value[1]), float(value[0])
