"""Geometry as GeoJSON text: reading WKT, merging parts, point in polygon, projection."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
_KINDS = {"POINT": "Point", "MULTIPOINT": "MultiPoint", "LINESTRING": "LineString", "MULTILINESTRING": "MultiLineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon"}
_POINT = rf"(?i)^\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*\s*\)\s*$"


def wkt_to_geojson(text: str) -> str | None:
    """Compact GeoJSON with two coordinates a point, or None for what is empty, unbalanced or of another kind."""
    head = re.match(r"\s*([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", text, re.DOTALL)
    if not head or head[1].upper() not in _KINDS:
        return None
    kind = _KINDS[head[1].upper()]
    # points become lists, and the brackets of WKT those of JSON
    listed = re.sub(rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*", r"[\1,\2]", head[2]).replace("(", "[").replace(")", "]")
    try:
        found = json.loads(listed)
    except ValueError:
        return None
    depth = {"Point": 2, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}[kind]
    if kind == "MultiPoint":
        found = [p[0] if p and isinstance(p[0], list) else p for p in found]

    def level(x: object) -> int:
        return 1 + level(x[0]) if isinstance(x, list) and x else 0

    if level(found) != depth:
        return None
    return json.dumps({"type": kind, "coordinates": found[0] if kind == "Point" else found}, separators=(",", ":"))


def geojson_from_wkt(c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else wkt_to_geojson(t))

    return read(c)


def wkt_xy(c: Column) -> tuple[Column, Column]:
    """x and y of a WKT point, null for anything else."""
    part = lambda i: F.nullif(F.regexp_extract(c, _POINT, i), F.lit("")).try_cast("double")
    return part(1), part(2)


def point_text(c: Column) -> Column:
    """``x y`` of a WKT point as it is written, null for anything else."""
    x = F.nullif(F.regexp_extract(c, _POINT, 1), F.lit(""))
    return F.when(x.isNotNull(), F.concat_ws(" ", x, F.regexp_extract(c, _POINT, 2)))


def merge_polygons(rows: DataFrame, by: list[str], geometry: str) -> DataFrame:
    """All polygon parts of a group as one Polygon or MultiPolygon; text that is neither is skipped, nothing left is null."""
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    parts = F.when(kind == "Polygon", F.concat(F.lit("["), raw, F.lit("]"))).when(kind == "MultiPolygon", raw)
    each = rows.select(*by, F.explode_outer(F.from_json(parts, "array<array<array<array<double>>>>")).alias("part"))
    shapes = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.to_json("part"))).alias("parts"))
    text = F.array_join("parts", ",")
    merged = F.when(F.size("parts") == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), text, F.lit("}"))).when(
        F.size("parts") > 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), text, F.lit("]}"))
    )
    return shapes.select(*by, merged.alias("geometry"))


def covers(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a polygon (outer ring, then holes) covers points; its border counts as inside."""
    inside, border = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    for ring in rings:
        ax, ay = ring[:-1, 0], ring[:-1, 1]
        for x0, y0, x1, y1 in zip(ax, ay, ring[1:, 0], ring[1:, 1], strict=True):
            cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
            on = (cross == 0) & (np.minimum(x0, x1) <= x) & (x <= np.maximum(x0, x1)) & (np.minimum(y0, y1) <= y) & (y <= np.maximum(y0, y1))
            border |= on
            if y0 != y1:
                hit = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
                inside ^= hit
    return inside | border


def stamp_points(points: DataFrame, polygons: DataFrame, cell: float = 0.0) -> DataFrame:
    """``points`` (id, x, y) with the ``code`` of the first polygon (kind, code, priority, geometry) of each kind that covers them.

    With ``cell`` above 0, polygons are dealt to the grid cells that their boxes touch and points join on their cell, so
    that neither side need be small; without, polygons are broadcast if they are few, which is checked.
    """
    shape = F.from_json("geometry", "struct<type:string,coordinates:string>")
    parts = F.when(F.get_json_object("geometry", "$.type") == "Polygon", F.concat(F.lit("["), shape["coordinates"], F.lit("]"))).otherwise(shape["coordinates"])
    each = polygons.select("kind", "code", "priority", F.explode(F.from_json(parts, "array<array<array<array<double>>>>")).alias("rings"))
    xs, ys = F.transform(F.element_at("rings", 1), lambda p: p[0]), F.transform(F.element_at("rings", 1), lambda p: p[1])
    boxed = each.select("*", F.monotonically_increasing_id().alias("polygon"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    near = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    if cell > 0:
        grid = lambda c: F.floor(F.col(c) / cell)
        boxed = boxed.withColumn("cx", F.explode(F.sequence(grid("x0"), grid("x1")))).withColumn("cy", F.explode(F.sequence(grid("y0"), grid("y1"))))
        pairs = points.withColumn("cx", grid("x")).withColumn("cy", grid("y")).join(boxed, ["cx", "cy"]).filter(near)
    else:
        from ..operators.sized import is_small

        if not is_small(boxed, 10_000):
            raise ValueError("so many polygons need a cell size")
        pairs = points.join(F.broadcast(boxed), near)

    @F.pandas_udf(T.BooleanType())
    def inside(x: pd.Series, y: pd.Series, polygon: pd.Series, rings: pd.Series) -> pd.Series:
        out, x, y = np.zeros(len(x), dtype=bool), x.to_numpy(), y.to_numpy()
        for at in polygon.groupby(polygon).indices.values():
            out[at] = covers([np.array([list(p) for p in ring]) for ring in rings.iloc[at[0]]], x[at], y[at])
        return pd.Series(out)

    hit = pairs.filter(inside("x", "y", "polygon", "rings"))
    return hit.groupBy("id", "kind").agg(F.min_by("code", F.struct("priority", "code")).alias("code"))


def utm32(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in UTM zone 32 of degrees, by the transverse Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - 9.0)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, big_a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (big_a + (1 - t + c) * F.pow(big_a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(big_a, 5) / 120) + 500000
    north = k0 * (
        m
        + n * F.tan(phi) * (F.pow(big_a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(big_a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(big_a, 6) / 720)
    )
    return east, north


def simplified(points: list[list[float]], tolerance: float) -> list[list[float]]:
    """A line without the points that lie within ``tolerance`` of the chord that replaces them (Douglas and Peucker); its ends stay."""
    if len(points) < 3:
        return points
    xy = np.array(points, dtype=float)
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(xy) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord, off = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        length2 = float(chord @ chord)
        along = np.clip(off @ chord / length2, 0, 1) if length2 else np.zeros(len(off))
        far = np.hypot(*(off - along[:, None] * chord).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return xy[keep].tolist()


def _area(ring: list[list[float]]) -> float:
    x, y = np.array(ring, dtype=float)[:, :2].T
    return abs(float(x[:-1] @ y[1:] - x[1:] @ y[:-1])) / 2


def simplify_geojson(text: str, share: float = 2000.0) -> str:
    """A (Multi)Polygon with rings simplified to the root of its area over ``share``; a ring that would collapse stays as it is."""
    shape = json.loads(text)
    if shape.get("type") not in ("Polygon", "MultiPolygon"):
        return text
    many = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
    tolerance = (sum(_area(p[0]) - sum(map(_area, p[1:])) for p in many)) ** 0.5 / share

    def ring(points: list) -> list:
        half = len(points) // 2  # a closed ring has no chord of its own
        out = simplified(points[: half + 1], tolerance)[:-1] + simplified(points[half:], tolerance)
        return out if len(out) >= 4 else points

    done = [[ring(r) for r in p] for p in many]
    return json.dumps({"type": shape["type"], "coordinates": done if shape["type"] == "MultiPolygon" else done[0]}, separators=(",", ":"))


def united(parts: list[list[list[list[float]]]]) -> list[list[list[list[float]]]]:
    """Polygons (rings of points) whose shared borders are dissolved.

    Parts of one area meet along the same vertices or not at all. Directed edges that occur in both directions are inside
    and go; the rest closes to rings, the counter-clockwise ones outer, each hole with the smallest outer ring that covers it.
    """
    edges: dict[tuple, list[tuple]] = {}
    there: set[tuple] = set()
    for polygon in parts:
        for k, points in enumerate(polygon):
            signed = sum((x0 * y1 - x1 * y0) for (x0, y0), (x1, y1) in zip(points, points[1:]))
            turned = points if (signed > 0) == (k == 0) else points[::-1]
            there ^= {(tuple(a), tuple(b)) for a, b in zip(turned, turned[1:]) if a != b}
    for a, b in sorted(e for e in there if e[::-1] not in there):
        edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = at = min(edges)
        ring = [start]
        while True:
            nexts = edges[at]
            if len(ring) > 1 and len(nexts) > 1:  # where borders touch, the sharpest left turn keeps rings apart
                (px, py), (x, y) = ring[-2], at
                turn = lambda q: np.arctan2((x - px) * (q[1] - y) - (y - py) * (q[0] - x), (x - px) * (q[0] - x) + (y - py) * (q[1] - y))
                after = max(nexts, key=turn)
            else:
                after = nexts[0]
            nexts.remove(after)
            if not nexts:
                del edges[at]
            ring.append(after)
            at = after
            if at == start or at not in edges:
                break
        rings.append([list(p) for p in ring])
    signed = [sum((x0 * y1 - x1 * y0) for (x0, y0), (x1, y1) in zip(r, r[1:])) for r in rings]
    outer = sorted((r for r, s in zip(rings, signed, strict=True) if s > 0), key=_area)
    out = [[r] for r in outer]
    for hole in (r for r, s in zip(rings, signed, strict=True) if s < 0):
        x, y = np.mean(np.array(hole[:-1]), axis=0)
        home = next((p for p in out if covers([np.array(p[0])], np.array([x]), np.array([y]))[0]), None)
        if home is not None:
            home.append(hole)
    return out


def union_areas(rows: DataFrame, by: str, geometry: str) -> DataFrame:
    """(by, geometry): the parts of each name dissolved into one shape and simplified; text that is no polygon is skipped.

    All parts of one name meet in one task, which a town's few parts allow.
    """
    merged = merge_polygons(rows.filter(F.col(by).isNotNull()), [by], geometry).filter("geometry is not null")

    @F.pandas_udf(T.StringType())
    def dissolve(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            shape = json.loads(text)
            parts = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
            done = sorted(united(parts))
            return simplify_geojson(json.dumps({"type": "Polygon", "coordinates": done[0]} if len(done) == 1 else {"type": "MultiPolygon", "coordinates": done}))

        return texts.map(one)

    return merged.select(by, dissolve("geometry").alias("geometry"))


def bounds(geometry: Column) -> Column:
    """(x0, y0, x1, y1) of any GeoJSON text with coordinates."""
    pairs = F.regexp_extract_all(F.get_json_object(geometry, "$.coordinates"), F.lit(rf"({NUMBER}),({NUMBER})"), F.lit(0))
    xs, ys = (F.transform(pairs, lambda p: F.split(p, ",")[0].cast("double")), F.transform(pairs, lambda p: F.split(p, ",")[1].cast("double")))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
