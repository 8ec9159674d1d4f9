"""Points and polygons in plain arrays: rings of (lon, lat), great-circle distance, containment."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

EARTH_KM = 6371.0088


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; within 0.5 % of the spheroid's."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def polygons(geojson: str) -> list[list[list[list[float]]]]:
    """Polygons of a GeoJSON geometry, each a list of rings; a single polygon becomes a list of one."""
    g = json.loads(geojson)
    return g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]


def _crossings(ring: list[list[float]], y: float) -> list[float]:
    return [x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]) if (y0 > y) != (y1 > y)]


def inside(shape: list, lon: float, lat: float) -> bool:
    """Even-odd rule over all rings, so holes count as outside."""
    return any(sum(x > lon for ring in polygon for x in _crossings(ring, lat)) % 2 for polygon in shape)


def point_on_surface(shape: list) -> tuple[float, float]:
    """A point within the shape: the middle of its widest stretch, over scan lines through each polygon."""
    best = (-1.0, 0.0, 0.0)
    for polygon in shape:
        ys = sorted({y for ring in polygon for _, y in ring})
        lines = [(a + b) / 2 for a, b in zip(ys, ys[1:])] or ys
        middle = (ys[0] + ys[-1]) / 2
        for y in sorted(lines, key=lambda v: abs(v - middle))[:9]:
            xs = sorted(x for ring in polygon for x in _crossings(ring, y))
            for a, b in zip(xs[::2], xs[1::2]):
                best = max(best, (b - a, (a + b) / 2, y))
    return best[1], best[2]


_POINT = StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])


@F.pandas_udf(_POINT)
def surface_point(geojson: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([point_on_surface(polygons(g)) if g else (None, None) for g in geojson], columns=["lon", "lat"])


@F.pandas_udf(BooleanType())
def contains_point(geojson: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else inside(polygons(g), x, y) for g, x, y in zip(geojson, lon, lat)])


def outside(places: DataFrame) -> DataFrame:
    """How many places (geojson, lon, lat) have their point outside their shape."""
    return places.agg(F.count_if(~contains_point("geojson", "lon", "lat")).alias("n_outside"))


def load_shapes(reference: DataFrame, features: DataFrame, fixes: dict[str, str], key: str = "name") -> DataFrame:
    """reference with the geometry of features (name, geojson) by normalised name; a partial match refuses the whole load."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"[\s\-]+", ""))
    fixed = F.col("name")
    for a, b in fixes.items():
        fixed = F.when(F.col("name") == a, b).otherwise(fixed)
    shapes = features.select(norm(fixed).alias("__k"), "geojson")
    missing = reference.join(shapes, norm(F.col(key)) == F.col("__k"), "left_anti").count()
    if missing:
        raise ValueError(f"{missing} of the reference's places have no shape")
    return reference.withColumn("__k", norm(F.col(key))).join(shapes, "__k").drop("__k")


def features(df: DataFrame, column: str = "value") -> DataFrame:
    """(name, geojson) of the features of GeoJSON collections, one collection in a row."""
    shape = "features array<struct<properties:map<string,string>, geometry:string>>"
    rows = df.select(F.explode(F.from_json(column, shape)["features"]).alias("f"))
    return rows.select(F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["NAME_1"]).alias("name"), F.col("f.geometry").alias("geojson"))


def region_points(shapes: DataFrame, region: str) -> DataFrame:
    """(region, lon, lat): a point within the union of a region's shapes (geojson); shapes of one region do not overlap, so all their polygons are the union."""
    joined = shapes.groupBy(region).agg(F.array_sort(F.collect_list("geojson")).alias("parts"))

    @F.pandas_udf(_POINT)
    def run(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([point_on_surface([p for g in x for p in polygons(g)]) for x in parts], columns=["lon", "lat"])

    return joined.select(region, run("parts").alias("p")).select(region, "p.lon", "p.lat")
