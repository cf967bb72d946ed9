"""Points on the globe: distance, nearest, radius, bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import values as V

EARTH_M = 6_371_008.8


def distance(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Haversine metres."""
    half = F.pow(F.sin(F.radians(lat - at_lat) / 2), 2) + math.cos(math.radians(at_lat)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - at_lon) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def points(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """Rows with both coordinates, as doubles named lat and lon."""
    return df.withColumns({"lat": lat.try_cast("double"), "lon": lon.try_cast("double")}).where("lat is not null and lon is not null")


def nearest(df: DataFrame, id_col: str, at_lat: float, at_lon: float, k: int = 5) -> DataFrame:
    return df.select(id_col, distance(F.col("lat"), F.col("lon"), at_lat, at_lon).alias("distance")).orderBy("distance", id_col).limit(k)


def within(df: DataFrame, id_col: str, at_lat: float, at_lon: float, metres: float) -> DataFrame:
    """Rows within a distance. A band of latitudes, which a scan can push down, comes before the distance."""
    band = math.degrees(metres / EARTH_M) + 1e-9
    near = df.where(F.col("lat").between(at_lat - band, at_lat + band))
    return near.select(id_col, distance(F.col("lat"), F.col("lon"), at_lat, at_lon).alias("distance")).where(F.col("distance") <= metres)


def bounds(df: DataFrame, padding: float = 1.2, least: float = 0.01) -> DataFrame:
    """One row: the centre and the padded spans of all points; nulls if there are none."""
    box = df.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    return box.select(*[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"center_{c}") for c in ("lat", "lon")], *[F.greatest((F.col(f"max_{c}") - F.col(f"min_{c}")) * padding, F.lit(least)).alias(f"span_{c}") for c in ("lat", "lon")])


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, V.fixed(metres, 0, " m")).otherwise(V.fixed(metres / 1000, 1, " km"))
