"""Points near other points and inside regions (OP-G01, OP-G02, OP-J12, OP-J14).

Near: every point falls into one cell of a grid over the unit sphere (x, y, z), so poles, the date line and coordinates out of
range need no care. A centre goes to the cells that the box of its own radius meets; an equi join on cells leaves few pairs
for the exact great-circle distance.

Inside: the edges of all regions are binned into latitude strips, points join the edges of their own strip, and the crossings
of the ray to the east are grouped by point and region; an odd number is inside. A point on an edge is counted by the half-open
rule (lower end in, upper end out, edge itself to the west), so that of two regions that share an edge exactly one holds it; `touching`
also tells the others.

The smaller side is broadcast when it is measured to be small; otherwise both sides are shuffled by cell or strip, points of
hot bins being spread by a salt over which the other side is repeated.

Defined results: points without two finite coordinates match nothing; repeated rows of one point count once; a radius that is
null or negative reaches nothing; a region without a ring holds nothing; rings are closed whether or not the last position
repeats the first; an empty side gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.values import finite
from plinth.session import BROADCAST_BYTES, measured

EARTH_M = 6_371_000.0
SALTS = 16
GEOJSON = "struct<type: string, coordinates: array<array<array<array<double>>>>>"


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """OP-G01: great-circle distance in metres on a sphere of 6,371,000 m."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def _xyz(lon: Column, lat: Column) -> list[Column]:
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def _placed(points: DataFrame, point_id: Column, lon: Column, lat: Column) -> DataFrame:
    return points.select(point_id.alias("point_id"), finite(lon).alias("lon"), finite(lat).alias("lat")).where("lon is not null and lat is not null")


def near(points: DataFrame, point_id: Column, lon: Column, lat: Column, centres: DataFrame, ref_id: Column, c_lon: Column, c_lat: Column, radius_m: Column) -> DataFrame:
    """Rows (ref_id, point_id, distance_m): every point within radius_m of a centre."""
    around = _placed(centres, F.struct(ref_id.alias("ref_id"), finite(radius_m.cast("double")).alias("r")), c_lon, c_lat)
    around = around.select("point_id.ref_id", "point_id.r", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat")).where("r >= 0")
    # Reaches of a class are up to 50 m, 100 m, 200 m and so on; its cells are as wide as its widest reach, so a reach meets at most two
    # of them along each axis, plus rounding, and one wide reach does not widen the cells of the others.
    around = around.withColumn("class", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("r"), F.lit(1e-9)) / 50))).cast("int"))
    classes = sorted(r["class"] for r in around.select("class").distinct().collect())  # at most 20: half the globe is 20,016 km
    width = lambda k: max(2 * math.sin(min(50.0 * 2**k / (2 * EARTH_M), math.pi / 2)), 50 / EARTH_M) * 2.000001
    cell = F.element_at(F.create_map(*(F.lit(x) for k in classes or [0] for x in (k, width(k)))), F.col("class"))
    chord = F.lit(2.000002) * F.sin(F.least(F.col("r") / (2 * EARTH_M), F.lit(math.pi / 2))) + 1e-12
    boxes = around.withColumn("cell", cell).select("*", *(x.alias(n) for n, x in zip("xyz", _xyz(F.col("c_lon"), F.col("c_lat")), strict=True)), chord.alias("h"))
    for n in "xyz":
        boxes = boxes.withColumn(f"c{n}", F.explode(F.sequence(F.floor((F.col(n) - F.col("h")) / F.col("cell")), F.floor((F.col(n) + F.col("h")) / F.col("cell")))))
    boxes = boxes.drop("x", "y", "z", "h", "cell")
    spots = _placed(points, point_id, lon, lat).withColumn("class", F.explode(F.array(*map(F.lit, classes)).cast("array<int>")))
    spots = spots.withColumn("cell", cell).select("*", *(F.floor(x / F.col("cell")).alias(f"c{n}") for n, x in zip("xyz", _xyz(F.col("lon"), F.col("lat")), strict=True))).drop("cell")
    pairs = _bin_join(spots, boxes, ["class", "cx", "cy", "cz"])
    d = haversine_m(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat"))
    return pairs.select("ref_id", "point_id", "r", d.alias("distance_m")).where("distance_m <= r").groupBy("ref_id", "point_id").agg(F.min("distance_m").alias("distance_m"))


def _bin_join(spots: DataFrame, binned: DataFrame, on: list[str]) -> DataFrame:
    side, size = measured(binned)
    if size <= BROADCAST_BYTES:
        return spots.join(F.broadcast(side), on)
    salted = spots.withColumn("salt", F.pmod(F.xxhash64("point_id", "lon", "lat"), F.lit(SALTS)))
    return salted.join(side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [*on, "salt"]).drop("salt")


def edges(regions: DataFrame, ref_id: Column, geojson: Column) -> DataFrame:
    """Rows (ref_id, ax, ay, bx, by): the edges of every ring of Polygons and MultiPolygons given as GeoJSON text."""
    shape = F.when(
        F.get_json_object(geojson, "$.type") == "Polygon",
        F.array(F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>")),
    ).otherwise(F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<array<double>>>>"))
    rings = regions.select(ref_id.alias("ref_id"), F.explode(shape).alias("polygon")).select("ref_id", F.explode("polygon").alias("ring"))
    pairs = rings.where(F.size("ring") > 2).select("ref_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)).alias("b"))).alias("e"))
    at = lambda side, i: F.get(F.col(f"e.{side}"), F.lit(i))
    return pairs.select("ref_id", at("a", 0).alias("ax"), at("a", 1).alias("ay"), at("b", 0).alias("bx"), at("b", 1).alias("by")).where("ay is not null and by is not null and ax is not null and bx is not null")


def inside(points: DataFrame, point_id: Column, lon: Column, lat: Column, sides: DataFrame, strip: float = 0.01, touching: bool = False) -> DataFrame:
    """Rows (ref_id, point_id, on_edge): every region, given by its edges, that holds a point; strip is in degrees.

    A point on an edge belongs to the region above or to the right of it (ends of edges: lower ones in, upper ones out), so that one of
    two neighbours holds it, and none does on the upper and right sides of the outermost. touching: also the regions on whose edges or
    corners a point lies without being held, with a column `held`.
    """
    binned = sides.withColumn("strip", F.explode(F.sequence(F.floor(F.least("ay", "by") / strip), F.floor(F.greatest("ay", "by") / strip))))
    # One row per place of a point. The parity groups hold the same columns, so this is the only shuffle of the points.
    spots = _placed(points, point_id, lon, lat).dropDuplicates(["point_id", "lon", "lat"])
    spots = spots.withColumn("strip", F.floor(F.col("lat") / strip))
    x, y = F.col("lon"), F.col("lat")
    straddles = (F.col("ay") > y) != (F.col("by") > y)
    level = (F.col("ay") == y) & (F.col("by") == y) & x.between(F.least("ax", "bx"), F.greatest("ax", "bx"))
    corner = (F.col("ay") == y) & (F.col("ax") == x)  # each corner begins one edge
    pairs = _bin_join(spots, binned, ["strip"]).where((straddles & (x <= F.greatest("ax", "bx"))) | level | corner)
    # Division by zero cannot happen: a level edge does not straddle.
    cross_x = F.when(straddles, F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.when(straddles, F.col("by") - F.col("ay")))
    met = pairs.withColumn("cross_x", cross_x).where(level | corner | (x <= F.col("cross_x")))
    counted = met.groupBy("point_id", "lon", "lat", "ref_id").agg(
        F.count(F.when(x < F.col("cross_x"), 1)).alias("n"), F.max(level | corner | F.coalesce(x == F.col("cross_x"), F.lit(False))).alias("on_edge")
    )
    held = counted.withColumn("held", F.col("n") % 2 == 1).where("held or on_edge" if touching else "held")
    return held.groupBy("ref_id", "point_id").agg(F.max("on_edge").alias("on_edge"), *([F.max("held").alias("held")] if touching else []))
