"""Placed things: nearest neighbours, merged sites, medoids, catchments (OP-J06, J13..J15, G05, G13..G17, C22, H17, H29)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geometry import M_PER_DEGREE, distance_to_edge_m
from plinth.functions.values import finite
from plinth.operators import ranks, spatial
from plinth.session import cut


def nearest_within(points: DataFrame, point_id: Column, lon: Column, lat: Column, centres: DataFrame, ref_id: Column, c_lon: Column, c_lat: Column, radius_m: float) -> DataFrame:
    """OP-J14: rows (point_id, ref_id, distance_m): the nearest centre within a radius, the smaller ref_id of equals."""
    pairs = spatial.near(points, point_id, lon, lat, centres, ref_id, c_lon, c_lat, F.lit(radius_m))
    return pairs.groupBy("point_id").agg(F.min(F.struct("distance_m", "ref_id")).alias("m")).select("point_id", "m.ref_id", "m.distance_m")


def nearest(points: DataFrame, point_id: Column, lon: Column, lat: Column, centres: DataFrame, ref_id: Column, c_lon: Column, c_lat: Column, first_m: float = 2000.0) -> DataFrame:
    """OP-J06: rows (point_id, ref_id, distance_m): the nearest centre of every point, however far, the smaller ref_id of equals.

    Rings grow fourfold from first_m; each round looks at the points that are still without a centre only, in cells around the centres,
    so no point meets all of them. The rounds end when every point has one, at the latest with half the globe.
    """
    left = spatial._placed(points, point_id, lon, lat).dropDuplicates(["point_id"])
    found, radius = None, first_m
    while True:
        left = cut(left)
        got = cut(nearest_within(left, F.col("point_id"), F.col("lon"), F.col("lat"), centres, ref_id, c_lon, c_lat, radius))
        found = got if found is None else found.unionByName(got)
        left = left.join(got, "point_id", "left_anti")
        if radius > math.pi * spatial.EARTH_M or left.isEmpty():
            return found
        radius *= 4


def region_or_nearest(points: DataFrame, point_id: Column, lon: Column, lat: Column, edges: DataFrame, most_m: float) -> DataFrame:
    """OP-J12, J13: rows (point_id, ref_id, basis): the first region that holds a point, else the nearest one within most_m.

    The second step joins the remaining points with edges in the cells around them; edges are spread over the cells that their box,
    widened by most_m, meets.
    """
    held = spatial.inside(points, point_id, lon, lat, edges).groupBy("point_id").agg(F.min("ref_id").alias("ref_id"))
    spots = points.select(point_id.alias("point_id"), finite(lon).alias("lon"), finite(lat).alias("lat")).where("lon is not null and lat is not null").distinct()
    left = spots.join(held, "point_id", "left_anti")
    near = _beside(left, edges, most_m)
    close = near.groupBy("point_id").agg(F.min(F.struct("d", "ref_id")).alias("m")).select("point_id", "m.ref_id", F.lit("nearest").alias("basis"))
    return held.select("point_id", "ref_id", F.lit("inside").alias("basis")).unionByName(close)


def region_distances(points: DataFrame, point_id: Column, lon: Column, lat: Column, edges: DataFrame, most_m: float) -> DataFrame:
    """OP-G07: rows (point_id, ref_id, distance_m): every region within most_m of a point, at 0 m where it holds the point."""
    spots = points.select(point_id.alias("point_id"), finite(lon).alias("lon"), finite(lat).alias("lat")).where("lon is not null and lat is not null").distinct()
    near = _beside(spots, edges, most_m).groupBy("point_id", "ref_id").agg(F.min("d").alias("distance_m"))
    held = spatial.inside(points, point_id, lon, lat, edges).select("point_id", "ref_id", F.lit(0.0).alias("distance_m"))
    return near.unionByName(held).groupBy("point_id", "ref_id").agg(F.min("distance_m").alias("distance_m"))


def along_lines(points: DataFrame, point_id: Column, lon: Column, lat: Column, pieces: DataFrame, most_m: float) -> DataFrame:
    """OP-J15: rows (point_id, ref_id, first_position): points within most_m of a line, with its first piece that comes so close.

    pieces: (ref_id, position, ax, ay, bx, by). Pieces go to the cells that their box, widened by most_m, meets.
    """
    spots = points.select(point_id.alias("point_id"), finite(lon).alias("lon"), finite(lat).alias("lat")).where("lon is not null and lat is not null").distinct()
    near = _beside(spots, pieces, most_m)
    return near.groupBy("point_id", "ref_id").agg(F.min("position").alias("first_position"))


def _beside(spots: DataFrame, edges: DataFrame, most_m: float) -> DataFrame:
    """spots joined with the edges within most_m of them, and the distance d."""
    cell = max(most_m / M_PER_DEGREE, 0.005)
    pad_y = F.lit(most_m / M_PER_DEGREE)
    pad_x = pad_y / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("ay"), F.abs("by")) + pad_y)))
    span = lambda a, b, pad: F.sequence(F.floor((F.least(a, b) - pad) / cell), F.floor((F.greatest(a, b) + pad) / cell))
    binned = edges.withColumn("cx", F.explode(span("ax", "bx", pad_x))).withColumn("cy", F.explode(span("ay", "by", pad_y)))
    placed = spots.withColumns({"cx": F.floor(F.col("lon") / cell), "cy": F.floor(F.col("lat") / cell)})
    return spatial._bin_join(placed, binned, ["cx", "cy"]).withColumn("d", distance_to_edge_m(F.col("lon"), F.col("lat"))).where(F.col("d") <= most_m)


def medoid(points: DataFrame, entity: str, lon: str, lat: str, order: str, most: int = 512) -> DataFrame:
    """OP-G05: rows (entity, lon, lat): the point of least total distance to the others of its entity, the first of equals.

    The distinct places of an entity are weighed by their number; entities of up to `most` places go through a grouped function in
    numpy, larger ones through distributed sums (see _large_medoids). Both are exact: `most` decides where it runs, not what comes out.
    """
    spots = points.groupBy(entity, lon, lat).agg(F.count(F.lit(1)).cast("double").alias("w"), F.min(order).alias("o"))
    n = spots.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    sized = spots.join(n, entity)
    kind = points.schema[entity].dataType.simpleString()

    def central(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("o")
        x, y, w = np.radians(p[lon].to_numpy()), np.radians(p[lat].to_numpy()), p["w"].to_numpy()
        a = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
        best = p.iloc[int((2 * spatial.EARTH_M * np.arcsin(np.sqrt(np.clip(a, 0, 1))) * w).sum(axis=1).round(6).argmin())]
        return pd.DataFrame({entity: [best[entity]], lon: [best[lon]], lat: [best[lat]], "basis": ["medoid"]})

    few = sized.where(F.col("n") <= most).groupBy(entity).applyInPandas(central, f"{entity} {kind}, {lon} double, {lat} double, basis string")
    parts = max(8, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = sized.where(F.col("n") > most).select(F.col(entity).alias("e"), F.col("o").alias("point_id"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), "w", "n")
    large = cut(large.repartition(parts, "e", "lon", "lat"))
    if large.isEmpty():
        return few
    return few.unionByName(_large_medoids(large).select(F.col("e").alias(entity), F.col("lon").alias(lon), F.col("lat").alias(lat), F.lit("medoid").alias("basis")))


def _large_medoids(spots: DataFrame) -> DataFrame:
    """Rows (e, lon, lat) of spots (e, point_id, lon, lat, w, n): the exact medoid of each entity without all pairs of its places.

    An entity's places are folded into cells between quantiles of both coordinates, about 2 n^(1/4) a side. The chord from a
    candidate to the weighted mean of a cell in space, times the weight of the cell, is never more than the sum of the distances to its places
    (triangle inequality), so the sum over all cells bounds the candidate's total from below. Candidates whose bound is above the
    true total of the most promising one drop out; the true totals of the others, over all places, decide. However many are left,
    the result is the same.
    """
    steps = 128
    at = [i / steps for i in range(1, steps)]
    quantiles = spots.groupBy("e").agg(F.percentile_approx("lon", at).alias("px"), F.percentile_approx("lat", at).alias("py"), F.sum("w").alias("whole"))
    side = F.least(F.lit(steps), F.ceil(2 * F.pow("n", F.lit(0.25))))
    cell = lambda cuts, v: F.floor(F.size(F.filter(cuts, lambda c: c <= F.col(v))) * side / steps)
    space = [(spatial.EARTH_M * x).alias(n) for x, n in zip(spatial._xyz(F.col("lon"), F.col("lat")), "xyz", strict=True)]
    binned = spots.join(quantiles, "e").select("e", "w", *space, cell("px", "lon").alias("cx"), cell("py", "lat").alias("cy"))
    cells = binned.groupBy("e", "cx", "cy").agg(*((F.sum(F.col(n) * F.col("w")) / F.sum("w")).alias(f"m{n}") for n in "xyz"), F.sum("w").alias("held"))
    chord = F.sqrt(sum((F.pow(F.col(n) - F.col(f"m{n}"), F.lit(2.0)) for n in "xyz"), F.lit(0.0)))
    pairs = spatial._bin_join(spots.select("e", "point_id", "lon", "lat", *space), cells.drop("cx", "cy"), ["e"])
    low = cut(pairs.groupBy("e", "point_id", "lon", "lat").agg(F.sum(F.col("held") * chord).alias("low")))

    def totals(candidates: DataFrame) -> DataFrame:
        named = candidates.select("e", F.col("point_id").alias("c_id"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
        d = spatial.haversine_m(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))
        return spatial._bin_join(spots, named, ["e"]).groupBy("e", "c_id", "c_lon", "c_lat").agg(F.sum(F.col("w") * d).alias("total"))

    first = low.groupBy("e").agg(F.min(F.struct("low", "point_id", "lon", "lat")).alias("m")).select("e", "m.point_id", "m.lon", "m.lat")
    # Room for rounding: a tenth of a millimetre for each point, and 1e-9 of the total.
    most = totals(first).join(quantiles.select("e", "whole"), "e").select("e", (F.col("total") * (1 + 1e-9) + F.col("whole") * 1e-4).alias("most"))
    left = cut(low.join(most, "e").where(F.col("low") <= F.col("most")))
    best = totals(left).groupBy("e").agg(F.min(F.struct(F.round("total", 6).alias("d"), F.col("c_id"), F.col("c_lon"), F.col("c_lat"))).alias("m"))
    return best.select("e", F.col("m.c_lon").alias("lon"), F.col("m.c_lat").alias("lat"))


def merged_sites(points: DataFrame, entity: str, lon: str, lat: str, weight: str, order: str, within_m: float = 100.0) -> DataFrame:
    """OP-G13: rows (entity, site_no, lon, lat, weight): points taken in their order, each joining the first site within within_m.

    A site stands where its first point stands; weights add up, and an unknown one makes the sum unknown. Equal places are folded
    first. The places of an entity then stream through one task in their order, batch by batch; only the sites found so far are held.
    """
    unknown = F.max(F.col(weight).isNull())
    spots = points.where(F.col(entity).isNotNull()).groupBy(entity, lon, lat).agg(F.when(~unknown, F.sum(weight)).cast("double").alias("w"), F.min(order).alias("o"))
    kind = points.schema[entity].dataType.simpleString()
    names = [entity, "site_no", lon, lat, "weight"]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, xs, ys, ws = None, [], [], []
        done: list[tuple] = []

        def close() -> None:
            done.extend((now, i, x, y, None if np.isnan(w) else w) for i, (x, y, w) in enumerate(zip(xs, ys, ws, strict=True), 1))

        for batch in batches:
            for e, x, y, w in zip(batch[entity], batch[lon], batch[lat], batch["w"], strict=True):
                if e != now:
                    close()
                    now, xs, ys, ws = e, [], [], []
                if xs:
                    sy, sx = np.array(ys), np.array(xs)
                    a = np.sin(np.radians(sy - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(sy)) * np.sin(np.radians(sx - x) / 2) ** 2
                    hit = np.flatnonzero(2 * spatial.EARTH_M * np.arcsin(np.sqrt(np.clip(a, 0, 1))) <= within_m)
                    if len(hit):
                        ws[hit[0]] += w
                        continue
                xs.append(x), ys.append(y), ws.append(w)
            yield pd.DataFrame(done, columns=names).astype({"site_no": "int32"})
            done = []
        close()
        yield pd.DataFrame(done, columns=names).astype({"site_no": "int32"})

    ordered = spots.repartition(entity).sortWithinPartitions(entity, "o")
    return ordered.mapInPandas(merge, f"{entity} {kind}, site_no int, {lon} double, {lat} double, weight double")


def grid_around(centres: DataFrame, ref_id: Column, lon: Column, lat: Column, radius_m: Column, step_m: float) -> DataFrame:
    """OP-G15: rows (ref_id, i, j, lon, lat): the cell centres of a square grid within a radius of each centre."""
    k = F.ceil(F.col("r") / step_m).cast("int")
    rows = centres.select(ref_id.alias("ref_id"), lon.alias("x"), lat.alias("y"), radius_m.cast("double").alias("r")).where("r >= 0 and x is not null and y is not null")
    rows = rows.withColumn("i", F.explode(F.sequence(-k, k))).withColumn("j", F.explode(F.sequence(-k, k))).where(F.pow(F.col("i") * step_m, 2) + F.pow(F.col("j") * step_m, 2) <= F.col("r") * F.col("r"))
    return rows.select("ref_id", "i", "j", (F.col("x") + F.col("i") * step_m / (F.lit(M_PER_DEGREE) * F.cos(F.radians("y")))).alias("lon"), (F.col("y") + F.col("j") * step_m / M_PER_DEGREE).alias("lat"))


def grid_over(edges: DataFrame, step: float) -> DataFrame:
    """OP-G14, G16: rows (point_id, lon, lat): the cell centres of a grid over the box of all edges, one row per cell."""
    box = edges.agg(F.floor(F.min(F.least("ax", "bx")) / step).alias("x0"), F.floor(F.max(F.greatest("ax", "bx")) / step).alias("x1"), F.floor(F.min(F.least("ay", "by")) / step).alias("y0"), F.floor(F.max(F.greatest("ay", "by")) / step).alias("y1"))
    cells = box.where("x0 is not null").select(F.explode(F.sequence("x0", "x1")).alias("i"), "y0", "y1").select("i", F.explode(F.sequence("y0", "y1")).alias("j"))
    return cells.select(F.concat_ws(":", "i", "j").alias("point_id"), ((F.col("i") + 0.5) * step).alias("lon"), ((F.col("j") + 0.5) * step).alias("lat"))


def agreement(a: DataFrame, b: DataFrame, key: str, within_m: float) -> DataFrame:
    """OP-C22, A27: one row (n, median_m, close_pct): how far two placements (key, lon, lat) of the same things lie apart."""
    both = a.alias("a").join(b.alias("b"), key).select(spatial.haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")).alias("d"))
    middle = ranks.at(both, [], F.col("d"), ranks.middle).agg(F.round(F.sum(F.col("x") * F.col("hits")) / F.sum("hits"), 3).alias("median_m"))
    share = both.agg(F.count("d").alias("n"), (F.lit(100.0) * F.count_if(F.col("d") <= within_m) / F.count("d")).alias("close_pct"))
    return share.join(F.broadcast(middle)).select("n", "median_m", "close_pct")  # one row beside one row
