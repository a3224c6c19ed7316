"""Places: nearest things, regions, centroids, sites, shares by area (OP-G, OP-J06, J12..J15, A19, A23, A24, C02, C18, C22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import geometry
from plinth.functions.values import finite
from plinth.operators import areas, places, spatial
from plinth.plans.book import Book
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query
POINTS = "pts as (select point_id, fms_id, lon, lat from loc_cpdb_points where isfinite(lon) and isfinite(lat))"
IN_TOWN = "town as (select point_id, fms_id, lon, lat from loc_cpdb_points where lon between -75 and -73 and lat between 40 and 42)"
EDGES = """shapes as (select boro_cd, unnest(cast(json_extract(geojson, '$.coordinates') as double[][][][])) as polygon from ref_community_districts),
rings as (select boro_cd, unnest(polygon) as ring from shapes),
sides as (select boro_cd, ring[i] as a, ring[case when i = len(ring) then 1 else i + 1 end] as b from (select boro_cd, ring, unnest(range(1, len(ring) + 1)) as i from rings)),
edges as (select boro_cd, a[1] as ax, a[2] as ay, b[1] as bx, b[2] as by_ from sides)"""
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


def town(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "loc_cpdb_points").where(F.col("lon").between(-75, -73) & F.col("lat").between(40, 42)).select("point_id", "fms_id", "lon", "lat")


def district_edges(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.edges(table(spark, sf, "ref_community_districts"), F.col("boro_cd"), F.col("geojson"))


@query(f"""with {POINTS}, d as (select point_id, station_no, {HAV.format(a='s.lon', b='s.lat', c='p.lon', d='p.lat')} as m from pts p cross join station_reach s)
select point_id, station_no as ref_id, round(m, 3) as distance_m from d where m <= 1500 qualify row_number() over (partition by point_id order by m, station_no) = 1""")
def g01_nearest_station(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G01, J14: the nearest station within 1,500 m."""
    p, s = table(spark, sf, "loc_cpdb_points"), table(spark, sf, "station_reach")
    out = places.nearest_within(p, F.col("point_id"), F.col("lon"), F.col("lat"), s, F.col("station_no"), F.col("lon"), F.col("lat"), 1500.0)
    return out.withColumn("distance_m", F.round("distance_m", 3))


@query(f"""with {IN_TOWN}, d as (select point_id, boro_cd, {HAV.format(a='s.lon', b='s.lat', c='p.lon', d='p.lat')} as m from town p cross join ref_community_districts s)
select point_id, boro_cd from d qualify row_number() over (partition by point_id order by m, boro_cd) = 1""")
def j06_nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J06: the nearest label point, by growing rings of cells."""
    d = table(spark, sf, "ref_community_districts")
    found = places.nearest(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), d, F.col("boro_cd"), F.col("lon"), F.col("lat"))
    return found.select("point_id", F.col("ref_id").alias("boro_cd"))


@query(f"""with {IN_TOWN}, {EDGES}, held as (select point_id, min(boro_cd) as ref_id from (select boro_cd, point_id from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1) group by 1),
rest as (select * from town where point_id not in (select point_id from held)),
v as (select point_id, boro_cd, (ax - lon) * cos(radians(lat)) as ax, ay - lat as ay, (bx - lon) * cos(radians(lat)) as bx, by_ - lat as b_y from rest cross join edges),
t as (select *, case when (bx - ax) ** 2 + (b_y - ay) ** 2 > 0 then least(1.0, greatest(0.0, -(ax * (bx - ax) + ay * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) else 0.0 end as t from v),
m as (select point_id, boro_cd, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2)) * 6371000.0 * pi() / 180) as d from t group by all)
select point_id, ref_id, 'inside' as basis from held union all select point_id, boro_cd, 'nearest' from (select * from m where d <= 2000 qualify row_number() over (partition by point_id order by d, boro_cd) = 1)""")
def j13_region_or_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J12, J13, G02, G07: the containing district, else the nearest one within 2 km."""
    return places.region_or_nearest(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf), 2000.0)


@query(f"""with {EDGES}, e as (select boro_cd, ax + 74.0 as x0, ay - 40.7 as y0, bx + 74.0 as x1, by_ - 40.7 as y1 from edges), s as (select boro_cd, sum(x0 * y1 - x1 * y0) / 2 as a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) as mx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) as my from e group by 1)
select boro_cd, round(mx / (6 * a) - 74.0, 6) as lon, round(my / (6 * a) + 40.7, 6) as lat, round(abs(a) * pow(6371000.0 * pi() / 180, 2) * cos(radians(my / (6 * a) + 40.7)), 0) as area_m2 from s""")
def g03_centroid_area(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G03, G08: centroid and area from sums over edges."""
    m = geometry.moments(district_edges(spark, sf))
    return m.select(F.col("ref_id").alias("boro_cd"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("area_m2", 0).alias("area_m2"))


@query(f"""with {EDGES}, e as (select boro_cd, ax + 74.0 as x0, ay - 40.7 as y0, bx + 74.0 as x1, by_ - 40.7 as y1 from edges), s as (select boro_cd, sum(x0 * y1 - x1 * y0) / 2 as a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) as mx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) as my from e group by 1),
c as (select boro_cd, mx / (6 * a) - 74.0 as lon, my / (6 * a) + 40.7 as lat from s), h as (select c.boro_cd from c join edges using (boro_cd) where (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by 1 having count(*) % 2 = 1)
select boro_cd, true as inside, case when h.boro_cd is not null then round(lon, 5) end as lon, case when h.boro_cd is not null then round(lat, 5) end as lat from c left join h using (boro_cd)""")
def g04_label_point(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G04: is the label point inside its district, by the parity of crossings; and where it is, if the centroid of the whole shape is
    inside (otherwise it is the inmost point of the largest part, and left out here)."""
    d, sides = table(spark, sf, "ref_community_districts").select("boro_cd", "geojson"), district_edges(spark, sf)
    at = lambda df: spatial.inside(df, F.col("boro_cd"), F.col("lon"), F.col("lat"), sides).where("ref_id = point_id").select(F.col("point_id").alias("boro_cd"), F.lit(True).alias("held"))
    labels = d.select("boro_cd", geometry.label_point("geojson").alias("p")).select("boro_cd", "p.*")
    central = at(geometry.moments(sides).select(F.col("ref_id").alias("boro_cd"), "lon", "lat")).withColumnRenamed("held", "central")
    both = labels.join(at(labels), "boro_cd", "left").join(central, "boro_cd", "left")
    shown = lambda c: F.when(F.col("central"), F.round(c, 5)).alias(c)
    return both.select("boro_cd", F.coalesce("held", F.lit(False)).alias("inside"), shown("lon"), shown("lat"))


@query(f"""with {IN_TOWN}, u as (select fms_id, lon, lat, count(*) as w, min(point_id) as o from town group by all), d as (select a.fms_id, a.o, a.lon, a.lat, round(sum(b.w * {HAV.format(a='b.lon', b='b.lat', c='a.lon', d='a.lat')}), 6) as m from u a join u b on a.fms_id = b.fms_id group by all)
select fms_id, lon, lat, 'medoid' as basis from d qualify row_number() over (partition by fms_id order by m, o) = 1""")
def g05_medoid(spark: SparkSession, sf: str) -> DataFrame:
    return places.medoid(town(spark, sf).where("fms_id is not null"), "fms_id", "lon", "lat", "point_id")


@query(f"with {IN_TOWN} select fms_id, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat, count(*) as n from town group by 1")
def g06_mean_point(spark: SparkSession, sf: str) -> DataFrame:
    return town(spark, sf).groupBy("fms_id").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("n"))


@query()
def g13_merged_sites(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G13, H29: points of a project within 100 m of each other as one site (order-dependent, so without SQL)."""
    return places.merged_sites(town(spark, sf).where("fms_id is not null").withColumn("weight", F.lit(1.0)), "fms_id", "lon", "lat", "weight", "point_id")


@query(f"""with {IN_TOWN} select cast(floor(lon / 0.01) as bigint) as cx, cast(floor(lat / 0.01) as bigint) as cy, count(*) as n, count(distinct fms_id) as projects from town group by all""")
def g14_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return town(spark, sf).groupBy(F.floor(F.col("lon") / 0.01).alias("cx"), F.floor(F.col("lat") / 0.01).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fms_id").alias("projects"))


@query(f"""with {EDGES}, k as (select station_no, lon, lat, cast(radius_m as double) as r, cast(ceil(radius_m / 100.0) as integer) as k from station_reach),
ij as (select station_no, lon, lat, r, k, unnest(range(-k, k + 1)) as i from k), c as (select *, unnest(range(-k, k + 1)) as j from ij),
cells as (select station_no, i, j, lon + i * 100.0 / (6371000.0 * pi() / 180 * cos(radians(lat))) as x, lat + j * 100.0 / (6371000.0 * pi() / 180) as y from c where pow(i * 100.0, 2) + pow(j * 100.0, 2) <= r * r),
hit as (select station_no, i, j, boro_cd from cells join edges on (ay > y) <> (by_ > y) and x < ax + (y - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1),
n as (select station_no, boro_cd, count(*) as cells from hit group by all)
select station_no, boro_cd, cells, cells / sum(cells) over (partition by station_no) as share from n""")
def g15_catchment(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G15, H19: the share of each station's reach in every district, on a 100 m grid."""
    s = table(spark, sf, "station_reach")
    cells = places.grid_around(s, F.col("station_no"), F.col("lon"), F.col("lat"), F.col("radius_m"), 100.0).select(F.struct("ref_id", "i", "j").alias("cell"), "lon", "lat")
    hit = spatial.inside(cells, F.col("cell"), F.col("lon"), F.col("lat"), district_edges(spark, sf))
    n = hit.groupBy(F.col("point_id.ref_id").alias("station_no"), F.col("ref_id").alias("boro_cd")).agg(F.count(F.lit(1)).alias("cells"))
    return areas.normalised(n, ["station_no"], "cells")


@query("""select point_id, case when lon is null or lat is null or isnan(lon) or isnan(lat) then 'no coordinates' when lon between -75 and -73 and lat between 40 and 42 then null when lat between -75 and -73 and lon between 40 and 42 then 'swapped'
when -lon between -75 and -73 and lat between 40 and 42 then 'sign' when lon between -75 and -73 and lat / 10 between 40 and 42 then 'decimal point' else 'outside' end as problem from loc_cpdb_points""")
def g19_repaired_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "loc_cpdb_points").select("point_id", geometry.repaired_point(F.col("lon"), F.col("lat"), -75, 40, -73, 42)["problem"].alias("problem"))


@query("""with r as (select station_no, lon, lat, radius_m / (6371000.0 * pi() / 180) as s from station_reach) select station_no, round(lon + s / cos(radians(lat)), 7) as east, round(lat + s, 7) as north from r""")
def g20_circle_ring(spark: SparkSession, sf: str) -> DataFrame:
    ring = geometry.circle(F.col("lon"), F.col("lat"), F.col("radius_m"))
    return table(spark, sf, "station_reach").select("station_no", ring.alias("ring")).select("station_no", F.round(F.col("ring")[0][0], 7).alias("east"), F.round(F.col("ring")[16][1], 7).alias("north"))


SHARES = f"""{IN_TOWN}, b as (select fms_id, max(case when isfinite(total_budget) then total_budget end) as budget from project_budget_schedule where reporting_period = 202605 group by 1),
sh as (select *, 1.0 / count(*) over (partition by fms_id) as share from town where fms_id is not null)"""


@query(f"""with {SHARES} select cast(floor(lon / 0.05) as bigint) as cx, cast(floor(lat / 0.05) as bigint) as cy, count(distinct sh.fms_id) as n, round(sum(budget * share), 2) as budget from sh join b using (fms_id) group by all""")
def a19_area_rollup_by_share(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C02, A19: budgets by the share of each site."""
    budget = table(spark, sf, "project_budget_schedule").where("reporting_period = 202605").groupBy("fms_id").agg(F.max(finite(F.col("total_budget"))).alias("budget"))
    sites = areas.site_shares(town(spark, sf).where("fms_id is not null").withColumn("weight", F.lit(None).cast("double")), "fms_id", "weight")
    cells = sites.join(budget, "fms_id").withColumns({"cx": F.floor(F.col("lon") / 0.05), "cy": F.floor(F.col("lat") / 0.05)})
    return areas.area_totals(cells, ["cx", "cy"], "fms_id", ["budget"])


@query("""with s as (select l_orderkey, l_linenumber, l_extendedprice, count(*) over w as n, min(l_extendedprice) over w <> max(l_extendedprice) over w and count(*) filter (l_extendedprice > 0) over w = count(*) over w as prop, sum(l_extendedprice) over w as t from lineitem window w as (partition by l_orderkey))
select l_orderkey, l_linenumber, case when prop then l_extendedprice / t else 1.0 / n end as share, case when n = 1 then 'single' when prop then 'proportional' else 'equal' end as basis from s""")
def c02_site_shares(spark: SparkSession, sf: str) -> DataFrame:
    return areas.site_shares(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "share", "basis")


@query(f"""with {IN_TOWN}, g as (select round(lon, 2) as x, round(lat, 2) as y, left(fms_id, 2) as program, count(*) as n from town group by all) select x, y, sum(n) as n, arg_max(program, (n, program)) as lead from g group by all""")
def a24_site_groups(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A24, C24: dots at the same rounded point with the leading program."""
    g = town(spark, sf).groupBy(F.round("lon", 2).alias("x"), F.round("lat", 2).alias("y"), F.left("fms_id", F.lit(2)).alias("program")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("x", "y").agg(F.sum("n").alias("total"), F.max(F.struct("n", "program")).alias("m")).select("x", "y", F.col("total").alias("n"), F.col("m.program").alias("lead"))


@query("""with pop as (select mega_project, sum(residents) as residents from station_reach group by 1), w as (select borough, sum(case when isfinite(budget) then budget end) as located from nyc_capital_rows group by 1), k as (select count(*) as districts, borough from ref_community_districts group by 2), c as (select sum(residents) as people from pop), city as (select sum(located) as money from w where borough = 'Citywide')
select k.borough, round(coalesce(w.located, 0), 2) as located, round(coalesce(w.located, 0) + city.money * k.districts / sum(k.districts) over (), 2) as serves, round(coalesce(w.located, 0) / c.people, 4) as per_resident from k left join w using (borough) cross join c cross join city""")
def a23_per_resident_two_ways(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A23: money where it is and money that serves a place, citywide money being spread by a size measure."""
    people = table(spark, sf, "station_reach").agg(F.sum("residents").alias("people"))
    located = table(spark, sf, "nyc_capital_rows").groupBy("borough").agg(F.sum(finite(F.col("budget"))).alias("located"))
    city = located.where("borough = 'Citywide'").agg(F.sum("located").alias("money"))
    k = table(spark, sf, "ref_community_districts").groupBy("borough").agg(F.count(F.lit(1)).alias("districts"))
    every = k.agg(F.sum("districts").alias("every"))
    out = k.join(located, "borough", "left").join(F.broadcast(people)).join(F.broadcast(city)).join(F.broadcast(every))
    here = F.coalesce("located", F.lit(0.0))
    return out.select("borough", F.round(here, 2).alias("located"), F.round(here + F.col("money") * F.col("districts") / F.col("every"), 2).alias("serves"), F.round(here / F.col("people"), 4).alias("per_resident"))


@query(f"""with {IN_TOWN}, a as (select fms_id, avg(lon) as lon, avg(lat) as lat from town group by 1), f as (select fms_id, lon, lat from town qualify row_number() over (partition by fms_id order by point_id) = 1),
d as (select {HAV.format(a='a.lon', b='a.lat', c='f.lon', d='f.lat')} as m from a join f using (fms_id)) select count(m) as n, round(median(m), 3) as median_m, 100.0 * count(*) filter (m <= 500) / cast(count(m) as double) as close_pct from d""")
def c22_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C22: two independent placements of the same projects."""
    a = town(spark, sf).groupBy("fms_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    first = town(spark, sf).groupBy("fms_id").agg(F.min(F.struct("point_id", "lon", "lat")).alias("m")).select("fms_id", "m.lon", "m.lat")
    return places.agreement(a, first, "fms_id", 500.0)


QUERIES, SQL = BOOK.queries, BOOK.sql
