"""Further operators of the inventory: predicates, pairings, judged phases, id spellings, corridors, panels (OP-P, J, A, W, T, D, M, G, Q, C, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geometry, periods
from plinth.functions.values import finite
from plinth.operators import latest, places, spatial
from plinth.plans.book import Book
from plinth.plans.spatialplans import EDGES, HAV, IN_TOWN, district_edges, town
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query


@query("""select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def op_p04_in_lists(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P04: IN a list and NOT IN a subquery, as an anti join on non-null keys."""
    owing = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(owing, "o_custkey", "left_anti").select("o_orderkey")


@query("""select s.pid, s.reporting_period, s.row_id from schedule_history s where s.reporting_period = (select max(o.reporting_period) from schedule_history o where o.pid = s.pid)""")
def op_p06_correlated_max(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P06: a correlated scalar subquery as an aggregation joined back; a hot schedule is not gathered."""
    h = table(spark, sf, "schedule_history").select("pid", "reporting_period", "row_id")
    top = h.groupBy("pid").agg(F.max("reporting_period").alias("reporting_period"))
    return h.join(top, ["pid", "reporting_period"])


@query(f"""with {IN_TOWN}, seen as (select distinct fms_id from town where lon between -74.05 and -73.95 and lat between 40.65 and 40.75) select row_id from nyc_capital_rows where fms_id in (select fms_id from seen)""")
def op_p16_in_view(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P15, P16: records with any site inside the box in view."""
    seen = town(spark, sf).where(F.col("lon").between(-74.05, -73.95) & F.col("lat").between(40.65, 40.75)).select("fms_id")
    return table(spark, sf, "nyc_capital_rows").join(seen, "fms_id", "left_semi").select("row_id")


@query("""with base as (select fms_id, max(case when isfinite(total_budget) then total_budget end) as b from project_budget_schedule group by 1), top as (select max(b) as m from base)
select fms_id, b, b / (select m from top) as of_largest, v.label from base join (values (1e6, 1e8, 'middle'), (1e8, 1e12, 'large')) v(lo, hi, label) on b >= lo and b < hi""")
def op_p23_cte_values(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P23, J22: a common expression used twice, a scalar from it, and an inline table of ranges as a CASE."""
    base = table(spark, sf, "project_budget_schedule").groupBy("fms_id").agg(F.max(finite(F.col("total_budget"))).alias("b"))
    top = base.agg(F.max("b").alias("m"))
    label = F.when((F.col("b") >= 1e6) & (F.col("b") < 1e8), "middle").when((F.col("b") >= 1e8) & (F.col("b") < 1e12), "large")
    return base.join(F.broadcast(top)).select("fms_id", "b", (F.col("b") / F.col("m")).alias("of_largest"), label.alias("label")).where("label is not null")


def line_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the consecutive stations of each line: (ref_id, position, ax, ay, bx, by)."""
    w = Window.partitionBy("mega_project").orderBy("station_no")  # a fixed table of stations
    s = table(spark, sf, "station_reach").select("mega_project", F.row_number().over(w).alias("position"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by"))
    return s.where("bx is not null").withColumnRenamed("mega_project", "ref_id")


LINES = "line as (select mega_project, row_number() over w as position, lon as ax, lat as ay, lead(lon) over w as bx, lead(lat) over w as b_y from station_reach window w as (partition by mega_project order by station_no))"


@query(f"""with {IN_TOWN}, {LINES}, v as (select point_id, mega_project, position, (ax - lon) * cos(radians(lat)) as ax, ay - lat as ay, (bx - lon) * cos(radians(lat)) as bx, b_y - lat as b_y from town cross join line where bx is not null),
t as (select *, case when (bx - ax) ** 2 + (b_y - ay) ** 2 > 0 then least(1.0, greatest(0.0, -(ax * (bx - ax) + ay * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) else 0.0 end as t from v)
select point_id, mega_project as line, min(position) as first_position from t where sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2)) * 6371000.0 * pi() / 180 <= 300 group by all""")
def j15_corridor(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J15, G07: points within 300 m of a line, with the first piece that comes so close; edges and points meet in cells."""
    return places.along_lines(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), line_edges(spark, sf), 300.0).withColumnRenamed("ref_id", "line")


@query("""with s as (select l_orderkey, sum(case when l_linenumber = 1 or (l_linenumber = 2 and l_orderkey % 2 = 0) then round(l_extendedprice) end) + (case when l_orderkey % 7 = 0 then 3 else 0 end) as step from lineitem group by 1), st as (select distinct l_orderkey, round(l_extendedprice) as v from lineitem),
single as (select s.l_orderkey, 1 as parts from s where exists (select 1 from st where st.l_orderkey = s.l_orderkey and abs(st.v - s.step) < 0.5)),
pairs as (select distinct s.l_orderkey, 2 as parts from s join st a on a.l_orderkey = s.l_orderkey join st b on b.l_orderkey = s.l_orderkey and a.v < b.v where abs(a.v + b.v - s.step) < 0.5)
select l_orderkey, min(parts) as parts from (select * from single union all select * from pairs) group by all""")
def j23_statement_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J23: a step explained by one stated value of its document, or by two. The values of one document are few (an order's lines),
    so they are one array beside the step, and a pair is looked up by its complement."""
    v, key = F.round("l_extendedprice"), F.col("l_orderkey")
    part = F.when((F.col("l_linenumber") == 1) | ((F.col("l_linenumber") == 2) & (key % 2 == 0)), v)
    both = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(part) + F.when(key % 7 == 0, 3).otherwise(0)).alias("step"), F.collect_set(v).alias("v"))
    single = F.array_contains("v", F.col("step"))
    pair = F.exists("v", lambda a: (a * 2 != F.col("step")) & F.array_contains("v", F.col("step") - a))
    return both.select("l_orderkey", F.when(single, 1).when(pair, 2).alias("parts")).where("parts is not null")


@query("""select o_orderpriority, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as first_price, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as last_price, max(o_orderstatus) as any_status from orders group by 1""")
def a13_first_last(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A05, A13: ordered first and last, and a deterministic choice."""
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(latest.first_value(F.col("o_totalprice"), order).alias("first_price"), latest.last_value(F.col("o_totalprice"), order).alias("last_price"), F.max("o_orderstatus").alias("any_status"))


@query("""select program, count(*) as n, round(sum(case when isfinite(budget) then budget end), 2) as budget, case when sum(case when isfinite(budget) then budget end) > 0 then 100.0 * sum(case when isfinite(spend) then spend end) / sum(case when isfinite(budget) then budget end) end as spent_pct
from nyc_capital_rows where last_reported = 202605 and feed <> 'archive_copy' group by 1""")
def a22_program_totals(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A20..A22, H37: current records only, ratios with a zero guard."""
    b, s = finite(F.col("budget")), finite(F.col("spend"))
    now = table(spark, sf, "nyc_capital_rows").where("last_reported = 202605 and feed != 'archive_copy'")
    return now.groupBy("program").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(b), 2).alias("budget"), F.when(F.sum(b) > 0, F.lit(100.0) * F.sum(s) / F.sum(b)).alias("spent_pct"))


@query("""with s as (select l_orderkey, l_returnflag, sum(l_extendedprice) as v from lineitem group by all) select l_orderkey, arg_max(l_returnflag, (v, l_returnflag)) as lead, max(v) / sum(v) as share from s group by 1""")
def a37_leading_class(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A36, A37: the class with the largest share, and its share."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    return s.groupBy("l_orderkey").agg(F.max(F.struct("v", "l_returnflag")).alias("m"), F.sum("v").alias("t")).select("l_orderkey", F.col("m.l_returnflag").alias("lead"), (F.col("m.v") / F.col("t")).alias("share"))


@query("""with k as (select fms_id, reporting_period as p, count(distinct managing_agency) as n, max(case when isfinite(total_budget) then total_budget end) as b from project_budget_schedule group by all), s as (select fms_id from k group by 1 having max(n) = 1)
select fms_id, min(p) as since, arg_max(b, p) - arg_min(b, p) as trend from k where fms_id in (select fms_id from s) and b is not null group by 1""")
def w18_single_lineage_trend(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W18: the change since the first version, only for entities that stay one lineage."""
    k = table(spark, sf, "project_budget_schedule").groupBy("fms_id", F.col("reporting_period").alias("p")).agg(F.count_distinct("managing_agency").alias("n"), F.max(finite(F.col("total_budget"))).alias("b"))
    held = F.col("b").isNotNull()
    folded = k.groupBy("fms_id").agg(F.max("n").alias("n"), F.min(F.when(held, F.struct("p", "b"))).alias("a"), F.max(F.when(held, F.struct("p", "b"))).alias("z"))
    return folded.where("n = 1 and a is not null").select("fms_id", F.col("a.p").alias("since"), (F.col("z.b") - F.col("a.b")).alias("trend"))


@query("""select pid, arg_max(row_id, (case when lower(trim(current_phase)) = 'construction' then 1 else 0 end, coalesce(completion_date, timestamp '0001-01-01'), row_id)) as judged from schedule_history where pid > 0 group by 1""")
def w19_judged_row(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W19, W20: the row that stands for a schedule, by a composite order."""
    order = F.struct((F.lower(F.trim("current_phase")) == "construction").cast("int").alias("a"), F.coalesce("completion_date", F.lit("0001-01-01").cast("timestamp_ntz")).alias("b"), F.col("row_id"))
    order = F.when(F.col("current_phase").isNull(), F.struct(F.lit(0).alias("a"), F.coalesce("completion_date", F.lit("0001-01-01").cast("timestamp_ntz")).alias("b"), F.col("row_id"))).otherwise(order)
    return table(spark, sf, "schedule_history").where("pid > 0").groupBy("pid").agg(F.max(order)["row_id"].alias("judged"))


@query("""select pid, completion_date_type, row_id, variance_day from schedule_history where pid > 0 qualify row_number() over (partition by pid, completion_date_type order by reporting_period desc nulls last, loaded_at desc, row_id desc) = 1""")
def w22_latest_of_each_kind(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("reporting_period"), F.col("loaded_at"), F.col("row_id")]
    return latest.latest(table(spark, sf, "schedule_history").where("pid > 0"), ["pid", "completion_date_type"], order, ["row_id", "variance_day"])


# Other names of the managing agencies.
_ALIASES = {"BUILDING DELIVERY": "DBLD", "PARKS WORKS": "DPKS", "FIRE STATIONS": "DFIR", "LIBRARIES": "DLIB", "WASTE WORKS": "DSAN", "STREETS": "DSTR", "HOUSING WORKS": "DHSG", "STATION HOUSES": "DPOL", "CULTURE HALLS": "DCUL", "WATER WORKS": "DWTR", "FACILITIES": "DFAC", "HOSPITAL WORKS": "DHOS"}


@query("select case upper(trim(managing_agency)) " + " ".join(f"when '{k}' then '{v}'" for k, v in _ALIASES.items()) + " else upper(trim(managing_agency)) end as agency, count(*) as n from project_budget_schedule group by 1")
def t04_agency_alias(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T04, H10: codes normalised by an alias map."""
    name = F.upper(F.trim("managing_agency"))
    known = F.create_map(*(F.lit(x) for kv in _ALIASES.items() for x in kv))
    return table(spark, sf, "project_budget_schedule").groupBy(F.coalesce(F.try_element_at(known, name), name).alias("agency")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""with f as (select row_id, list_distinct(list_concat(regexp_extract_all(coalesce(fms_id, ''), '[A-Z]{2,3}-?\d{7}[A-Z]?'), list_transform(regexp_extract_all(coalesce(fms_id, ''), '([A-Z]{2})[ _-]([A-Z]\d{7}[A-Z]?)', 0), lambda x: replace(replace(replace(x, ' ', ''), '_', ''), '-', '')))) as ids from nyc_capital_rows) select row_id, unnest(ids) as id, unnest(range(1, len(ids) + 1)) as pos from f""")
def t09_id_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T09: ids in several spellings in one form, each once, with their places."""
    text = F.coalesce("fms_id", F.lit(""))
    plain = F.regexp_extract_all(text, F.lit(r"[A-Z]{2,3}-?\d{7}[A-Z]?"), F.lit(0))
    spaced = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Z]{2})[ _-]([A-Z]\d{7}[A-Z]?)"), F.lit(0)), lambda x: F.regexp_replace(x, "[ _-]", ""))
    ids = table(spark, sf, "nyc_capital_rows").select("row_id", F.posexplode(F.array_distinct(F.concat(plain, spaced))).alias("pos", "id"))
    return ids.select("row_id", "id", (F.col("pos") + 1).cast("bigint").alias("pos"))


@query("""select row_id, case when budget is null or not isfinite(budget) then '-' when abs(budget) >= 1e9 then cast(cast(floor(budget / 1e9) as bigint) as varchar) || 'B' when abs(budget) >= 1e6 then cast(cast(floor(budget / 1e6) as bigint) as varchar) || 'M' when abs(budget) >= 1e3 then cast(cast(floor(budget / 1e3) as bigint) as varchar) || 'K' else cast(cast(floor(budget) as bigint) as varchar) end as shown from nyc_capital_rows""")
def t27_compact_money(spark: SparkSession, sf: str) -> DataFrame:
    b = finite(F.col("budget"))
    text = lambda scale, unit: F.concat(F.floor(b / scale).cast("string"), F.lit(unit))
    shown = F.when(b.isNull(), "-").when(F.abs(b) >= 1e9, text(1e9, "B")).when(F.abs(b) >= 1e6, text(1e6, "M")).when(F.abs(b) >= 1e3, text(1e3, "K")).otherwise(text(1.0, ""))
    return table(spark, sf, "nyc_capital_rows").select("row_id", shown.alias("shown"))


@query("""with d as (select row_id, cast(forecast_completion as date) as a, cast(actual_design_start as date) as b from project_budget_schedule where forecast_completion is not null and actual_design_start is not null)
select row_id, case row_id % 3 when 0 then (year(a) - year(b)) * 365 when 1 then datediff('day', last_day(b), last_day(a)) else datediff('day', b, a) end as days from d""")
def d03_coarser_difference(spark: SparkSession, sf: str) -> DataFrame:
    """OP-D02, D03: differences at the coarser precision of two partial dates."""
    part = lambda c, n: F.date_format(c, "yyyy-MM-dd").substr(F.lit(1), n)
    n = F.when(F.col("row_id") % 3 == 0, 4).when(F.col("row_id") % 3 == 1, 7).otherwise(10)
    rows = table(spark, sf, "project_budget_schedule").where("forecast_completion is not null and actual_design_start is not null")
    a, b = periods.partial_date(part(F.col("forecast_completion"), n)), periods.partial_date(part(F.col("actual_design_start"), F.lit(10)))
    return rows.select("row_id", periods.partial_difference(a, b).cast("bigint").alias("days"))


@query("""with m as (select row_id, coalesce(nullif(cast(row_id % 15 as varchar), '14'), '') as m, coalesce(nullif(cast(1985 + row_id % 80 as varchar), '2000'), '') as y from project_history),
t as (select *, y <> '' and cast(coalesce(nullif(y, ''), '0') as int) between 1990 and 2060 and (m = '' or cast(coalesce(nullif(m, ''), '0') as int) between 1 and 12) as ok from m)
select row_id, case when not ok and (m <> '' or y <> '') then 'month ''' || m || ''', year ''' || y || '''' end as issue, case when ok then case when m = '' then y else y || '-' || lpad(m, 2, '0') end end as month from t""")
def d04_month_fields(spark: SparkSession, sf: str) -> DataFrame:
    m = F.nullif((F.col("row_id") % 15).cast("string"), F.lit("14"))
    y = F.nullif((F.col("row_id") % 80 + 1985).cast("string"), F.lit("2000"))
    p = periods.month_field(m, y)
    return table(spark, sf, "project_history").select("row_id", p["issue"].alias("issue"), p["value"].alias("month"))


@query("""select event_id, cast(to_timestamp(cast(epoch(ts) as bigint)) at time zone 'UTC' as date) as day from events""", days=("day",))
def d10_epoch_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", periods.utc_day(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day"))


@query("""select mega_project as line, round(sum(sqrt(pow((bx - ax) * cos(radians((ay + b_y) / 2)), 2) + pow(b_y - ay, 2)) * 6371000.0 * pi() / 180), 1) as length_m from (select mega_project, lon as ax, lat as ay, lead(lon) over w as bx, lead(lat) over w as b_y from station_reach window w as (partition by mega_project order by station_no)) where bx is not null group by 1""")
def g11_line_length(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G11: metres along each line of stations."""
    lines = table(spark, sf, "station_reach").groupBy(F.col("mega_project").alias("line")).agg(F.array_sort(F.collect_list(F.struct("station_no", "lon", "lat"))).alias("s"))
    path = F.transform("s", lambda x: F.array(x["lon"], x["lat"]))
    return lines.select("line", F.round(geometry.length_m(path), 1).alias("length_m"))


@query(f"""with {EDGES}, g as (select cast(floor(min(least(ax, bx)) / 0.01) as bigint) as x0, cast(floor(max(greatest(ax, bx)) / 0.01) as bigint) as x1, cast(floor(min(least(ay, by_)) / 0.01) as bigint) as y0, cast(floor(max(greatest(ay, by_)) / 0.01) as bigint) as y1 from edges),
i as (select unnest(range(x0, x1 + 1)) as i, y0, y1 from g), c as (select i, unnest(range(y0, y1 + 1)) as j from i), p as (select i, j, (i + 0.5) * cast(0.01 as double) as x, (j + 0.5) * cast(0.01 as double) as y from c),
h as (select i, j, boro_cd from p join edges on (ay > y) <> (by_ > y) and x < ax + (y - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1) select boro_cd, count(*) as cells from h group by 1""")
def g16_grid_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G14, G16: a grid over all regions, each cell given to the region that holds its centre."""
    sides = district_edges(spark, sf)
    grid = places.grid_over(sides, 0.01)
    hit = spatial.inside(grid, F.col("point_id"), F.col("lon"), F.col("lat"), sides)
    return hit.groupBy(F.col("ref_id").alias("boro_cd")).agg(F.count(F.lit(1)).alias("cells"))


@query("""with shapes as (select boro_cd, cast(json_extract(geojson, '$.coordinates') as double[][][][]) as c from ref_community_districts), p as (select boro_cd, unnest(c) as polygon, unnest(range(1, len(c) + 1)) as part from shapes),
r as (select boro_cd, part, unnest(polygon) as ring, unnest(range(1, len(polygon) + 1)) as no from p) select boro_cd, part, no as ring, unnest(range(1, len(ring) + 1)) as place, round(unnest(list_transform(ring, lambda q: q[1])), 3) as lon, round(unnest(list_transform(ring, lambda q: q[2])), 3) as lat from r""")
def g18_rounded_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G18: shapes with coordinates of three decimals, position by position."""
    d = table(spark, sf, "ref_community_districts").select("boro_cd", geometry.rounded(geometry.multipolygon(F.col("geojson")), 3).alias("g"))
    p = d.select("boro_cd", F.posexplode("g").alias("part", "polygon")).select("boro_cd", "part", F.posexplode("polygon").alias("ring", "r"))
    at = p.select("boro_cd", "part", "ring", F.posexplode("r").alias("place", "q"))
    return at.select("boro_cd", *((F.col(c) + 1).cast("bigint").alias(c) for c in ("part", "ring", "place")), F.col("q")[0].alias("lon"), F.col("q")[1].alias("lat"))


@query(f"""with {IN_TOWN}, b as (select fms_id, borough from (select fms_id, borough, count(*) as n from project_budget_schedule where borough in (select borough from ref_community_districts) group by all) qualify row_number() over (partition by fms_id order by n desc, borough) = 1),
n as (select p.point_id, d.borough, {HAV.format(a='d.lon', b='d.lat', c='p.lon', d='p.lat')} as m from town p cross join ref_community_districts d), g as (select point_id, arg_min(borough, (m, borough)) as near from n group by 1)
select p.point_id, p.fms_id, b.borough as said, g.near as found from town p join b using (fms_id) join g using (point_id) where b.borough <> g.near""")
def q05_borough_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """OP-Q05: points that lie nearest to another borough than their project names."""
    d = table(spark, sf, "ref_community_districts")
    said = latest.mode(table(spark, sf, "project_budget_schedule").join(F.broadcast(d.select("borough").distinct()), "borough", "left_semi"), ["fms_id"], "borough").select("fms_id", F.col("borough").alias("said"))  # a fixed table
    place = F.struct(F.col("borough"), F.col("boro_cd"))
    near = places.nearest(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), d, place, F.col("lon"), F.col("lat")).select("point_id", F.col("ref_id.borough").alias("found"))
    return town(spark, sf).join(said, "fms_id").join(near, "point_id").select("point_id", "fms_id", "said", "found").where("said != found")


@query("""with m as (select fms_id, left(fms_id, 2) as plan, arg_min(budget, (period, row_id)) as a, arg_max(budget, (period, row_id)) as z from project_history where fms_id is not null group by 1, 2) select plan, count(*) as members, round(sum(a), 2) as first_total, round(sum(z), 2) as last_total from m group by 1""")
def c15_first_latest_by_plan(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C15: first and latest values of each member, added up by plan."""
    order = [F.col("period"), F.col("row_id")]
    m = table(spark, sf, "project_history").where("fms_id is not null").groupBy("fms_id").agg(latest.first_value(F.col("budget"), order).alias("a"), latest.last_value(F.col("budget"), order).alias("z"))
    return m.groupBy(F.left("fms_id", F.lit(2)).alias("plan")).agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("a"), 2).alias("first_total"), F.round(F.sum("z"), 2).alias("last_total"))


@query("""with r as (select r_regionkey, n_nationkey, sum(c_acctbal) as v from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all) select r_regionkey, n_nationkey, round(v, 2) as v, v / sum(v) over (partition by r_regionkey) as of_region, v / sum(v) over () as of_all from r""")
def c25_area_panel(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C25, H19: an area beside its parents. Windows run over areas, of which there are few."""
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("v"))
    places_ = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    a = per.join(F.broadcast(places_), "n_nationkey")
    return a.select("r_regionkey", "n_nationkey", F.round("v", 2).alias("v"), (F.col("v") / F.sum("v").over(Window.partitionBy("r_regionkey"))).alias("of_region"), (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("of_all"))


@query("""with k as (select regexp_replace(upper(fms_id), '[^A-Z0-9]', '', 'g') as key, fms_id from (select distinct fms_id from project_budget_schedule)), n as (select r.row_id, count(k.fms_id) as n, min(k.fms_id) as m from nyc_capital_rows r left join k on k.key = regexp_replace(upper(r.fms_id), '[^A-Z0-9]', '', 'g') group by 1)
select row_id, case when n = 1 then m end as matched, n from n""")
def h08_exactly_one(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H08: a link that must match exactly one row; others are reported with their number."""
    key = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    known = table(spark, sf, "project_budget_schedule").select("fms_id").distinct().groupBy(key("fms_id").alias("key")).agg(F.count("fms_id").alias("n"), F.min("fms_id").alias("m"))
    rows = table(spark, sf, "nyc_capital_rows").select("row_id", key("fms_id").alias("key")).join(known, "key", "left")
    return rows.select("row_id", F.when(F.col("n") == 1, F.col("m")).alias("matched"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""select coalesce(tier, 'all') as tier, count(*) as n, round(sum(case when isfinite(budget) then budget end), 2) as budget from (select coalesce(tier, '?') as tier, budget from nyc_capital_rows) group by rollup (tier)""")
def h16_tiers_with_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nyc_capital_rows").select(F.coalesce("tier", F.lit("?")).alias("tier"), finite(F.col("budget")).alias("b"))
    return rows.rollup("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b"), 2).alias("budget")).withColumn("tier", F.coalesce("tier", F.lit("all")))


@query(r"""select period, count_if(t <> '' and lower(t) not in ('tbd', 'n/a', 'unknown') and try_strptime(t, '%Y-%m-%d') is null) as lost from (select period, trim(forecast_completion) as t from project_history) group by 1""")
def h21_lost_by_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H21: how many values a strict parser would lose."""
    t = F.trim("forecast_completion")
    strict = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return table(spark, sf, "project_history").groupBy("period").agg(F.count_if((t != "") & ~F.lower(t).isin("tbd", "n/a", "unknown") & strict.isNull()).alias("lost"))


@query("""with g as (select title, borough, count(distinct fms_id) as n, min(fms_id) as only_one from nyc_capital_rows where title is not null group by all) select title, borough, case when n = 1 then only_one end as fms_id from g""")
def h27_unambiguous_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H27: a name and place that stand for one entity only."""
    g = table(spark, sf, "nyc_capital_rows").where("title is not null").groupBy("title", "borough").agg(F.count_distinct("fms_id").alias("n"), F.min("fms_id").alias("m"))
    return g.select("title", "borough", F.when(F.col("n") == 1, F.col("m")).alias("fms_id"))


@query("""with a as (select borough, sum(case when isfinite(budget) then budget end) as v from nyc_capital_rows where borough is not null group by 1), r as (select min(v) as lo, max(v) as hi from a) select borough, round(sqrt(greatest(0.0, (v - lo) / (hi - lo))), 6) as shade from a cross join r""")
def h36_layer_scale(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H36: a square-root scale between the least and the greatest value of a layer."""
    a = table(spark, sf, "nyc_capital_rows").where("borough is not null").groupBy("borough").agg(F.sum(finite(F.col("budget"))).alias("v"))
    return a.join(F.broadcast(a.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).select("borough", F.round(F.sqrt(F.greatest(F.lit(0.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))), 6).alias("shade"))


QUERIES, SQL = BOOK.queries, BOOK.sql
