"""Single operators of the relational kind: predicates, joins, aggregates, windows, sorts, sets, dates and money (OP-P, J, A, W, O, U, D, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import periods
from plinth.functions.values import finite
from plinth.operators import areas, asof, change, facets, latest, places, ranges, spatial
from plinth.plans.book import Book
from plinth.plans.spatialplans import EDGES, HAV, IN_TOWN, district_edges, town
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query


def _fin(c: str) -> str:
    return f"case when isfinite({c}) then {c} end"


@query("""select l_orderkey, l_linenumber, l_quantity * l_extendedprice as amount, l_extendedprice * (1 - l_discount) as net, l_shipdate as shipped from lineitem""")
def op_p01_projection(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P01: computed columns and aliases; the scan reads the columns named and no others."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (q * p).alias("amount"), (p * (1 - F.col("l_discount"))).alias("net"), F.col("l_shipdate").alias("shipped"))


@query("""select row_id from project_budget_schedule where managing_agency is distinct from sponsor_agency""")
def op_p03_null_safe_inequality(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P03: null against a value is a difference, null against null is none."""
    return table(spark, sf, "project_budget_schedule").where(~F.col("managing_agency").eqNullSafe(F.col("sponsor_agency"))).select("row_id")


@query("""select s.pid from project_schedules s where exists (select 1 from project_budget_schedule p where p.pid = s.pid and p.total_budget > 50000000)""")
def op_p05_exists(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P05: EXISTS as a semi join; a hot key of the inner side is read once."""
    large = table(spark, sf, "project_budget_schedule").where("total_budget > 50000000").select("pid")
    return table(spark, sf, "project_schedules").select("pid").join(large, "pid", "left_semi")


_THEMES = [("building", r"(?i)roof|facade|elevator"), ("water", r"(?i)sewer|water|culvert|drainage"), ("street", r"(?i)street|bridge|wall"), ("parks", r"(?i)playground|ball field|comfort")]
_THEME_SQL = "case " + " ".join(f"when regexp_matches(r.title, '{p}') then '{n}'" for n, p in _THEMES) + " end"
_BANDS = [(1e6, "under 1M"), (1e7, "1M-10M"), (1e8, "10M-100M"), (1e9, "100M-1B")]
_BAND_SQL = "case when {0} is null or isnan({0}) then null when {0} < 1e6 then 'under 1M' when {0} < 1e7 then '1M-10M' when {0} < 1e8 then '10M-100M' when {0} < 1e9 then '100M-1B' else '1B and more' end"


def theme_of(title):
    c = F.lit(None).cast("string")
    for name, pattern in reversed(_THEMES):
        c = F.when(title.rlike(pattern), name).otherwise(c)
    return c


def record_facets() -> dict:
    """OP-P12: the twelve facets of a published record (rows with sponsor and board of the project beside), as array-valued columns."""
    one = lambda c: F.array(c)
    theme = theme_of(F.col("title"))
    return {
        "status": one(F.col("status")), "theme": one(theme), "subtheme": one(F.concat(theme, F.lit(":"), F.lower(F.split("title", " ")[0]))),
        "phase": one(F.nullif(F.regexp_replace(F.lower("phase"), "[^a-z]", ""), F.lit(""))), "agency": F.col("managing_agencies"), "sponsor": one(F.col("sponsor")), "borough": one(F.col("borough")),
        "district": F.regexp_extract_all("board", F.lit(r"[A-Z][A-Za-z ]+ \d\d"), F.lit(0)), "tier": one(F.col("tier")), "size": one(facets.band(F.col("budget"), _BANDS, "1B and more")),
        "schedule": one(F.when(F.col("forecast_completion").isNull(), "undated").otherwise("dated")), "program": one(F.col("program")),
    }


@query(f"""with l as (select fms_id, arg_max(sponsor_agency, (reporting_period, loaded_at, row_id)) filter (sponsor_agency is not null) as sponsor, arg_max(community_board, (reporting_period, loaded_at, row_id)) filter (community_board is not null) as board from project_budget_schedule group by 1),
f as (select r.*, l.sponsor, l.board, {_THEME_SQL} as theme from nyc_capital_rows r left join l using (fms_id)),
o as (select 'status' as facet, status as option from f union all select 'theme', theme from f union all select 'subtheme', theme || ':' || lower(split_part(title, ' ', 1)) from f union all select 'phase', nullif(regexp_replace(lower(phase), '[^a-z]', '', 'g'), '') from f
union all select 'agency', unnest(list_distinct(managing_agencies)) from f union all select 'sponsor', sponsor from f union all select 'borough', borough from f union all select 'district', unnest(list_distinct(regexp_extract_all(board, '[A-Z][A-Za-z ]+ \\d\\d'))) from f
union all select 'tier', tier from f union all select 'size', {_BAND_SQL.format('budget')} from f union all select 'schedule', case when forecast_completion is null then 'undated' else 'dated' end from f union all select 'program', program from f)
select facet, option, count(*) as n from o where option is not null group by all""")
def op_p12_facet_registry(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P12, P13: the options of all twelve facets with their counts, in one pass over the records."""
    order = [F.col("reporting_period"), F.col("loaded_at"), F.col("row_id")]
    side = table(spark, sf, "project_budget_schedule").groupBy("fms_id").agg(latest.last_value(F.col("sponsor_agency"), order).alias("sponsor"), latest.last_value(F.col("community_board"), order).alias("board"))
    return facets.all_option_counts(table(spark, sf, "nyc_capital_rows").join(side, "fms_id", "left"), record_facets(), {})


@query(f"""select {_BAND_SQL.format('total_budget')} as band, count(*) as n from project_budget_schedule group by 1""")
def op_p14_budget_bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy(facets.band(F.col("total_budget"), _BANDS, "1B and more").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""select r.row_id, p.point_id from nyc_capital_rows r join loc_cpdb_points p using (fms_id) where r.tier is not null and p.lon between -74.02 and -73.98 and p.lat between 40.68 and 40.74""")
def op_p15_box_selection(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P15: placed records by their points inside a box; the box reaches the scan of the points."""
    box = table(spark, sf, "loc_cpdb_points").where(F.col("lon").between(-74.02, -73.98) & F.col("lat").between(40.68, 40.74)).select("fms_id", "point_id")
    return table(spark, sf, "nyc_capital_rows").where("tier is not null").select("row_id", "fms_id").join(box, "fms_id").select("row_id", "point_id")


@query("""select row_id from nyc_capital_rows where borough in ('Queens', 'Bronx') and tier = 'A' and status = 'current'""")
def op_p18_filter_state(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P18: a filter from a query string; what it does not name has its default."""
    defaults = {"status": ["current"]}
    state = facets.parse_state("borough=Queens%2CBronx&tier=A", defaults)
    chosen = {k: F.array(F.col(k)) for k in ("status", "borough", "tier")}
    return table(spark, sf, "nyc_capital_rows").where(facets.matches(chosen, state)).select("row_id")


@query("""select doc_id from documents where text like '%pump%' or text ilike '%COUNCIL%'""")
def op_p20_like(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").like("%pump%") | F.col("text").ilike("%COUNCIL%")).select("doc_id")


@query("""select row_id, upper(title) as up, lower(title) as low, trim(title) as bare, left(title, 5) as head, length(title) as n from nyc_capital_rows""")
def op_p22_string_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nyc_capital_rows").select("row_id", F.upper("title").alias("up"), F.lower("title").alias("low"), F.trim("title").alias("bare"), F.left("title", F.lit(5)).alias("head"), F.length("title").cast("bigint").alias("n"))


@query("""select p_brand, n_name, count(*) as n, round(sum(l_extendedprice), 2) as amount from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all""")
def j08_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J08: several lookups of one row. Lines are summed by their two keys before any lookup; the plan picks broadcasts by size."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"), F.sum("l_extendedprice").alias("v"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    makers = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return lines.join(parts, "l_partkey").join(makers, "l_suppkey").groupBy("p_brand", "n_name").agg(F.sum("k").alias("n"), F.round(F.sum("v"), 2).alias("amount"))


@query(f"""with {IN_TOWN}, {EDGES} select point_id, min(boro_cd) as region from (select boro_cd, point_id from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1) group by 1""")
def j12_first_region(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J12, G02: the first region that holds a point."""
    hit = spatial.inside(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf))
    return hit.groupBy("point_id").agg(F.min("ref_id").alias("region"))


@query(f"""with {IN_TOWN}, d as (select point_id, boro_cd, {HAV.format(a='s.lon', b='s.lat', c='p.lon', d='p.lat')} as m from town p cross join ref_community_districts s)
select point_id, boro_cd as ref_id, round(m, 2) as distance_m from d where m <= 2500 qualify row_number() over (partition by point_id order by m, boro_cd) = 1""")
def j14_nearest_label(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J14: the nearest label point within 2.5 km, by cells around the labels."""
    d = table(spark, sf, "ref_community_districts")
    out = places.nearest_within(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), d, F.col("boro_cd"), F.col("lon"), F.col("lat"), 2500.0)
    return out.withColumn("distance_m", F.round("distance_m", 2))


@query("""with m as (select distinct reporting_period as p, make_date(reporting_period // 100, reporting_period % 100, 1) as d from project_budget_schedule where reporting_period is not null),
w as (select row_id, cast(actual_design_start as date) as a, cast(forecast_completion as date) as z from project_budget_schedule where actual_design_start <= forecast_completion)
select p as period, count(*) as open_records from m join w on d >= a and d < z group by 1""")
def j22_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J22: months between the design start and the forecast finish of deliveries. Ranges meet points in bins of a year of days."""
    rows = table(spark, sf, "project_budget_schedule")
    months = rows.select(F.col("reporting_period").alias("period")).where("period is not null").distinct().select("period", F.unix_date(periods.month_start(F.col("period"))).alias("day"))
    spans = rows.where("actual_design_start <= forecast_completion").select(F.unix_date(F.to_date("actual_design_start")).alias("lo"), F.unix_date(F.to_date("forecast_completion")).alias("hi"))
    # Equal spans are one with their number, so that repeated deliveries do not multiply.
    spans = spans.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("k"))
    return ranges.range_join(months, "day", spans, "lo", "hi", 366).groupBy("period").agg(F.sum("k").alias("open_records"))


@query("""select l_returnflag, count(*) as n, sum(l_linenumber) as s, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_extendedprice), 4) as mean from lineitem group by 1""")
def a01_hash_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("""select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top from orders group by all order by all""")
def a02_group_by_all(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A02: GROUP BY ALL and ORDER BY ALL in SQL over a view of the table."""
    return spark.sql("select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top from {orders} group by all order by all", orders=table(spark, sf, "orders"))


@query("""select fms_id, min(borough) as borough, min(sponsor_agency) as sponsor from project_budget_schedule group by 1""")
def a05_any_value(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A05: some non-null value of a group; the least one, so that every run gives the same."""
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id").agg(F.min("borough").alias("borough"), F.min("sponsor_agency").alias("sponsor"))


@query("""select o_custkey, bool_and(o_orderstatus = 'F') as all_final, bool_or(o_totalprice > 300000) as any_large from orders group by 1""")
def a08_bool_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_final"), F.bool_or(F.col("o_totalprice") > 300000).alias("any_large"))


@query("""select fms_id, reporting_period, case when count(*) = count(actual_construction_end) then max(actual_construction_end) end as ended from project_budget_schedule group by all""")
def a09_conditional_end(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A09: the latest end of a record's rows, but only when each of them has one."""
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id", "reporting_period").agg(latest.max_if_all(F.col("actual_construction_end")).alias("ended"))


_MEASURES = {
    "budget": (f"sum({_fin('budget')})", lambda: F.sum(finite(F.col("budget")))),
    "spend": (f"sum({_fin('spend')})", lambda: F.sum(finite(F.col("spend")))),
    "unspent": (f"sum({_fin('budget')} - {_fin('spend')})", lambda: F.sum(finite(F.col("budget")) - finite(F.col("spend")))),
    "overspent": (f"sum(greatest({_fin('spend')} - {_fin('budget')}, 0))", lambda: F.sum(F.when(finite(F.col("spend")) - finite(F.col("budget")) > 0, finite(F.col("spend")) - finite(F.col("budget"))).when(finite(F.col("spend")).isNotNull() & finite(F.col("budget")).isNotNull(), 0.0))),
    "largest": (f"max({_fin('budget')})", lambda: F.max(finite(F.col("budget")))),
    "mean_budget": (f"avg({_fin('budget')})", lambda: F.avg(finite(F.col("budget")))),
    "dated_budget": (f"sum({_fin('budget')}) filter (forecast_completion is not null)", lambda: F.sum(F.when(F.col("forecast_completion").isNotNull(), finite(F.col("budget"))))),
    "current_budget": (f"sum({_fin('budget')}) filter (status = 'current')", lambda: F.sum(F.when(F.col("status") == "current", finite(F.col("budget"))))),
}


@query("with m as (select program, " + ", ".join(f"round({sql}, 2) as {n}" for n, (sql, _) in _MEASURES.items()) + " from nyc_capital_rows group by 1) " + " union all ".join(f"select program, '{n}' as measure, {n} as v from m" for n in _MEASURES))
def a21_measure_registry(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A21: eight money measures by name, all in one aggregation."""
    wide = table(spark, sf, "nyc_capital_rows").groupBy("program").agg(*(F.round(make(), 2).alias(n) for n, (_, make) in _MEASURES.items()))
    return wide.select("program", F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in _MEASURES))).alias("c")).select("program", "c.*")


@query(f"""select borough, case when sum({_fin('total_budget')}) <> 0 then sum({_fin('spend_to_date')}) / sum({_fin('total_budget')}) end as spent, case when count(pid) <> 0 then 1.0 * count(distinct fms_id) / count(pid) end as projects_per_row from project_budget_schedule group by 1""")
def a20_area_measures(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A20, M03: ratios of an area, null where the denominator is zero."""
    b, s = F.sum(finite(F.col("total_budget"))), F.sum(finite(F.col("spend_to_date")))
    return table(spark, sf, "project_budget_schedule").groupBy("borough").agg(areas.ratio(s, b, 1.0).alias("spent"), areas.ratio(F.count_distinct("fms_id"), F.count("pid"), 1.0).alias("projects_per_row"))


@query("""select fms_id, reporting_period, min(actual_design_start) as began, case when bool_and(actual_construction_end is not null) then max(actual_construction_end) end as ended, count(distinct pid) as parts, string_agg(distinct managing_agency, '; ' order by managing_agency) as agencies from project_budget_schedule group by all""")
def a29_project_from_parts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A29: one record from the rows of its parts."""
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id", "reporting_period").agg(
        F.min("actual_design_start").alias("began"), latest.max_if_all(F.col("actual_construction_end")).alias("ended"), F.count_distinct("pid").alias("parts"),
        F.array_join(F.array_sort(F.collect_set("managing_agency")), "; ").alias("agencies"),
    ).withColumn("agencies", F.nullif("agencies", F.lit("")))


@query("""with s as (select l_orderkey, l_extendedprice as w, l_quantity as v, count(*) over (partition by l_orderkey) as n, sum(l_extendedprice) over (partition by l_orderkey) as t, sum(l_quantity) over (partition by l_orderkey) as q from lineitem),
e as (select l_orderkey, sum(abs(w / t - 1.0 / n)) / 2 as moved, sum(abs(q * (w / t) - q * (1.0 / n))) as split_error, max(n) as n from s group by 1)
select n as sites, count(*) as orders, round(avg(moved), 6) as moved, round(max(moved), 6) as most_moved, round(sum(split_error), 3) as split_error from e where n > 1 group by 1""")
def a36_split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A36: how much of an entity's money a split by weight moves against an equal one, and what that comes to, by number of sites."""
    s = areas.site_shares(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), "l_orderkey", "l_extendedprice")
    per = s.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).where("n > 1")
    off = s.join(per, F.col("l_orderkey") == F.col("k")).groupBy("k", "n", "q").agg(F.sum(F.abs(F.col("share") - F.lit(1.0) / F.col("n"))).alias("off"))
    return off.groupBy(F.col("n").alias("sites")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg(F.col("off") / 2), 6).alias("moved"), F.round(F.max(F.col("off") / 2), 6).alias("most_moved"), F.round(F.sum(F.col("off") * F.col("q")), 3).alias("split_error"))


@query("""select row_id, reporting_period = max(reporting_period) over (partition by fms_id) as is_last from project_budget_schedule""")
def w01_max_over_entity(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W01: the greatest value of an entity beside each of its rows, by an aggregation joined back, so that no hot entity is sorted."""
    rows = table(spark, sf, "project_budget_schedule").select("row_id", "fms_id", "reporting_period")
    top = rows.groupBy("fms_id").agg(F.max("reporting_period").alias("top")).withColumnRenamed("fms_id", "k")
    return rows.join(top, F.col("fms_id").eqNullSafe(F.col("k"))).select("row_id", (F.col("reporting_period") == F.col("top")).alias("is_last"))


@query(f"""with t as (select borough, sum({_fin('budget')}) as v from nyc_capital_rows group by 1) select borough, round(v, 2) as v, v / sum(v) over () as share, count(*) over () as groups from t""")
def w04_whole_set(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W04: an aggregate over all groups beside each; groups are few."""
    t = table(spark, sf, "nyc_capital_rows").groupBy("borough").agg(F.sum(finite(F.col("budget"))).alias("v"))
    whole = Window.partitionBy()
    return t.select("borough", F.round("v", 2).alias("v"), (F.col("v") / F.sum("v").over(whole)).alias("share"), F.count(F.lit(1)).over(whole).alias("groups"))


@query(f"""select fms_id, row_id, managing_agency from project_budget_schedule qualify row_number() over (partition by fms_id order by reporting_period desc nulls last, {_fin('total_budget')} desc nulls last, row_id) = 1""")
def w05_first_row(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W05, O06: the first row of a key in a mixed order with a unique end, as a maximum."""
    order = [F.col("reporting_period"), finite(F.col("total_budget")), -F.col("row_id")]
    return latest.latest(table(spark, sf, "project_budget_schedule"), ["fms_id"], order, ["row_id", "managing_agency"])


@query("""with p as (select fms_id, reporting_period as period, max(case when isfinite(total_budget) then total_budget end) as v from project_budget_schedule where reporting_period is not null group by all)
select fms_id, period, round(v - lag(v) over w, 2) as change, lag(period) over w as since from p window w as (partition by fms_id order by period)""")
def w08_change_since(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W08: change against the distinct period reported before, and which one that is."""
    p = table(spark, sf, "project_budget_schedule").where("reporting_period is not null").groupBy("fms_id", F.col("reporting_period").alias("period")).agg(F.max(finite(F.col("total_budget"))).alias("v"))
    out = change.signed_change(p, ["fms_id"], ["period"], "v")
    return out.withColumn("since", F.lag("period").over(change.along(["fms_id"], ["period"]))).select("fms_id", "period", "change", "since")


@query("""with a as (select fms_id, source, period, arg_max(budget, row_id) as budget from project_history where fms_id is not null and period is not null and budget is not null group by all)
select fms_id, source, period, round(budget - coalesce(lag(budget) over (partition by fms_id, source order by period), 0), 2) as change from a""")
def w09_allocation_change(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W09: the change of an allocation along its dates, of each date the last revision; the first one is its own change. One row a
    member and date is left before anything is ordered."""
    rows = table(spark, sf, "project_history").where("fms_id is not null and period is not null and budget is not null")
    a = rows.groupBy("fms_id", "source", "period").agg(F.max(F.struct("row_id", "budget"))["budget"].alias("budget"))
    w = change.along(["fms_id", "source"], ["period"])
    return a.select("fms_id", "source", "period", F.round(F.col("budget") - F.coalesce(F.lag("budget").over(w), F.lit(0.0)), 2).alias("change"))


@query("""with m as (select left(fms_id, 2) as plan, fms_id, period, max(budget) as budget from project_history where fms_id is not null and period is not null group by all), loads as (select distinct period from m), members as (select distinct plan, fms_id from m),
g as (select g.plan, g.fms_id, g.period, m.budget, m.period as found from (select * from members cross join loads) g asof join (select * from m where budget is not null) m on g.fms_id = m.fms_id and g.period >= m.period)
select plan, period, round(sum(budget), 2) as total, count(*) as present, count(*) filter (found < period) as carried from g group by all""")
def w11_carried_series(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W11: the total of a plan at every report, a member without a value there counting with its last one."""
    m = table(spark, sf, "project_history").where("fms_id is not null and period is not null").groupBy(F.left("fms_id", F.lit(2)).alias("plan"), "fms_id", "period").agg(F.max("budget").alias("budget"))
    c = asof.carried(m, m, m, ["plan", "fms_id"], "period", "budget")
    return c.groupBy("plan", "period").agg(F.round(F.sum("budget"), 2).alias("total"), F.count(F.lit(1)).alias("present"), F.count_if("carried").alias("carried"))


@query("""select fms_id, pid, arg_max(row_id, (case when current_phase_start is not null then 1 else 0 end, coalesce(current_phase_start, timestamp '0001-01-01'), case lower(trim(current_phase)) when 'construction' then 3 when 'procurement' then 2 when 'design' then 1 else 0 end, row_id)) as row_id from project_budget_schedule where reporting_period = 202605 group by all""")
def w20_current_phase(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W20: the phase started last; ties by the order of phases; rows without a start come after."""
    name = F.lower(F.trim("current_phase"))
    rank = F.when(name == "construction", 3).when(name == "procurement", 2).when(name == "design", 1).otherwise(0)
    order = [F.col("current_phase_start").isNotNull(), F.coalesce("current_phase_start", F.lit("0001-01-01").cast("timestamp_ntz")), rank, F.col("row_id")]
    return latest.latest(table(spark, sf, "project_budget_schedule").where("reporting_period = 202605"), ["fms_id", "pid"], order, ["row_id"])


@query("""select n_regionkey, n_name, c_custkey, c_acctbal from customer join nation on n_nationkey = c_nationkey where c_acctbal is not null order by n_regionkey, n_name desc, c_acctbal desc nulls last, c_custkey""")
def o01_multi_key_sort(spark: SparkSession, sf: str) -> DataFrame:
    """OP-O01, O06: a sort by several keys with nulls last and a unique end; range-partitioned, so no task holds it all."""
    rows = table(spark, sf, "customer").where("c_acctbal is not null").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.orderBy("n_regionkey", F.desc("n_name"), F.desc_nulls_last("c_acctbal"), "c_custkey").select("n_regionkey", "n_name", "c_custkey", "c_acctbal")


@query("""with w as (select row_id, string_split(upper(trim(title)), ' ') as w from nyc_capital_rows where title is not null) select row_id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), ' ') as words from w""")
def o05_ordered_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """OP-O05: each value once, in the order of its first place."""
    return table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", F.array_join(F.array_distinct(F.split(F.upper(F.trim("title")), " ")), " ").alias("words"))


@query("""select fms_id, pid, reporting_period, arg_min(row_id, (loaded_at, row_id)) as first_row, arg_max(row_id, (loaded_at, row_id)) as last_row from project_budget_schedule where loaded_at is not null group by all""")
def o06_stable_ends(spark: SparkSession, sf: str) -> DataFrame:
    """OP-O06: the ends of an order that has ties, made total by a unique column, so that they fall alike in every run."""
    order = F.struct("loaded_at", "row_id")
    ends = table(spark, sf, "project_budget_schedule").where("loaded_at is not null").groupBy("fms_id", "pid", "reporting_period").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    return ends.select("fms_id", "pid", "reporting_period", F.col("a.row_id").alias("first_row"), F.col("z.row_id").alias("last_row"))


@query("""select 'point' as kind, fms_id, count(*) as n from loc_cpdb_points group by all union all select 'record', fms_id, count(*) from nyc_capital_rows group by all""")
def u01_union_all(spark: SparkSession, sf: str) -> DataFrame:
    """OP-U01: tables under one another with a tag; each is counted before the union."""
    count = lambda t, kind: table(spark, sf, t).groupBy("fms_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "fms_id", "n")
    return count("loc_cpdb_points", "point").unionByName(count("nyc_capital_rows", "record"))


@query("""select distinct fms_id, pid from project_budget_schedule where pid > 0""")
def u06_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").where("pid > 0").select("fms_id", "pid").distinct()


@query("""with e as (select reporting_period as p, avg(case when day(completion_date) <> 1 then 1.0 else 0.0 end) > 0.5 as mangled from schedule_history where completion_date is not null group by 1), r as (select s.row_id, cast(s.completion_date as date) as d, coalesce(e.mangled, false) as m from schedule_history s left join e on e.p = s.reporting_period)
select row_id, case when d is null or d = date '1900-01-01' then null when m and year(d) = 2022 then make_date(2000 + day(d), month(d), 1) when m and year(d) between 1930 and 1949 then make_date(year(d) + 100, month(d), 1) else d end as day,
case when d is null then 'empty' when d = date '1900-01-01' then 'placeholder' when m and year(d) = 2022 then 'month and year read as month and day' when m and year(d) between 1930 and 1949 then 'century' else 'as published' end as rule from r""", days=("day",))
def d05_mangled_dates(spark: SparkSession, sf: str) -> DataFrame:
    """OP-D05, A33: dates of an edition most of which do not fall on a first are read by the rules of such editions, with the rule named."""
    rows = table(spark, sf, "schedule_history").select("row_id", "reporting_period", F.to_date("completion_date").alias("d"))
    editions = rows.where("d is not null").groupBy(F.col("reporting_period").alias("p")).agg((F.avg((F.dayofmonth("d") != 1).cast("double")) > 0.5).alias("m"))
    both = rows.join(editions, F.col("reporting_period") == F.col("p"), "left")  # editions are few; the plan broadcasts them by size
    value = periods.demangled(F.col("d"), F.coalesce("m", F.lit(False)))
    return both.select("row_id", value["day"].alias("day"), value["rule"].alias("rule"))


@query("""select row_id, strftime(loaded_at, '%Y%m') as loaded_month, year(loaded_at) as loaded_year, cast(strptime(cast(reporting_period * 100 + 1 as varchar), '%Y%m%d') as date) as first_day from project_budget_schedule where reporting_period is not null""", days=("first_day",))
def d07_date_formats(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "project_budget_schedule").where("reporting_period is not null")
    first = F.to_date((F.col("reporting_period") * 100 + 1).cast("string"), "yyyyMMdd")
    return p.select("row_id", F.date_format("loaded_at", "yyyyMM").alias("loaded_month"), F.year("loaded_at").cast("bigint").alias("loaded_year"), first.alias("first_day"))


@query("""select row_id, datediff('month', cast(actual_design_start as date), cast(forecast_completion as date)) as months from project_budget_schedule""")
def d09_month_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """OP-D09: month boundaries crossed, whatever the days."""
    return table(spark, sf, "project_budget_schedule").select("row_id", periods.months_between_starts(F.to_date("actual_design_start"), F.to_date("forecast_completion")).cast("bigint").alias("months"))


@query(f"""select row_id, round({_fin('total_budget')}, 2) as cents, round({_fin('spend_to_date')} / 1000, 0) as thousands from project_budget_schedule where abs({_fin('total_budget')}) < 1e12""")
def m02_rounding(spark: SparkSession, sf: str) -> DataFrame:
    b, s = finite(F.col("total_budget")), finite(F.col("spend_to_date"))
    return table(spark, sf, "project_budget_schedule").where(F.abs(b) < 1e12).select("row_id", F.round(b, 2).alias("cents"), F.round(s / 1000, 0).alias("thousands"))


@query(f"""select row_id, case when {_fin('total_budget')} <> 0 then 100.0 * {_fin('spend_to_date')} / {_fin('total_budget')} end as pct from project_budget_schedule""")
def m03_percent(spark: SparkSession, sf: str) -> DataFrame:
    """OP-M03: a percentage, null where the whole is zero or unknown."""
    return table(spark, sf, "project_budget_schedule").select("row_id", areas.ratio(finite(F.col("spend_to_date")), finite(F.col("total_budget"))).alias("pct"))


@query("""select row_id, case when program = 'sca' then 'building' when regexp_matches(title, '(?i)street|bridge|sewer|water|wall') then 'civil' when regexp_matches(title, '(?i)roof|elevator|facade') then 'building' else 'general' end as index_name from nyc_capital_rows""")
def m05_index_choice(spark: SparkSession, sf: str) -> DataFrame:
    """OP-M05: which price index a record takes, by program and title."""
    t = F.col("title")
    kind = F.when(F.col("program") == "sca", "building").when(t.rlike("(?i)street|bridge|sewer|water|wall"), "civil").when(t.rlike("(?i)roof|elevator|facade"), "building").otherwise("general")
    return table(spark, sf, "nyc_capital_rows").select("row_id", kind.alias("index_name"))


@query("""select row_id, cast(city as double) * 1000 as dollars, round(cast(non_city as double) * 1e6, 0) as from_millions from budget_spend_by_fy where isfinite(city) and isfinite(non_city)""")
def m06_units(spark: SparkSession, sf: str) -> DataFrame:
    """OP-M06: thousands and millions as dollars."""
    c, n = finite(F.col("city")), finite(F.col("non_city"))
    return table(spark, sf, "budget_spend_by_fy").where(c.isNotNull() & n.isNotNull()).select("row_id", periods.dollars(c, "thousand").alias("dollars"), F.round(periods.dollars(n, "million"), 0).alias("from_millions"))


QUERIES, SQL = BOOK.queries, BOOK.sql
