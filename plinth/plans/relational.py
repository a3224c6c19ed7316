"""Relational core: latest records, joins, aggregations, filters, sorts and set operations (OP-P, OP-J01..J08, OP-A, OP-O, OP-U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.values import finite, present
from plinth.operators import areas, facets, latest, ranks, rules
from plinth.plans.book import Book
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query
MISSING_SQL = "('', '-', '--', '?', '??', '???', '.', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', 'tbd', 'tba', 'to be determined', 'unknown', 'not available', 'missing', '<blank>', 'blank')"
BUDGET = "case when isfinite(total_budget) then total_budget end"


def yyyymm(c: str):
    return (F.year(c) * 100 + F.month(c)).cast("int")


@query(f"""
with record as (select fms_id, managing_agency, reporting_period, max({BUDGET}) as v from project_budget_schedule group by all),
per as (select fms_id, reporting_period, count(*) as n_parts, sum(v) as total from record group by all)
select fms_id, reporting_period, n_parts, round(total, 2) as total from per qualify reporting_period = max(reporting_period) over (partition by fms_id)""")
def a03_latest_budget(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "project_budget_schedule")
    out = latest.deduplicated_totals(df, "fms_id", "managing_agency", "reporting_period", finite(F.col("total_budget")))
    return out.withColumn("total", F.round("total", 2))


@query("""select fms_id, reporting_period, row_id, feed, current_phase from project_budget_schedule
qualify row_number() over (partition by fms_id order by reporting_period desc, loaded_at desc, row_id desc) = 1""")
def op_p08_latest_record(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "project_budget_schedule")
    return latest.latest(df, ["fms_id"], [F.col("reporting_period"), F.col("loaded_at"), F.col("row_id")], ["reporting_period", "row_id", "feed", "current_phase"]).select("fms_id", "reporting_period", "row_id", "feed", "current_phase")


@query("""select managing_agency, count(*) as n from project_budget_schedule where reporting_period = (select max(reporting_period) from project_budget_schedule) group by all""")
def op_p07_last_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return latest.in_last_snapshot(table(spark, sf, "project_budget_schedule"), "reporting_period").groupBy("managing_agency").agg(F.count(F.lit(1)).alias("n"))


@query("""select fms_id, arg_max(borough, (reporting_period, loaded_at, row_id)) filter (borough is not null) as borough,
arg_max(current_phase, (reporting_period, loaded_at, row_id)) filter (current_phase is not null) as phase,
arg_min(current_phase, (reporting_period, loaded_at, row_id)) filter (current_phase is not null) as first_phase from project_budget_schedule group by fms_id""")
def a04_latest_values(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("reporting_period"), F.col("loaded_at"), F.col("row_id")]
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id").agg(
        latest.last_value(F.col("borough"), order).alias("borough"), latest.last_value(F.col("current_phase"), order).alias("phase"), latest.first_value(F.col("current_phase"), order).alias("first_phase")
    )


@query("""select l_orderkey, count(*) as n, count_if(l_returnflag = 'R') as returned, bool_and(l_linestatus = 'F') as all_final, bool_or(l_discount > 0.05) as any_discount,
case when bool_and(l_tax > 0) then max(l_shipdate) end as taxed_end from lineitem group by 1""")
def a06_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final"),
        F.bool_or(F.col("l_discount") > 0.05).alias("any_discount"), latest.max_if_all(F.when(F.col("l_tax") > 0, F.col("l_shipdate"))).alias("taxed_end"),
    )


@query("""select reporting_period, count(distinct (fms_id, pid)) as n_records, count(distinct fms_id) as n_projects from project_budget_schedule group by 1""")
def a07_distinct_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy("reporting_period").agg(F.count_distinct(F.struct("fms_id", "pid")).alias("n_records"), F.count_distinct("fms_id").alias("n_projects"))


@query("""select year(o_orderdate) * 100 + month(o_orderdate) as load, median(o_totalprice) as median from orders group by 1""")
def a10_exact_median(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(yyyymm("o_orderdate").alias("load"), "o_totalprice")
    found = ranks.at(orders, ["load"], F.col("o_totalprice"), ranks.middle)
    return found.groupBy("load").agg((F.sum(F.col("x") * F.col("hits")) / F.sum("hits")).alias("median"))


@query("""select o_orderpriority, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1""")
def a10_exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.quantiles(table(spark, sf, "orders"), ["o_orderpriority"], F.col("o_totalprice"), {"q1": 0.25, "q3": 0.75})


@query("""select fms_id, string_agg(distinct feed, ', ' order by feed) as feeds from project_budget_schedule group by 1""")
def a11_ordered_string_agg(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id").agg(F.array_join(F.array_sort(F.collect_set("feed")), ", ").alias("feeds"))


@query("""select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderdate, o_orderkey) as orders, count(*) as n from orders group by 1""")
def a12_ordered_collect(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    return rows.select("o_custkey", F.array_join(F.transform("x", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"), F.size("x").cast("bigint").alias("n"))


@query("""select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as int) as g1, cast(grouping(l_linestatus) as int) as g2, count(*) as n, round(sum(l_quantity), 2) as qty
from lineitem group by rollup (l_returnflag, l_linestatus) having count(*) > 10""")
def a14_rollup_grouping(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )
    return out.where("n > 10")


@query("""select p_brand, p_size, cast(grouping_id(p_brand, p_size) as bigint) as gid, count(*) as n from part group by cube (p_brand, p_size)""")
def a15_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").cube("p_brand", "p_size").agg(F.grouping_id().cast("bigint").alias("gid"), F.count(F.lit(1)).alias("n"))


@query("""select event_type, count(*) as n, 100.0 * count(*) / cast(sum(count(*)) over () as double) as share from events group by 1""")
def a16_percent_of_total(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("""select fms_id, count(distinct fms_project_name) as names from project_budget_schedule group by 1 having count(distinct fms_project_name) > 1""")
def a17_inconsistent_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id").agg(F.count_distinct("fms_project_name").alias("names")).where("names > 1")


@query(f"""select borough, count(*) as n, round(sum({BUDGET}), 2) as budget, round(sum(case when isfinite(spend_to_date) then spend_to_date end), 2) as spend,
case when sum({BUDGET}) <> 0 then 100.0 * sum(case when isfinite(spend_to_date) then spend_to_date end) / sum({BUDGET}) end as spent_pct from project_budget_schedule group by 1""")
def a18_grouped_summary(spark: SparkSession, sf: str) -> DataFrame:
    budget, spend = finite(F.col("total_budget")), finite(F.col("spend_to_date"))
    return table(spark, sf, "project_budget_schedule").groupBy("borough").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(budget), 2).alias("budget"), F.round(F.sum(spend), 2).alias("spend"), areas.ratio(F.sum(spend), F.sum(budget)).alias("spent_pct")
    )


@query("""select unnest(managing_agencies) as agency, count(*) as n, round(sum(case when isfinite(budget) then budget end), 2) as budget from nyc_capital_rows group by 1""")
def a25_multi_valued_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nyc_capital_rows").select(F.explode("managing_agencies").alias("agency"), finite(F.col("budget")).alias("budget"))
    return rows.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("budget"), 2).alias("budget"))


_NULLED = ("managing_agency", "pid", "total_budget", "current_phase", "forecast_completion", "borough", "community_board")


@query(" union all ".join(f"select '{c}' as column_name, 100.0 * sum(case when {c} is null then 1 else 0 end) / cast(count(*) as double) as null_pct from project_budget_schedule" for c in _NULLED))
def a26_profile_nulls(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "project_budget_schedule").agg(*(F.lit(100.0) * F.avg(F.col(c).isNull().cast("double")) for c in _NULLED)).toDF(*_NULLED)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_pct")) for c in _NULLED))).alias("x")).select("x.*")


@query("""select fms_id, managing_agency, reporting_period, pid, count(*) as n from project_budget_schedule group by all having count(*) > 1""")
def a26_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy("fms_id", "managing_agency", "reporting_period", "pid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""select reporting_period, count_if(isfinite(spend) and spend < 0) as negative, count_if(spend = 0) as zero, count_if(isfinite(spend) and spend > 0) as positive, count_if(spend is null or not isfinite(spend)) as unknown from budget_spend_by_fy group by 1""")
def a26_sign_sanity(spark: SparkSession, sf: str) -> DataFrame:
    s = finite(F.col("spend"))
    return table(spark, sf, "budget_spend_by_fy").groupBy("reporting_period").agg(F.count_if(s < 0).alias("negative"), F.count_if(s == 0).alias("zero"), F.count_if(s > 0).alias("positive"), F.count_if(s.isNull()).alias("unknown"))


@query("""select o_custkey, case when bool_and(o_orderstatus = 'F') then 'complete' when bool_and(o_orderstatus = 'O') then 'not_started' else 'active' end as status,
min(o_orderdate) as began, case when bool_and(o_orderstatus = 'F') then max(o_orderdate) end as ended, string_agg(distinct o_orderpriority, '; ' order by o_orderpriority) as priorities from orders group by 1""")
def a28_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A28, A29: one row from the parts of an entity."""
    all_of = lambda s: F.bool_and(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.when(all_of("F"), "complete").when(all_of("O"), "not_started").otherwise("active").alias("status"), F.min("o_orderdate").alias("began"),
        F.when(all_of("F"), F.max("o_orderdate")).alias("ended"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"),
    )


@query("""with s as (select fms_id, reporting_period, sum(case when isfinite(city) then city end) as c, sum(case when isfinite(non_city) then non_city end) as n from budget_spend_by_fy where fms_id is not null group by all)
select fms_id, reporting_period as split_period, c / (c + n) as city_share, n / (c + n) as non_city_share from s where c + n > 0
qualify row_number() over (partition by fms_id order by reporting_period desc) = 1""")
def a30_funding_split_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A30: the latest release that splits the money."""
    rows = table(spark, sf, "budget_spend_by_fy").where("fms_id is not null").groupBy("fms_id", "reporting_period").agg(F.sum(finite(F.col("city"))).alias("c"), F.sum(finite(F.col("non_city"))).alias("n"))
    split = latest.latest(rows.where("c + n > 0"), ["fms_id"], [F.col("reporting_period")], ["reporting_period", "c", "n"])
    return split.select("fms_id", F.col("reporting_period").alias("split_period"), (F.col("c") / (F.col("c") + F.col("n"))).alias("city_share"), (F.col("n") / (F.col("c") + F.col("n"))).alias("non_city_share"))


@query("""with r as (select *, max(reporting_period) over (partition by fms_id) as top from budget_spend_by_fy where fms_id is not null)
select fms_id, reporting_period, fiscal_year, round(sum(case when isfinite(spend) then spend end), 2) as spend from r where reporting_period = top group by all""")
def a31_fiscal_years_at_last(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A31: summed per (project, period, year) first, so that the window holds few rows of a hot project."""
    per = table(spark, sf, "budget_spend_by_fy").where("fms_id is not null").groupBy("fms_id", "reporting_period", "fiscal_year").agg(F.round(F.sum(finite(F.col("spend"))), 2).alias("spend"))
    top = F.max("reporting_period").over(Window.partitionBy("fms_id"))
    return per.withColumn("top", top).where("reporting_period = top").drop("top")


@query("""with held as (select reporting_period, managing_agency, bool_or(coalesce(isfinite(spend) and spend <> 0, false)) as given from budget_spend_by_fy group by all)
select b.row_id, case when h.given then b.spend end as spend from budget_spend_by_fy b join held h on h.reporting_period is not distinct from b.reporting_period and h.managing_agency is not distinct from b.managing_agency""")
def a32_withheld_field(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A32: a field that is zero in every row of a load is withheld, not zero."""
    df = table(spark, sf, "budget_spend_by_fy").select("row_id", "reporting_period", "managing_agency", "spend")
    held = df.groupBy("reporting_period", "managing_agency").agg(F.bool_or(F.coalesce(finite(F.col("spend")) != 0, F.lit(False))).alias("given"))
    on = df["reporting_period"].eqNullSafe(held["reporting_period"]) & df["managing_agency"].eqNullSafe(held["managing_agency"])
    return df.join(held, on).select("row_id", F.when(F.col("given"), F.col("spend")).alias("spend"))


@query("""select reporting_period, avg(case when day(completion_date) <> 1 then 1.0 else 0.0 end) as off_first, avg(case when day(completion_date) <> 1 then 1.0 else 0.0 end) > 0.5 as mangled from schedule_history where completion_date is not null group by 1""")
def a33_majority_detection(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "schedule_history").where("completion_date is not null").groupBy("reporting_period").agg(F.avg((F.dayofmonth("completion_date") != 1).cast("double")).alias("off_first"))
    return rows.withColumn("mangled", F.col("off_first") > 0.5)


@query("""select fms_id, borough, n from (select fms_id, borough, count(*) as n from project_budget_schedule where borough is not null group by all) qualify row_number() over (partition by fms_id order by n desc, borough) = 1""")
def a34_mode_with_tie(spark: SparkSession, sf: str) -> DataFrame:
    return latest.mode(table(spark, sf, "project_budget_schedule"), ["fms_id"], "borough")


@query("""with s as (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice) as i, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, max(v) filter (i = cast(floor(0.9 * (n - 1)) as bigint) + 1) as cap from s group by 1""")
def a35_nearest_rank_cap(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A35: the value of rank floor(0.9 * (n - 1)), from 0, without ordering a supplier's lines in one task."""
    found = ranks.at(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), lambda n: F.array(F.floor(F.lit(0.9) * (n - 1)) + 1))
    return found.select("l_suppkey", F.col("x").alias("cap"))


# Joins


@query("""select r_name, n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all""")
def j01_star_join(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J01, J08: the orders are summed by customer before they meet the dimensions; nation and region are fixed tables."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("v"))
    places = F.broadcast(table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey")))
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    return per.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.sum("k").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("""select p.fms_id, p.reporting_period, p.n as schedule_rows, m.n as money_rows from (select fms_id, reporting_period, count(*) as n from project_budget_schedule group by all) p
join (select fms_id, reporting_period, count(*) as n from budget_spend_by_fy group by all) m on p.fms_id = m.fms_id and p.reporting_period = m.reporting_period""")
def j02_multi_key_join(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda t, n: table(spark, sf, t).groupBy("fms_id", "reporting_period").agg(F.count(F.lit(1)).alias(n))
    return count("project_budget_schedule", "schedule_rows").join(count("budget_spend_by_fy", "money_rows"), ["fms_id", "reporting_period"])


@query("""select s.pid, s.schedule_name, h.n from project_schedules s left join (select pid, count(*) as n from schedule_history group by 1) h on h.pid = s.pid""")
def j03_left_join(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "schedule_history").groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "project_schedules").select("pid", "schedule_name").join(h, "pid", "left")


@query("""select s.pid, s.schedule_name from project_schedules s where not exists (select 1 from project_budget_schedule p where p.pid = s.pid)""")
def j04_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J04, P05: NOT EXISTS; null keys match nothing."""
    return table(spark, sf, "project_schedules").select("pid", "schedule_name").join(table(spark, sf, "project_budget_schedule").select("pid"), "pid", "left_anti")


@query("""select point_id, fms_id from loc_cpdb_points where fms_id in (select fms_id from project_budget_schedule where reporting_period = 202605)""")
def j05_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "project_budget_schedule").where("reporting_period = 202605").select("fms_id")
    return table(spark, sf, "loc_cpdb_points").select("point_id", "fms_id").join(now, "fms_id", "left_semi")


@query("""with v as (select fms_id, reporting_period, min(row_id) as r from project_budget_schedule group by all)
select a.fms_id, a.r as before_row, b.r as after_row from v a join v b on a.fms_id = b.fms_id and a.reporting_period = 202601 and b.reporting_period = 202605""")
def j07_self_join(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J07: two periods of one table side by side; one scan and one aggregation instead of a join with itself."""
    both = table(spark, sf, "project_budget_schedule").where("reporting_period in (202601, 202605)").groupBy("fms_id").agg(
        F.min(F.when(F.col("reporting_period") == 202601, F.col("row_id"))).alias("before_row"), F.min(F.when(F.col("reporting_period") == 202605, F.col("row_id"))).alias("after_row")
    )
    return both.where("before_row is not null and after_row is not null")


@query(r"""with c as (select doc_id, cast(unnest(regexp_extract_all(text, 'PID (\d+)', 1)) as bigint) as pid from documents)
select distinct c.doc_id, c.pid, s.schedule_name from c join project_schedules s on s.pid = c.pid""")
def j20_cited_ids(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J20: ids quoted in a text that are known."""
    cited = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"PID (\d+)"), F.lit(1))).alias("pid")).select("doc_id", F.col("pid").cast("bigint").alias("pid"))
    return cited.distinct().join(table(spark, sf, "project_schedules").select("pid", "schedule_name"), "pid").select("doc_id", "pid", "schedule_name")


@query("""select k.ps_part as l_partkey, k.ps_supp as l_suppkey, count(*) as n from lineitem l join (select p_partkey as ps_part, s_suppkey as ps_supp from part join supplier on p_partkey % 97 = s_suppkey % 97 and p_size = 1) k
on l.l_partkey = k.ps_part and l.l_suppkey = k.ps_supp group by all""")
def j19_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J19: a link on two columns; the lines are counted by pair before they meet the link table."""
    links = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 97).alias("m")).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 97).alias("m")), "m").drop("m")
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(links, ["l_partkey", "l_suppkey"])


# Filters and projections


@query("""select point_id, lon, lat from loc_cpdb_points where lon between -74.3 and -73.6 and lat between 40.4 and 41.0""")
def op_p02_bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "loc_cpdb_points").where(F.col("lon").between(-74.3, -73.6) & F.col("lat").between(40.4, 41.0)).select("point_id", "lon", "lat")


@query("""select row_id, case when year(completion_date) between 1990 and 2100 and abs(variance_day) <= 36500 then completion_date end as completion_date,
coalesce(not (year(completion_date) between 1990 and 2100 and abs(variance_day) <= 36500), false) as implausible from schedule_history""")
def op_p09_plausible_dates(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.year("completion_date").between(1990, 2100) & (F.abs("variance_day") <= 36500)
    return table(spark, sf, "schedule_history").select("row_id", F.when(ok, F.col("completion_date")).alias("completion_date"), F.coalesce(~ok, F.lit(False)).alias("implausible"))


@query(f"""select case when lower(trim(managing_agency)) not in {MISSING_SQL} then trim(managing_agency) end as agency, count(*) as n from project_budget_schedule group by 1""")
def op_p10_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy(present(F.col("managing_agency")).alias("agency")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""select doc_id from documents where regexp_matches(text, '\d+ percent') and text like '%the%' and text not ilike '%council%'""")
def op_p19_text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P19, P20: regular expression, LIKE and ILIKE."""
    t = F.col("text")
    return table(spark, sf, "documents").where(t.rlike(r"\d+ percent") & t.like("%the%") & ~t.ilike("%council%")).select("doc_id")


@query("""select l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), '-') || '/' || upper(l_linestatus) as code, cast(round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) as double) as charge,
case when l_quantity < 10 then 'small' when l_quantity < 30 then 'medium' else 'large' end as size_class, length(l_returnflag) as len, left(cast(l_partkey as varchar), 2) as head from lineitem""")
def op_p21_scalar_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P01, P21, P22: computed columns, NULL-propagating concatenation, CASE, casts and string scalars."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("-")), F.lit("/"), F.upper("l_linestatus")).alias("code"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 4).alias("charge"),
        F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large").alias("size_class"),
        F.length("l_returnflag").cast("bigint").alias("len"), F.left(F.col("l_partkey").cast("string"), F.lit(2)).alias("head"),
    )


def _facets() -> dict:
    bands = [(1e6, "under 1M"), (1e7, "1M-10M"), (1e8, "10M-100M"), (1e9, "100M-1B")]
    return {"program": F.array("program"), "borough": F.array("borough"), "agency": F.col("managing_agencies"), "size": F.array(facets.band(F.col("budget"), bands, "1B and more")), "tier": F.array("tier")}


_STATE = {"borough": ["Brooklyn", "Queens"], "agency": ["DPKS", "DBLD"]}
_BAND_SQL = "case when budget is null or isnan(budget) then null when budget < 1e6 then 'under 1M' when budget < 1e7 then '1M-10M' when budget < 1e8 then '10M-100M' when budget < 1e9 then '100M-1B' else '1B and more' end"


@query("""select row_id from nyc_capital_rows where borough in ('Brooklyn', 'Queens') and list_has_any(managing_agencies, ['DPKS', 'DBLD'])""")
def op_p11_faceted_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nyc_capital_rows").where(facets.matches(_facets(), _STATE)).select("row_id")


@query(f"""with f as (select *, coalesce(borough in ('Brooklyn', 'Queens'), false) as b, coalesce(list_has_any(managing_agencies, ['DPKS', 'DBLD']), false) as a, {_BAND_SQL} as size from nyc_capital_rows),
o as (select 'program' as facet, program as option from f where a and b union all select 'borough', borough from f where a union all select 'agency', unnest(list_distinct(managing_agencies)) from f where b
union all select 'size', size from f where a and b union all select 'tier', tier from f where a and b)
select facet, option, count(*) as n from o where option is not null group by all""")
def op_p13_facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-P12..P14: option counts of all facets under the other choices."""
    return facets.all_option_counts(table(spark, sf, "nyc_capital_rows"), _facets(), _STATE)


@query("""select c.o_orderkey from (select o_orderkey, o_orderkey - 1 as part_of from orders) c where not exists (select 1 from orders o where o.o_orderkey = c.part_of and o.o_orderstatus = 'F') """)
def op_p17_counted_once(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") - 1).alias("part_of"))
    final = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("part_of"))
    return rows.join(final, "part_of", "left_anti").select("o_orderkey")


# Sorting, top k and sets


@query("""select fms_id, total_budget, row_id from project_budget_schedule where isfinite(total_budget) order by total_budget desc, row_id limit 20""")
def o02_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """OP-O01, O02: a top-k report."""
    return table(spark, sf, "project_budget_schedule").select("fms_id", finite(F.col("total_budget")).alias("total_budget"), "row_id").where("total_budget is not null").orderBy(F.desc("total_budget"), "row_id").limit(20)


@query("""select managing_agency, fms_id, row_id, budget from (select managing_agency, fms_id, row_id, total_budget as budget from project_budget_schedule where isfinite(total_budget)) qualify row_number() over (partition by managing_agency order by budget desc, row_id desc) = 1""")
def o03_top1_per_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "project_budget_schedule").select("managing_agency", "fms_id", "row_id", finite(F.col("total_budget")).alias("budget")).where("budget is not null")
    return latest.latest(rows, ["managing_agency"], [F.col("budget"), F.col("row_id")], ["fms_id", "row_id", "budget"])


@query(r"""with m as (select doc_id, regexp_extract_all(text, '\d+ percent') as x from documents)
select doc_id, array_to_string(list_slice(list_filter(x, lambda v, i: list_position(x, v) = i), 1, 3), '|') as first_three from m""")
def o04_bounded_take(spark: SparkSession, sf: str) -> DataFrame:
    """OP-O04, O05: distinct matches in the order of the text, three at most per key (the feature of the report)."""
    found = F.regexp_extract_all("text", F.lit(r"\d+ percent"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(found), 1, 3), "|").alias("first_three"))


@query("""select fms_id from project_budget_schedule where fms_id is not null union select fms_id from project_history where fms_id is not null""")
def u02_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda t: table(spark, sf, t).select("fms_id").where("fms_id is not null")
    return ids("project_budget_schedule").union(ids("project_history")).distinct()


@query("""select fms_id from project_budget_schedule except select fms_id from loc_cpdb_points""")
def u03_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").select("fms_id").subtract(table(spark, sf, "loc_cpdb_points").select("fms_id"))


@query("""select fms_id from budget_spend_by_fy intersect select fms_id from loc_cpdb_points""")
def u04_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "budget_spend_by_fy").select("fms_id").intersect(table(spark, sf, "loc_cpdb_points").select("fms_id"))


@query("""with m as (select fms_id, period, max(budget) as budget from project_history group by all), o as (select fms_id, reporting_period as period, max(case when isfinite(total_budget) then total_budget end) as budget from project_budget_schedule group by all)
select fms_id, period, budget, false as filled from m union all select fms_id, period, budget, true from o where not exists (select 1 from m where m.fms_id = o.fms_id and m.period = o.period)""")
def u05_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    """OP-U01, U05, C19: the history, and the snapshots where it lacks a period."""
    main = table(spark, sf, "project_history").groupBy("fms_id", "period").agg(F.max("budget").alias("budget"))
    other = table(spark, sf, "project_budget_schedule").groupBy("fms_id", F.col("reporting_period").alias("period")).agg(F.max(finite(F.col("total_budget"))).alias("budget"))
    return rules.gap_fill(main, other, ["fms_id", "period"])


QUERIES, SQL = BOOK.queries, BOOK.sql
