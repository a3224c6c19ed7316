"""Composites: placement, themes, schedules, phases, finishes, exports and their parts (OP-C, OP-H). Each is one plan over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geometry, periods
from plinth.functions.values import cents, finite, present, squeezed
from plinth.operators import areas, asof, change, facets, latest, places, ranks, rules, spatial
from plinth.plans.basics import _BAND_SQL, _BANDS, record_facets
from plinth.plans.book import Book
from plinth.plans.further import LINES, line_edges
from plinth.plans.spatialplans import EDGES, HAV, IN_TOWN, district_edges, town
from plinth.plans.wording import _CAND, candidates
from plinth.sources import files
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query
ORDER = ("reporting_period", "loaded_at", "row_id")


def _fin(c: str) -> str:
    return f"case when isfinite({c}) then {c} end"


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule")


_LATEST = """latest as (select fms_id, arg_max(coalesce(agency_project_name, fms_project_name), (reporting_period, loaded_at, row_id)) filter (coalesce(agency_project_name, fms_project_name) is not null) as title,
arg_max(borough, (reporting_period, loaded_at, row_id)) filter (borough is not null) as borough, arg_max(community_board, (reporting_period, loaded_at, row_id)) filter (community_board is not null) as board,
max(reporting_period) as last_period from project_budget_schedule where fms_id is not null group by 1)"""


def described(spark: SparkSession, sf: str) -> DataFrame:
    """(fms_id, title, borough, board, last_period): the latest descriptive values of every project, in one aggregation."""
    last = lambda c: latest.last_value(c, _order())
    return projects(spark, sf).where("fms_id is not null").groupBy("fms_id").agg(
        last(F.coalesce("agency_project_name", "fms_project_name")).alias("title"), last(F.col("borough")).alias("borough"), last(F.col("community_board")).alias("board"), F.max("reporting_period").alias("last_period")
    )


# Placement

_TIERS = f"""{IN_TOWN}, {_LATEST}, {_CAND.replace("from nyc_capital_rows where title is not null", "from latest where title is not null")},
a as (select fms_id, 1 as p, 'A' as tier, 'points' as source, lon, lat from (select fms_id, arg_min(lon, point_id) as lon, arg_min(lat, point_id) as lat from town where fms_id is not null group by 1)),
b as (select l.fms_id, 2 as p, 'B' as tier, 'named station' as source, c.lon, c.lat from latest l join (select title, arg_max(lon, (n, letters, -station_no)) as lon, arg_max(lat, (n, letters, -station_no)) as lat from cand group by 1) c using (title)),
d as (select l.fms_id, 3 as p, 'D' as tier, 'district' as source, r.lon, r.lat from latest l join ref_community_districts r on l.board = r.borough || ' ' || lpad(cast(r.district as varchar), 2, '0')),
e as (select l.fms_id, 4 as p, 'E' as tier, 'borough' as source, r.lon, r.lat from latest l join (select borough, avg(lon) as lon, avg(lat) as lat from ref_community_districts group by 1) r using (borough)),
every as (select * from a union all select * from b union all select * from d union all select * from e), placed as (select fms_id, arg_min({{'tier': tier, 'source': source, 'lon': lon, 'lat': lat}}, p) as m from every group by 1)"""


def tier_rows(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The sources of places by tier, each (fms_id, source, lon, lat) with one row a project."""
    side, d = described(spark, sf), table(spark, sf, "ref_community_districts")
    points = town(spark, sf).where("fms_id is not null").groupBy("fms_id").agg(F.min(F.struct("point_id", "lon", "lat")).alias("m")).select("fms_id", F.lit("points").alias("source"), "m.lon", "m.lat")
    found = station_of(spark, sf, side.select("title").where("title is not null").distinct())
    named = side.select("fms_id", "title").join(found, "title").select("fms_id", F.lit("named station").alias("source"), "lon", "lat")
    board = d.select(F.format_string("%s %02d", "borough", "district").alias("board"), "lon", "lat")  # fixed tables
    district = side.join(F.broadcast(board), "board").select("fms_id", F.lit("district").alias("source"), "lon", "lat")
    middle = d.groupBy("borough").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    borough = side.join(F.broadcast(middle), "borough").select("fms_id", F.lit("borough").alias("source"), "lon", "lat")
    return {"A": points, "B": named, "D": district, "E": borough}


def station_of(spark: SparkSession, sf: str, titles: DataFrame) -> DataFrame:
    """(title, lon, lat): the station whose distinctive words best fit a title."""
    from plinth.functions import text
    from plinth.plans.wording import COMMON

    stations = table(spark, sf, "station_reach").select("station_no", "lon", "lat", F.regexp_replace("station", "[0-9]+", "").alias("station"))
    words = stations.select("station_no", "lon", "lat", F.length(F.array_join(text.distinctive(F.col("station"), COMMON), "")).alias("letters"))
    found = text.contained(titles, "title", "title", stations, "station_no", "station", COMMON).join(words, "station_no")
    return found.groupBy("title").agg(F.max(F.struct("n", "letters", (-F.col("station_no")).alias("s"), "lon", "lat")).alias("m")).select("title", "m.lon", "m.lat")


def placements(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C01: (fms_id, tier, source, lon, lat) of every project from the first tier that has it; Unplaced without any."""
    tiers = tier_rows(spark, sf)
    ranked = [df.select("fms_id", F.lit(i).alias("p"), F.lit(t).alias("tier"), "source", "lon", "lat") for i, (t, df) in enumerate(tiers.items())]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    best = every.groupBy("fms_id").agg(F.min(F.struct("p", "tier", "source", "lon", "lat")).alias("m")).select("fms_id", "m.tier", "m.source", "m.lon", "m.lat")
    known = projects(spark, sf).select("fms_id").where("fms_id is not null").distinct()
    return best.join(known, "fms_id", "full").withColumns({"tier": F.coalesce("tier", F.lit("Unplaced")), "source": F.coalesce("source", F.lit("none"))})


@query(f"""with {_TIERS} select coalesce(p.fms_id, l.fms_id) as fms_id, coalesce(m.tier, 'Unplaced') as tier, coalesce(m.source, 'none') as source, round(m.lon, 6) as lon, round(m.lat, 6) as lat from placed p full join latest l using (fms_id)""")
def c01_tiered_placement(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C01: places by tier: own points, a station named in the title, the district of the board, the borough, or none."""
    return placements(spark, sf).select("fms_id", "tier", "source", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""with {_TIERS}, v as (select {HAV.format(a='a.lon', b='a.lat', c='b.lon', d='b.lat')} as m from a join b using (fms_id)) select count(*) as n, count(*) filter (m <= 5000) as within_5_km, round(100.0 * count(*) filter (m <= 5000) / count(*), 4) as pct, round(median(m), 2) as median_m from v""")
def c03_placement_validation(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C03: the tier by name tried on projects whose points are known."""
    tiers = tier_rows(spark, sf)
    a, b = tiers["A"], tiers["B"].select("fms_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    off = a.join(b, "fms_id").select(spatial.haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")).alias("m"))
    middle = ranks.quantiles(off.withColumn("k", F.lit(1)), ["k"], F.col("m"), {"median_m": 0.5})
    count = off.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") <= 5000).alias("within_5_km"))
    return count.join(F.broadcast(middle.drop("k"))).select("n", "within_5_km", F.round(F.lit(100.0) * F.col("within_5_km") / F.col("n"), 4).alias("pct"), F.round("median_m", 2).alias("median_m"))


# Themes: the rule tables are fixed values.
_CATEGORY = {"Water Mains": "Water", "Trunk Sewers": "Water", "Ramps": "Streets", "Street Surfaces": "Streets", "Fire Houses": "Safety", "Shelters": "Housing"}
_AGENCY = {"DPKS": "Parks", "DLIB": "Libraries", "DCUL": "Culture", "DFIR": "Safety", "DPOL": "Safety", "DSAN": "Sanitation", "DHSG": "Housing", "DHOS": "Health"}
_LINE = {"LS": "Libraries", "CS": "Culture", "VS": "Fleet", "SS": "Housing"}


def _case(c: str, rules_: dict) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in rules_.items()) + " end"


_THEME = f"""th as (select row_id, {_case('ten_year_plan_category', _CATEGORY)} as a, {_case('upper(trim(sponsor_agency))', _AGENCY)} as b, {_case("regexp_extract(budget_line, '^([A-Z]{2})-', 1)", _LINE)} as c, {_case('upper(trim(managing_agency))', _AGENCY)} as d, lower(split_part(coalesce(agency_project_name, fms_project_name), ' ', 3)) as kind from project_budget_schedule)"""


def theme_columns() -> tuple[Column, Column]:
    """(theme, rule): by category, else sponsor, else budget line, else manager; with the rule that decided."""
    look = lambda rules_, key: F.try_element_at(F.create_map(*(F.lit(x) for kv in rules_.items() for x in kv)), key)
    line = F.regexp_extract("budget_line", r"^([A-Z]{2})-", 1)
    steps = [("category", look(_CATEGORY, F.col("ten_year_plan_category"))), ("sponsor", look(_AGENCY, F.upper(F.trim("sponsor_agency")))), ("budget line", look(_LINE, line)), ("manager", look(_AGENCY, F.upper(F.trim("managing_agency"))))]
    return F.coalesce(*(c for _, c in steps), F.lit("Other")), F.coalesce(rules.cascade([(n, c.isNotNull()) for n, c in steps]), F.lit("fallback"))


@query(f"""with {_THEME} select row_id, coalesce(a, b, c, d, 'Other') as theme, case when a is not null then 'category' when b is not null then 'sponsor' when c is not null then 'budget line' when d is not null then 'manager' else 'fallback' end as rule from th""")
def c04_theme_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C04: themes by a cascade over several fields, with the field that decided."""
    theme, rule = theme_columns()
    return projects(spark, sf).select("row_id", theme.alias("theme"), rule.alias("rule"))


# Budgets, phases and schedules

_KEY = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
_RANK = {"scoping": 1, "design": 2, "bidding": 3, "construction": 4, "closeout": 5, "completed": 6}
_RANK_SQL = "case " + _KEY + " " + " ".join(f"when '{k}' then {v}" for k, v in _RANK.items()) + " end"


def phase_key(c: str) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def phase_rank(c: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in _RANK.items() for x in kv)), phase_key(c))


_SNAP = f"snap as (select fms_id, reporting_period as p, max({_RANK_SQL.format('current_phase')}) as rank from project_budget_schedule where fms_id is not null and reporting_period is not null group by all)"


def snapshot_phases(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H02: (fms_id, p, rank): the most advanced phase over a record's parts in each snapshot."""
    return projects(spark, sf).where("fms_id is not null and reporting_period is not null").groupBy("fms_id", F.col("reporting_period").alias("p")).agg(F.max(phase_rank("current_phase")).alias("rank"))


@query(f"""with {_SNAP} select fms_id, p as period, case rank when 1 then 'scoping' when 2 then 'design' when 3 then 'bidding' when 4 then 'construction' when 5 then 'closeout' when 6 then 'completed' else 'no_phase' end as phase from snap""")
def h02_most_advanced_phase(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H02: the most advanced phase of a record's parts, no_phase without a known one."""
    return snapshot_phases(spark, sf).select("fms_id", F.col("p").alias("period"), phase_name(F.col("rank")).alias("phase"))


def phase_name(rank: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in _RANK.items() for x in (v, k))), rank), F.lit("no_phase"))


@query(f"""with {_SNAP}, orig as (select fms_id, min(period) as period, arg_min(budget, (period, loaded_at, row_id)) as budget from project_history where fms_id is not null and period is not null and budget is not null group by 1),
held as (select o.fms_id, o.period, s.rank, s.p from orig o asof left join (select * from snap where rank is not null) s on s.fms_id = o.fms_id and o.period >= s.p),
starts as (select fms_id, min(year(actual_construction_start) * 100 + month(actual_construction_start)) as c, min(year(actual_design_start) * 100 + month(actual_design_start)) as d from project_budget_schedule group by 1),
firsts as (select fms_id, arg_min(rank, p) as rank from snap where rank is not null group by 1)
select o.fms_id, o.period, case when h.rank is not null then h.rank when s.c <= o.period then 4 when s.d <= o.period then 2 when s.d > o.period then 1 when f.rank is not null then f.rank end as rank,
case when h.rank is not null then 'snapshot' when s.c <= o.period then 'construction start' when s.d <= o.period then 'design start' when s.d > o.period then 'design start after' when f.rank is not null then 'first snapshot' else 'unknown' end as rule
from orig o left join held h using (fms_id) left join starts s using (fms_id) left join firsts f using (fms_id)""")
def c06_phase_at_original(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C06, J10: the phase when the first budget was recorded: a snapshot at or before it, else actual starts, else the first snapshot."""
    orig = table(spark, sf, "project_history").where("fms_id is not null and period is not null and budget is not null").groupBy("fms_id").agg(F.min("period").alias("period"))
    snaps = snapshot_phases(spark, sf).where("rank is not null").withColumnRenamed("p", "period")
    held = asof.as_of(orig, snaps, ["fms_id"], "period", ["rank"]).select("fms_id", "period", F.col("rank").alias("held"))
    ym = lambda c: (F.year(c) * 100 + F.month(c)).cast("int")
    starts = projects(spark, sf).groupBy("fms_id").agg(F.min(ym("actual_construction_start")).alias("c"), F.min(ym("actual_design_start")).alias("d"))
    first = snaps.groupBy("fms_id").agg(F.min(F.struct("period", "rank"))["rank"].alias("first"))
    every = held.join(starts, "fms_id", "left").join(first, "fms_id", "left")
    steps = [("snapshot", F.col("held").isNotNull(), F.col("held")), ("construction start", F.col("c") <= F.col("period"), F.lit(4)), ("design start", F.col("d") <= F.col("period"), F.lit(2)), ("design start after", F.col("d") > F.col("period"), F.lit(1)), ("first snapshot", F.col("first").isNotNull(), F.col("first"))]
    rank = F.coalesce(*(F.when(c, v) for _, c, v in steps))
    return every.select("fms_id", "period", rank.alias("rank"), F.coalesce(rules.cascade([(n, c) for n, c, _ in steps]), F.lit("unknown")).alias("rule"))


_FIN = """c as (select pid, reporting_period as p, cast(completion_date as date) as f, completion_date_type = 'Actual' as actual, 1 as r from schedule_history where pid > 0 and reporting_period is not null and year(completion_date) <= 2100
union all select pid, reporting_period, cast(forecast_completion as date), false, 2 from project_budget_schedule where pid > 0 and reporting_period is not null and year(forecast_completion) <= 2100),
fin as (select pid, p, f, actual from c qualify row_number() over (partition by pid, p order by r, f desc, coalesce(actual, false) desc) = 1),
link as (select distinct fms_id, reporting_period as p, pid from project_budget_schedule where pid > 0 and fms_id is not null and reporting_period is not null),
k as (select l.fms_id, l.p, l.pid, fin.f, coalesce(fin.actual, false) as actual from link l join fin using (pid, p)), lastp as (select fms_id, max(reporting_period) as last from project_budget_schedule where fms_id is not null group by 1),
now as (select k.* from k join lastp using (fms_id) where p = last), base as (select fms_id, min(p) as base_p from k group by 1), prev as (select k.fms_id, max(p) as prev_p from k join lastp using (fms_id) where p < last group by 1)"""


def linked_finishes(spark: SparkSession, sf: str) -> DataFrame:
    """(fms_id, p, pid, f, actual): the best finish of each schedule of a project in each report."""
    h = table(spark, sf, "schedule_history").where("pid > 0 and reporting_period is not null and year(completion_date) <= 2100").select("pid", F.col("reporting_period").alias("p"), F.lit(-1).alias("r"), F.to_date("completion_date").alias("f"), F.coalesce(F.col("completion_date_type") == "Actual", F.lit(False)).alias("actual"))
    rows = projects(spark, sf).where("pid > 0 and reporting_period is not null")
    s = rows.where("year(forecast_completion) <= 2100").select("pid", F.col("reporting_period").alias("p"), F.lit(-2).alias("r"), F.to_date("forecast_completion").alias("f"), F.lit(False).alias("actual"))
    best = h.unionByName(s).groupBy("pid", "p").agg(F.max(F.struct("r", "f", "actual")).alias("m")).select("pid", "p", "m.f", "m.actual")
    links = rows.where("fms_id is not null").select("fms_id", F.col("reporting_period").alias("p"), "pid").distinct()
    return links.join(best, ["pid", "p"])


def city_schedules(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W15, H23, C07: (fms_id, last, expected_finish, finish_kind, baseline_finish, baseline_as_of, late_days, slip_days, pid_set_changed).

    Per project, three reports matter: the last one, the one held first and the one before the last. Their schedules lie side by side in
    one aggregation by project and pid; finishes are compared over the schedules in both only.
    """
    k = linked_finishes(spark, sf)
    last = projects(spark, sf).where("fms_id is not null").groupBy("fms_id").agg(F.max("reporting_period").alias("last"))
    marks = k.join(last, "fms_id").groupBy("fms_id", "last").agg(F.min("p").alias("base_p"), F.max(F.when(F.col("p") < F.col("last"), F.col("p"))).alias("prev_p"))
    at = lambda p, c: F.max(F.when(F.col("p") == F.col(p), F.col(c)))
    wide = k.join(marks, "fms_id").where("p in (last, base_p, prev_p)").groupBy("fms_id", "last", "base_p", "prev_p", "pid").agg(
        at("last", "f").alias("now"), F.max((F.col("p") == F.col("last")) & F.col("actual")).alias("actual"), at("base_p", "f").alias("base"), at("prev_p", "f").alias("prev")
    )
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    s = wide.groupBy("fms_id", "last", "base_p", "prev_p").agg(
        F.max("now").alias("expected_finish"), F.bool_and(F.when(F.col("now").isNotNull(), F.col("actual"))).alias("done"), F.max("base").alias("baseline_finish"),
        F.datediff(F.max(both("now", "base")), F.max(both("base", "now"))).alias("late_days"), F.datediff(F.max(both("now", "prev")), F.max(both("prev", "now"))).alias("slip_days"),
        F.max(F.col("now").isNull() != F.col("base").isNull()).alias("pid_set_changed"),
    ).where("expected_finish is not null")
    return s.select("fms_id", "last", "expected_finish", F.when(F.col("done"), "actual").otherwise("forecast").alias("finish_kind"), "baseline_finish", F.col("base_p").alias("baseline_as_of"), F.col("late_days").cast("bigint").alias("late_days"), F.col("slip_days").cast("bigint").alias("slip_days"), "pid_set_changed")


_SCHED = f"""{_FIN}, w as (select n.fms_id, max(n.f) as finish, bool_and(n.actual) as done from now n group by 1), bl as (select k.fms_id, max(f) as f from k join base on base.fms_id = k.fms_id and base.base_p = k.p group by 1),
lt as (select n.fms_id, datediff('day', max(b.f), max(n.f)) as late_days from now n join base using (fms_id) join k b on b.fms_id = n.fms_id and b.pid = n.pid and b.p = base.base_p group by 1),
sl as (select n.fms_id, datediff('day', max(b.f), max(n.f)) as slip_days from now n join prev using (fms_id) join k b on b.fms_id = n.fms_id and b.pid = n.pid and b.p = prev.prev_p group by 1),
sched as (select w.fms_id, lastp.last, w.finish as expected_finish, case when w.done then 'actual' else 'forecast' end as finish_kind, bl.f as baseline_finish, base.base_p as baseline_as_of, lt.late_days, sl.slip_days from w join lastp using (fms_id) join base using (fms_id) join bl using (fms_id) left join lt using (fms_id) left join sl using (fms_id))"""


@query(f"""with {_SCHED}, pub as (select fms_id, last_reported, cast(forecast_completion as date) as f, phase from nyc_capital_rows where regexp_full_match(forecast_completion, '\\d{{4}}-\\d{{2}}-\\d{{2}}') qualify row_number() over (partition by fms_id order by last_reported desc nulls last, row_id desc) = 1)
select 'schedules' as program, fms_id as project_id, last as as_of, expected_finish, finish_kind, baseline_finish, baseline_as_of, late_days, slip_days from sched
union all select 'published', fms_id, last_reported, f, case when regexp_replace(lower(phase), '[^a-z]', '', 'g') = 'completed' then 'actual' else 'forecast' end, null, null, null, null from pub""", days=("expected_finish", "baseline_finish"))
def c07_unified_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C07: the schedules of several programs in one form."""
    city = city_schedules(spark, sf).drop("pid_set_changed").withColumnsRenamed({"fms_id": "project_id", "last": "as_of"}).withColumn("program", F.lit("schedules"))
    rows = table(spark, sf, "nyc_capital_rows").where(F.col("forecast_completion").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    p = latest.latest(rows, ["fms_id"], [F.col("last_reported"), F.col("row_id")], ["last_reported", "forecast_completion", "phase"])
    other = p.select(F.lit("published").alias("program"), F.col("fms_id").alias("project_id"), F.col("last_reported").alias("as_of"), F.to_date("forecast_completion").alias("expected_finish"), F.when(phase_key("phase") == "completed", "actual").otherwise("forecast").alias("finish_kind"))
    return city.unionByName(other, allowMissingColumns=True)


_MILES = (("design", "actual_design_start", "actual_design_end"), ("procurement", "actual_construction_procurement_start", "actual_construction_procurement_end"), ("construction", "actual_construction_start", "actual_construction_end"))
_LASTROWS = "lastrows as (select * from project_budget_schedule where fms_id is not null qualify reporting_period = max(reporting_period) over (partition by fms_id))"


@query(f"""with {_LASTROWS}, m as ({' union all '.join(f"select fms_id, '{n}' as phase, min(cast({a} as date)) as began, case when bool_and({b} is not null) then max(cast({b} as date)) end as ended, 'milestone' as rule from lastrows group by 1" for n, a, b in _MILES)}),
c as (select fms_id, case regexp_replace(lower(current_phase), '[^a-z]', '', 'g') when 'design' then 'design' when 'bidding' then 'procurement' when 'construction' then 'construction' end as phase, min(cast(current_phase_start as date)) as s, max(cast(forecast_current_phase_end as date)) as e from lastrows group by all),
j as (select coalesce(m.fms_id, c.fms_id) as fms_id, coalesce(m.phase, c.phase) as phase, coalesce(m.began, c.s) as began, coalesce(m.ended, c.e) as ended, case when m.ended is not null then 'actual' when c.e is not null then 'forecast' end as end_kind from (select * from m where began is not null or ended is not null) m full join (select * from c where phase is not null and (s is not null or e is not null)) c on c.fms_id = m.fms_id and c.phase = m.phase)
select * from j""", days=("began", "ended"))
def c08_unified_phases(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C08, W21: the phases of a project at its last report: milestone dates, filled by the start and forecast end of the current phase."""
    rows = latest_rows(spark, sf)
    cells = F.array(*(F.struct(F.lit(n).alias("phase"), F.to_date(a).alias("a"), F.to_date(b).alias("b")) for n, a, b in _MILES))
    m = rows.select("fms_id", F.explode(cells).alias("c")).groupBy("fms_id", "c.phase").agg(F.min("c.a").alias("began"), latest.max_if_all(F.col("c.b")).alias("ended")).where("began is not null or ended is not null")
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in {"design": "design", "bidding": "procurement", "construction": "construction"}.items() for x in kv)), phase_key("current_phase"))
    c = rows.groupBy("fms_id", name.alias("phase")).agg(F.min(F.to_date("current_phase_start")).alias("s"), F.max(F.to_date("forecast_current_phase_end")).alias("e")).where("phase is not null and (s is not null or e is not null)")
    kind = F.when(F.col("ended").isNotNull(), "actual").when(F.col("e").isNotNull(), "forecast")
    return m.join(c, ["fms_id", "phase"], "full").select("fms_id", "phase", F.coalesce("began", "s").alias("began"), F.coalesce("ended", "e").alias("ended"), kind.alias("end_kind"))


def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of each project's last report; the last period is joined back, so a hot project stays spread."""
    rows = projects(spark, sf).where("fms_id is not null")
    last = rows.groupBy("fms_id").agg(F.max("reporting_period").alias("reporting_period"))
    return rows.join(last, ["fms_id", "reporting_period"])


@query(f"""with r as (select fms_id, reporting_period as p, bool_and(coalesce({_KEY.format('current_phase')} = 'completed', false) or actual_construction_end is not null) as done, max(cast(actual_construction_end as date)) as d from project_budget_schedule where fms_id is not null and reporting_period is not null group by all), l as (select max(p) as last from r),
f as (select fms_id, arg_max(done, p) as done, max(p) as listed, min(p) filter (done) as first_done, max(p) filter (not done) as last_open, arg_max(d, p) as finish from r group by 1)
select fms_id, case when done then 'finished' when listed < last then 'left_unfinished' else 'still_listed' end as outcome, case when done then finish end as finish_date, case when done then first_done end as first_reported, coalesce(done and first_done < last_open, false) as reopened from f cross join l""", days=("finish_date",))
def c09_finish_detection(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C09: how each project ends over all reports, with the finish date of its last one and whether it was reopened."""
    done = F.coalesce(phase_key("current_phase") == "completed", F.lit(False)) | F.col("actual_construction_end").isNotNull()
    r = projects(spark, sf).where("fms_id is not null and reporting_period is not null").groupBy("fms_id", F.col("reporting_period").alias("p")).agg(F.bool_and(done).alias("done"), F.max(F.to_date("actual_construction_end")).alias("d"))
    f = r.groupBy("fms_id").agg(F.max(F.struct("p", "done", "d")).alias("z"), F.min(F.when(F.col("done"), F.col("p"))).alias("first_done"), F.max(F.when(~F.col("done"), F.col("p"))).alias("last_open"))
    f = f.join(F.broadcast(projects(spark, sf).agg(F.max("reporting_period").alias("last"))))  # one row
    outcome = F.when(F.col("z.done"), "finished").when(F.col("z.p") < F.col("last"), "left_unfinished").otherwise("still_listed")
    return f.select("fms_id", outcome.alias("outcome"), F.when(F.col("z.done"), F.col("z.d")).alias("finish_date"), F.when(F.col("z.done"), F.col("first_done")).alias("first_reported"), F.coalesce(F.col("z.done") & (F.col("first_done") < F.col("last_open")), F.lit(False)).alias("reopened"))


@query(f"""with h as (select pid, reporting_period as p, {_RANK_SQL.format('current_phase')} as rank, variance_day as v, cast(completion_date as date) as f, row_id from schedule_history where pid > 0)
select pid, count(*) as n, case when bool_and(coalesce(rank = 6, false)) then 'complete' when bool_and(coalesce(rank = 1, false)) then 'not_started' else 'active' end as status, case when count(*) = count(f) then max(f) end as ended, sum(abs(v)) as moved, 'P' || lpad(cast(pid as varchar), 8, '0') as project_key from h group by 1""", days=("ended",))
def c10_parts_to_projects(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C10, A28, H20: phase rows as one project each: status, end where all have one, sums, and a surrogate key."""
    rank, f = phase_rank("current_phase"), F.to_date("completion_date")
    all_of = lambda n: F.bool_and(F.coalesce(rank == n, F.lit(False)))
    return table(spark, sf, "schedule_history").where("pid > 0").groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"), F.when(all_of(6), "complete").when(all_of(1), "not_started").otherwise("active").alias("status"), latest.max_if_all(f).alias("ended"), F.sum(F.abs("variance_day")).alias("moved")
    ).withColumn("project_key", F.concat(F.lit("P"), F.lpad(F.col("pid").cast("string"), 8, "0")))


@query("""select row_id, coalesce(nullif(regexp_replace(fms_id, '[^A-Za-z0-9]', '', 'g'), '') || '-' || coalesce(cast(pids[1] as varchar), '0'), 'R' || cast(row_id as varchar)) as project_key from nyc_capital_rows""")
def h20_surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H20: a key from the ids that a record has, else from its row."""
    ident = F.nullif(F.regexp_replace("fms_id", "[^A-Za-z0-9]", ""), F.lit(""))
    key = F.concat(ident, F.lit("-"), F.coalesce(F.get("pids", F.lit(0)).cast("string"), F.lit("0")))
    return table(spark, sf, "nyc_capital_rows").select("row_id", F.coalesce(key, F.concat(F.lit("R"), F.col("row_id").cast("string"))).alias("project_key"))


@query(f"""with {IN_TOWN}, s as (select fms_id, 1 as p, point_id as t, 'own point' as source, lon, lat from town where fms_id is not null union all
select r.fms_id, 2, r.row_id, 'name', c.lon, c.lat from nyc_capital_rows r join (select title, avg(x.lon) as lon, avg(x.lat) as lat from (select distinct title, x.lon, x.lat, x.point_id from nyc_capital_rows n join town x using (fms_id) where title is not null) x group by 1 having max(lon) - min(lon) < 0.02 and max(lat) - min(lat) < 0.02) c using (title) where r.fms_id is not null union all
select r.fms_id, 3, r.row_id, 'borough', b.lon, b.lat from nyc_capital_rows r join (select borough, avg(lon) as lon, avg(lat) as lat from ref_community_districts group by 1) b using (borough) where r.fms_id is not null)
select fms_id, source, round(lon, 6) as lon, round(lat, 6) as lat from s qualify row_number() over (partition by fms_id order by p, t) = 1""")
def c11_source_precedence_with_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C11: the place of a record from its own points, else from points of records of the same name where these lie together, else
    from its borough."""
    points, rows = town(spark, sf).where("fms_id is not null"), table(spark, sf, "nyc_capital_rows").where("fms_id is not null")
    named = table(spark, sf, "nyc_capital_rows").where("title is not null").select("title", "fms_id").distinct().join(points, "fms_id").select("title", "lon", "lat", "point_id").distinct()
    spread = lambda c: F.max(c) - F.min(c)
    close = named.groupBy("title").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), spread("lon").alias("a"), spread("lat").alias("b")).where("a < 0.02 and b < 0.02").select("title", "lon", "lat")
    middle = table(spark, sf, "ref_community_districts").groupBy("borough").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    out = rules.precedence([
        ("own point", points.select("fms_id", F.col("point_id").alias("t"), "lon", "lat")),
        ("name", rows.select("fms_id", "row_id", "title").join(close, "title").select("fms_id", F.col("row_id").alias("t"), "lon", "lat")),
        ("borough", rows.select("fms_id", "row_id", "borough").join(F.broadcast(middle), "borough").select("fms_id", F.col("row_id").alias("t"), "lon", "lat")),
    ], "fms_id", ["lon", "lat"], "t")
    return out.select("fms_id", "source", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""with w as (select period, bool_or(coalesce(spend <> 0, false)) as given from project_history group by 1), h as (select p.*, case when w.given then p.spend end as s from project_history p join w on w.period is not distinct from p.period where fms_id is not null)
select fms_id, min(period) as first_period, max(period) as last_period, count(*) as n, arg_min(budget, (period, row_id)) filter (budget <> 0) as first_budget, arg_max(budget, (period, row_id)) filter (budget <> 0) as last_budget, round(arg_max(budget, (period, row_id)) filter (budget <> 0) - arg_min(budget, (period, row_id)) filter (budget <> 0), 2) as moved,
arg_max(s, (period, row_id)) filter (s is not null) as spend, max(period) < (select max(period) from project_history) as gone from h group by 1""")
def c12_held_history(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C12, A32, W12: a project's first and last values held, with a field that a whole report withholds read as unknown."""
    rows = table(spark, sf, "project_history")
    given = rows.groupBy(F.col("period").alias("p")).agg(F.bool_or(F.coalesce(F.col("spend") != 0, F.lit(False))).alias("given"))  # a row a report
    h = rows.where("fms_id is not null").join(F.broadcast(given), F.col("period").eqNullSafe(F.col("p"))).withColumn("s", F.when(F.col("given"), F.col("spend")))
    order, b = [F.col("period"), F.col("row_id")], F.when(F.col("budget") != 0, F.col("budget"))
    f = h.groupBy("fms_id").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n"), latest.first_value(b, order).alias("first_budget"), latest.last_value(b, order).alias("last_budget"), latest.last_value(F.col("s"), order).alias("spend"))
    f = f.join(F.broadcast(rows.agg(F.max("period").alias("top"))))  # one row
    return f.select("fms_id", "first_period", "last_period", "n", "first_budget", "last_budget", F.round(F.col("last_budget") - F.col("first_budget"), 2).alias("moved"), "spend", (F.col("last_period") < F.col("top")).alias("gone"))


_REPAIRED = "rp as (select point_id, fms_id, description, case when lon between -75 and -73 and lat between 40 and 42 then lon when lat between -75 and -73 and lon between 40 and 42 then lat when -lon between -75 and -73 and lat between 40 and 42 then -lon end as lon, case when lon between -75 and -73 and lat between 40 and 42 then lat when lat between -75 and -73 and lon between 40 and 42 then lon when -lon between -75 and -73 and lat between 40 and 42 then lat end as lat from loc_cpdb_points where isfinite(lon) and isfinite(lat))"


@query(f"""with {_REPAIRED}, {EDGES}, h as (select point_id, min(boro_cd) as cd from (select point_id, boro_cd from rp join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1) group by 1), b as (select fms_id, borough from (select fms_id, borough, count(*) as n from project_budget_schedule where borough is not null group by all) qualify row_number() over (partition by fms_id order by n desc, borough) = 1)
select rp.point_id, d.borough as found, b.borough as said, case when rp.lon is null then 'no place' when h.cd is null then 'outside' when b.borough is null then 'not said' when d.borough = b.borough then 'agrees' else 'differs' end as verdict from rp left join h using (point_id) left join ref_community_districts d on d.boro_cd = h.cd left join b using (fms_id)""")
def c13_point_checks(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C13, G19: points put right, then their borough against the one that the project says."""
    raw = spatial._placed(table(spark, sf, "loc_cpdb_points"), F.struct("point_id", "fms_id"), F.col("lon"), F.col("lat")).select("point_id.*", "lon", "lat")
    fits = lambda x, y: x.between(-75, -73) & y.between(40, 42)
    x, y = F.col("lon"), F.col("lat")
    right = lambda a, b, c: F.when(fits(x, y), a).when(fits(y, x), b).when(fits(-x, y), c)
    p = raw.select("point_id", "fms_id", right(x, y, -x).alias("lon"), right(y, x, y).alias("lat"))
    held = spatial.inside(p, F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf)).groupBy("point_id").agg(F.min("ref_id").alias("boro_cd"))
    names = table(spark, sf, "ref_community_districts").select("boro_cd", F.col("borough").alias("found"))
    said = latest.mode(projects(spark, sf), ["fms_id"], "borough").select("fms_id", F.col("borough").alias("said"))
    every = p.join(held, "point_id", "left").join(F.broadcast(names), "boro_cd", "left").join(said, "fms_id", "left")
    verdict = F.when(F.col("lon").isNull(), "no place").when(F.col("boro_cd").isNull(), "outside").when(F.col("said").isNull(), "not said").when(F.col("found") == F.col("said"), "agrees").otherwise("differs")
    return every.select("point_id", "found", "said", verdict.alias("verdict"))


_CLASS_RULES = [("citywide", r"(?i)citywide|generator"), ("regional", r"(?i)trunk|water main|bridge"), ("local", r"(?i)playground|comfort|facade|roof|street")]
_CLASS_SQL = "case when borough = 'Citywide' then 'citywide' " + " ".join(f"when regexp_matches(title, '{p}') then '{n}'" for n, p in _CLASS_RULES) + " else 'unknown' end"


def serving_units(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H28: (row_id, unit, share, class): the managing agencies of a record as its units, one without any; each is classified."""
    unit = F.explode_outer(F.when(F.size("managing_agencies") > 0, F.array_distinct("managing_agencies")))
    rows = table(spark, sf, "nyc_capital_rows").withColumn("class", F.when(F.col("borough") == "Citywide", "citywide").otherwise(F.coalesce(rules.cascade([(n, F.col("title").rlike(p)) for n, p in _CLASS_RULES]), F.lit("unknown"))))
    n = F.greatest(F.size(F.array_distinct(F.coalesce("managing_agencies", F.array().cast("array<string>")))), F.lit(1))
    return rows.select("row_id", "fms_id", "class", (F.lit(1.0) / n).alias("share"), unit.alias("unit"))


_UNITS = f"un as (select row_id, fms_id, {_CLASS_SQL} as class, 1.0 / greatest(coalesce(len(list_distinct(list_transform(managing_agencies, lambda x: coalesce(x, '~')))), 0), 1) as share, unnest(case when coalesce(len(managing_agencies), 0) > 0 then list_distinct(list_transform(managing_agencies, lambda x: coalesce(x, '~'))) else [null] end) as unit from nyc_capital_rows)"


@query(f"with {_UNITS} select row_id, nullif(unit, '~') as unit, class, round(share, 6) as share from un")
def h28_unit_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H28: the units of a record with their class and share."""
    return serving_units(spark, sf).select("row_id", "unit", "class", F.round("share", 6).alias("share"))


@query(f"""with {_UNITS}, s as (select fms_id, class, sum(share) as v from un where fms_id is not null group by all), t as (select fms_id, class, v / sum(v) over (partition by fms_id) as share from s) select fms_id, arg_max(class, (share, class)) as area_class, round(max(share), 6) as top_share, count(*) as classes from t group by 1""")
def c16_serving_class(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C16, A37: the shares of classes over a project's units, and the class that leads."""
    s = serving_units(spark, sf).where("fms_id is not null").groupBy("fms_id", "class").agg(F.sum("share").alias("v"))
    f = s.groupBy("fms_id").agg(F.sum("v").alias("t"), F.max(F.struct("v", "class")).alias("m"), F.count(F.lit(1)).alias("classes"))
    return f.select("fms_id", F.col("m.class").alias("area_class"), F.round(F.col("m.v") / F.col("t"), 6).alias("top_share"), "classes")


@query(f"""with {EDGES}, k as (select station_no, lon, lat, cast(radius_m as double) as r, residents, cast(ceil(radius_m / 100.0) as integer) as k from station_reach), ij as (select *, unnest(range(-k, k + 1)) as i from k), c as (select *, unnest(range(-k, k + 1)) as j from ij),
cells as (select station_no, i, j, lon + i * 100.0 / (6371000.0 * pi() / 180 * cos(radians(lat))) as x, lat + j * 100.0 / (6371000.0 * pi() / 180) as y from c where pow(i * 100.0, 2) + pow(j * 100.0, 2) <= r * r), hit as (select station_no, i, j, boro_cd from cells join edges on (ay > y) <> (by_ > y) and x < ax + (y - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1),
n as (select station_no, boro_cd, count(*) as cells from hit group by all), sh as (select station_no, boro_cd, cells / sum(cells) over (partition by station_no) as share from n), o as (select residents, row_number() over (order by residents) as i, count(*) over () as n from station_reach), cap as (select residents as cap from o where i = cast(floor(0.9 * (n - 1)) as bigint) + 1)
select boro_cd, round(sum(share * least(residents, cap)), 3) as riders from sh join station_reach using (station_no) cross join cap group by 1""")
def c17_riders_homes(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C17, G15, A35: residents of stations, no more than a nearest-rank cap each, spread over the districts of their reach."""
    s = table(spark, sf, "station_reach")
    cells = places.grid_around(s, F.col("station_no"), F.col("lon"), F.col("lat"), F.col("radius_m"), 100.0).select(F.struct("ref_id", "i", "j").alias("cell"), "lon", "lat")
    hit = spatial.inside(cells, F.col("cell"), F.col("lon"), F.col("lat"), district_edges(spark, sf))
    n = hit.groupBy(F.col("point_id.ref_id").alias("station_no"), F.col("ref_id").alias("boro_cd")).agg(F.count(F.lit(1)).alias("cells"))
    cap = ranks.at(s, [], F.col("residents"), lambda t: F.array(F.floor(F.lit(0.9) * (t - 1)) + 1)).select(F.col("x").alias("cap"))
    both = areas.normalised(n, ["station_no"], "cells").join(F.broadcast(s.select("station_no", "residents")), "station_no").join(F.broadcast(cap))  # a fixed table and one row
    return both.groupBy("boro_cd").agg(F.round(F.sum(F.col("share") * F.least(F.col("residents").cast("double"), F.col("cap"))), 3).alias("riders"))


_WHERE = f"""{_TIERS}, un2 as (select l.fms_id, case when l.borough = 'Citywide' then 'citywide' {' '.join(f"when regexp_matches(l.title, '{p}') then '{n}'" for n, p in _CLASS_RULES)} else 'unknown' end as class from latest l),
spot as (select fms_id, m.tier as tier, m.lon as lon, m.lat as lat from placed), hit as (select fms_id, min(boro_cd) as cd from (select fms_id, boro_cd from spot join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by fms_id, boro_cd having count(*) % 2 = 1) group by 1)"""


@query(f"""with {EDGES}, {_WHERE} select u.fms_id, case when u.class = 'citywide' then 'citywide' when s.fms_id is null then 'citywide' when s.tier = 'E' or (u.class = 'regional' and h.cd is not null) then 'borough' when h.cd is not null then 'district' else 'outside' end as level,
case when u.class = 'citywide' or s.fms_id is null then null when s.tier = 'E' then l.borough when u.class = 'regional' and h.cd is not null then d.borough when h.cd is not null then cast(h.cd as varchar) end as area, case when u.class = 'citywide' then 'class' when s.fms_id is null then 'unplaced' else 'tier ' || s.tier end as method
from un2 u join latest l using (fms_id) left join spot s using (fms_id) left join hit h using (fms_id) left join ref_community_districts d on d.boro_cd = h.cd""")
def c18_where_money_counts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C18, H17: the area in which a project's money counts: the district that holds its place, the borough of regional work, the city."""
    side = described(spark, sf)
    cls = F.when(F.col("borough") == "Citywide", "citywide").otherwise(F.coalesce(rules.cascade([(n, F.col("title").rlike(p)) for n, p in _CLASS_RULES]), F.lit("unknown")))
    placed = placements(spark, sf).where("tier != 'Unplaced'")
    held = spatial.inside(placed, F.col("fms_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf)).groupBy(F.col("point_id").alias("fms_id")).agg(F.min("ref_id").alias("cd"))
    names = table(spark, sf, "ref_community_districts").select(F.col("boro_cd").alias("cd"), F.col("borough").alias("its_borough"))
    every = side.withColumn("class", cls).join(placed.select("fms_id", "tier"), "fms_id", "left").join(held, "fms_id", "left").join(F.broadcast(names), "cd", "left")
    none, wide, inside = F.col("tier").isNull(), (F.col("class") == "regional") & F.col("cd").isNotNull(), F.col("cd").isNotNull()
    level = F.when((F.col("class") == "citywide") | none, "citywide").when((F.col("tier") == "E") | wide, "borough").when(inside, "district").otherwise("outside")
    area = F.when((F.col("class") == "citywide") | none, None).when(F.col("tier") == "E", F.col("borough")).when(wide, F.col("its_borough")).when(inside, F.col("cd").cast("string"))
    return every.select("fms_id", level.alias("level"), area.alias("area"), F.when(F.col("class") == "citywide", "class").when(none, "unplaced").otherwise(F.concat(F.lit("tier "), F.col("tier"))).alias("method"))


@query(f"""with main as (select fms_id, reporting_period as period, sum(v) as budget from (select fms_id, managing_agency, reporting_period, max({_fin('total_budget')}) as v from project_budget_schedule where fms_id is not null and reporting_period is not null group by all) group by all), other as (select fms_id, period, max(budget) as budget from project_history where fms_id is not null and period is not null group by all)
select fms_id, period, round(budget, 2) as budget, false as filled from main union all select fms_id, period, round(budget, 2), true from other o where not exists (select 1 from main m where m.fms_id = o.fms_id and m.period = o.period)""")
def c19_budget_history(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C19, A03, U05: the deduplicated budget of every period, gaps filled from a second source."""
    record = projects(spark, sf).where("fms_id is not null and reporting_period is not null").groupBy("fms_id", "managing_agency", F.col("reporting_period").alias("period")).agg(F.max(finite(F.col("total_budget"))).alias("v"))
    main = record.groupBy("fms_id", "period").agg(F.sum("v").alias("budget"))
    other = table(spark, sf, "project_history").where("fms_id is not null and period is not null").groupBy("fms_id", "period").agg(F.max("budget").alias("budget"))
    return rules.gap_fill(main, other, ["fms_id", "period"]).withColumn("budget", F.round("budget", 2))


@query("""select mega_project as line, count(*) as stations, sum(residents) as residents, string_agg(station, '; ' order by residents desc, station_no) filter (i <= 3) as largest from (select *, row_number() over (partition by mega_project order by residents desc, station_no) as i from station_reach) group by 1""")
def c20_line_story(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C20: one record a line with its three largest stations (a top-k report), from one aggregation."""
    s = table(spark, sf, "station_reach").groupBy(F.col("mega_project").alias("line")).agg(F.count(F.lit(1)).alias("stations"), F.sum("residents").alias("residents"), F.array_sort(F.collect_list(F.struct((-F.col("residents")).alias("r"), "station_no", "station"))).alias("x"))
    return s.select("line", "stations", "residents", F.array_join(F.transform(F.slice("x", 1, 3), lambda r: r["station"]), "; ").alias("largest"))


_KINDS = [("reserve", r"(?i)vehicles|reading"), ("repair", r"(?i)rehabilitation|repair|restoration|reconstruction"), ("new", r"(?i)extension|installation|modernization")]


@query(f"""with d as (select fms_id, row_id, {"case " + " ".join(f"when regexp_matches(coalesce(title, ''), '{p}') then '{n}'" for n, p in _KINDS) + " else 'physical' end"} as drafted from nyc_capital_rows), r as (select fms_id, max(ten_year_plan_category) as kind from project_budget_schedule where ten_year_plan_category in ('Vehicles', 'Shelters') group by 1)
select d.row_id, coalesce(r.kind, d.drafted) as kind, case when r.kind is not null then 'reviewed' else 'drafted' end as basis from d left join r using (fms_id)""")
def c23_reviewed_classification(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C23, T24, Q04: a kind drafted by patterns, a reviewed one where there is one."""
    drafted = F.coalesce(rules.cascade([(n, F.col("title").rlike(p)) for n, p in _KINDS]), F.lit("physical"))
    rows = table(spark, sf, "nyc_capital_rows").select("row_id", "fms_id", drafted.alias("kind"))
    reviewed = projects(spark, sf).where(F.col("ten_year_plan_category").isin("Vehicles", "Shelters")).groupBy("fms_id").agg(F.max("ten_year_plan_category").alias("kind"))
    out = rules.override(rows, reviewed, "fms_id", "kind")
    return out.select("row_id", "kind", F.when(F.col("reviewed"), "reviewed").otherwise("drafted").alias("basis"))


@query(f"""with {IN_TOWN}, s as (select fms_id, lon, lat, point_id, count(*) over (partition by fms_id) as n from town where fms_id is not null) select r.row_id, s.point_id, case when s.n = 1 then 'whole' when s.n > 1 then 'site' else 'no dot' end as dot, case when s.n > 0 then round({_fin('r.budget')} / s.n, 2) end as money from nyc_capital_rows r left join s using (fms_id)""")
def c24_site_dots(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C24: a dot for each site with its part of the money, the whole of it for a single site, and records without sites."""
    sites = areas.site_shares(town(spark, sf).where("fms_id is not null").withColumn("w", F.lit(None).cast("double")), "fms_id", "w").select("fms_id", "point_id", "share")
    rows = table(spark, sf, "nyc_capital_rows").select("row_id", "fms_id", finite(F.col("budget")).alias("b")).join(sites, "fms_id", "left")
    dot = F.when(F.col("share") == 1, "whole").when(F.col("share") < 1, "site").otherwise("no dot")
    return rows.select("row_id", "point_id", dot.alias("dot"), F.round(F.col("b") * F.col("share"), 2).alias("money"))


# Exports

_EXPORT = f"""{_LATEST}, rec as (select fms_id, managing_agency, reporting_period, max({_fin('total_budget')}) as v, max({_fin('spend_to_date')}) as s from project_budget_schedule where fms_id is not null group by all), per as (select fms_id, reporting_period, count(*) as agencies, sum(v) as budget, sum(s) as spend from rec group by all),
cur as (select fms_id, max(reporting_period) as period, arg_max({{'a': agencies, 'b': budget, 's': spend}}, reporting_period) as m, min(reporting_period) as first_period, arg_min({{'b': budget}}, reporting_period) as f from per where reporting_period is not null group by 1),
names as (select fms_id, count(distinct fms_project_name) as names, count(distinct pid) filter (pid > 0) as pids from project_budget_schedule group by 1), sc as (select fms_id, count(distinct point_id) as sites from loc_cpdb_points where lon between -75 and -73 and lat between 40 and 42 group by 1),
split as (select fms_id, c / (c + n) as city_share from (select fms_id, reporting_period, sum({_fin('city')}) as c, sum({_fin('non_city')}) as n from budget_spend_by_fy where fms_id is not null group by all) where c + n > 0 qualify row_number() over (partition by fms_id order by reporting_period desc) = 1)"""


def export_records(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C05: one record a project, of its last report: money deduplicated by agency and its change, names, schedules, phases, sites, the
    split of its funding, theme and place. Every part is an aggregation by project, so the joins share its partitioning."""
    rec = projects(spark, sf).where("fms_id is not null").groupBy("fms_id", "managing_agency", "reporting_period").agg(F.max(finite(F.col("total_budget"))).alias("v"), F.max(finite(F.col("spend_to_date"))).alias("s"))
    per = rec.groupBy("fms_id", "reporting_period").agg(F.count(F.lit(1)).alias("agencies"), F.sum("v").alias("budget"), F.sum("s").alias("spend")).where("reporting_period is not null")
    cur = per.groupBy("fms_id").agg(F.max(F.struct("reporting_period", "agencies", "budget", "spend")).alias("m"), F.min(F.struct("reporting_period", "budget")).alias("f"))
    names = projects(spark, sf).where("fms_id is not null").groupBy("fms_id").agg(F.count_distinct("fms_project_name").alias("names"), F.count_distinct(F.when(F.col("pid") > 0, F.col("pid"))).alias("pids"))
    sites = town(spark, sf).groupBy("fms_id").agg(F.count_distinct("point_id").alias("sites"))
    money = table(spark, sf, "budget_spend_by_fy").where("fms_id is not null").groupBy("fms_id", "reporting_period").agg(F.sum(finite(F.col("city"))).alias("c"), F.sum(finite(F.col("non_city"))).alias("n")).where("c + n > 0")
    split = latest.latest(money, ["fms_id"], [F.col("reporting_period")], ["c", "n"]).select("fms_id", (F.col("c") / (F.col("c") + F.col("n"))).alias("city_share"))
    rank = latest.latest(snapshot_phases(spark, sf), ["fms_id"], [F.col("p")], ["rank"])
    schedule = city_schedules(spark, sf).select("fms_id", "expected_finish", "finish_kind", "late_days", "slip_days")
    place = placements(spark, sf).select("fms_id", "tier", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    out = described(spark, sf)
    for part in (cur, names, sites, split, rank, schedule, place):
        out = out.join(part, "fms_id", "left")
    return out.select(
        "fms_id", "title", "borough", "board", F.col("m.reporting_period").alias("period"), F.col("m.agencies").alias("agencies"), F.round("m.budget", 2).alias("budget"), F.round("m.spend", 2).alias("spend"),
        F.round(F.col("m.budget") - F.col("f.budget"), 2).alias("change"), F.col("f.reporting_period").alias("since"), areas.ratio(F.col("m.spend"), F.col("m.budget"), 1.0).alias("spent"), facets.band(F.col("m.budget"), _BANDS, "1B and more").alias("size"),
        (F.col("names") > 1).alias("renamed"), "pids", F.coalesce("sites", F.lit(0)).alias("sites"), F.round("city_share", 6).alias("city_share"), phase_name(F.col("rank")).alias("phase"), "expected_finish", "finish_kind", "late_days", "slip_days", "tier", "lon", "lat",
    )


@query(f"""with {_EXPORT}, {_SNAP}, ph as (select fms_id, arg_max(struct_pack(r := rank), p) as x from snap group by 1), {_SCHED}, {_TIERS.replace(_LATEST + ", ", "")}
select l.fms_id, l.title, l.borough, l.board, c.period, c.m.a as agencies, round(c.m.b, 2) as budget, round(c.m.s, 2) as spend, round(c.m.b - c.f.b, 2) as change, c.first_period as since, case when c.m.b <> 0 then c.m.s / c.m.b end as spent, {_BAND_SQL.format('c.m.b')} as size, n.names > 1 as renamed, n.pids, coalesce(sc.sites, 0) as sites, round(sp.city_share, 6) as city_share,
case ph.x.r when 1 then 'scoping' when 2 then 'design' when 3 then 'bidding' when 4 then 'construction' when 5 then 'closeout' when 6 then 'completed' else 'no_phase' end as phase, sd.expected_finish, sd.finish_kind, sd.late_days, sd.slip_days, coalesce(pl.m.tier, 'Unplaced') as tier, round(pl.m.lon, 6) as lon, round(pl.m.lat, 6) as lat
from latest l left join cur c using (fms_id) left join names n using (fms_id) left join sc using (fms_id) left join split sp using (fms_id) left join ph using (fms_id) left join sched sd using (fms_id) left join placed pl using (fms_id)""", days=("expected_finish",))
def c05_export_record(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C05: the project record."""
    return export_records(spark, sf)


@query(f"""with {IN_TOWN}, {EDGES}, h as (select point_id, min(boro_cd) as cd from (select point_id, boro_cd from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1) group by 1), k as (select fms_id, count(distinct cd) as districts, count(*) as points from town join h using (point_id) where fms_id is not null group by 1),
r as (select fms_id, arg_max({{'t': title, 'b': borough, 'f': forecast_completion}}, (as_of, row_id)) as m from nyc_capital_rows where status = 'current' and fms_id is not null group by 1)
select fms_id, array_to_string(list_filter(['id', case when m.t is not null then 'title' end, case when m.b is not null then 'borough' end, case when m.f is not null then 'forecast' end, case when k.fms_id is not null then 'counts' end], lambda x: x is not null), ',') as keys, k.districts, k.points from r left join k using (fms_id)""")
def h05_sparse_story(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H05: records of chosen statuses as JSON without their null fields, the points of a project nested by district; shown by the
    keys of each record and what its nested counts add up to."""
    held = spatial.inside(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf)).groupBy("point_id").agg(F.min("ref_id").alias("cd"))
    per = town(spark, sf).where("fms_id is not null").join(held, "point_id").groupBy("fms_id", "cd").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("fms_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cd").cast("string"), "n"))).alias("counts"))  # at most as many as districts
    rows = latest.latest(table(spark, sf, "nyc_capital_rows").where("status = 'current' and fms_id is not null"), ["fms_id"], [F.col("as_of"), F.col("row_id")], ["title", "borough", "forecast_completion"])
    story = F.to_json(F.struct(F.col("fms_id").alias("id"), "title", "borough", F.col("forecast_completion").alias("forecast"), "counts"))
    told = rows.join(counts, "fms_id", "left").select("fms_id", story.alias("story"))
    back = F.from_json(F.get_json_object("story", "$.counts"), "map<string, bigint>")
    return told.select("fms_id", F.array_join(F.json_object_keys("story"), ",").alias("keys"), F.when(back.isNotNull(), F.size(back)).cast("bigint").alias("districts"), F.aggregate(F.map_values(back), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("points"))


@query("""with p as (select pid, reporting_period, arg_max(trim(current_phase), (loaded_at, row_id)) as phase from schedule_history where pid > 0 and current_phase is not null and reporting_period is not null and loaded_at is not null group by all) select pid, string_agg(phase, ' > ' order by reporting_period) as phases, count(*) as n from p group by 1""")
def h06_nested_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H06: a schedule's phases nested in their order: one a report, the last delivered, so that as many are gathered as there are reports."""
    rows = table(spark, sf, "schedule_history").where("pid > 0 and current_phase is not null and reporting_period is not null and loaded_at is not null")
    per = latest.latest(rows.withColumn("phase", F.trim("current_phase")), ["pid", "reporting_period"], [F.col("loaded_at"), F.col("row_id")], ["phase"])
    x = per.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("reporting_period", "phase"))).alias("x"))
    return x.select("pid", F.array_join(F.transform("x", lambda r: r["phase"]), " > ").alias("phases"), F.size("x").cast("bigint").alias("n"))


@query(f"""select 'records' as program, fms_id as id, status, case when {_RANK_SQL.format('phase')} <= 3 then 'before' when {_RANK_SQL.format('phase')} = 4 then 'building' when {_RANK_SQL.format('phase')} >= 5 then 'done' else 'unknown' end as phase_group, round({_fin('budget')}, 2) as budget from nyc_capital_rows
union all select 'history', fms_id, 'reported', case when {_RANK_SQL.format('phase')} <= 3 then 'before' when {_RANK_SQL.format('phase')} = 4 then 'building' when {_RANK_SQL.format('phase')} >= 5 then 'done' else 'unknown' end, round(budget, 2) from project_history""")
def h07_program_exports(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H07, H34: programs brought to one form with mapped phases."""
    def adapt(df: DataFrame, program: str, status: Column) -> DataFrame:
        r = phase_rank("phase")
        group = F.when(r <= 3, "before").when(r == 4, "building").when(r >= 5, "done").otherwise("unknown")
        return df.select(F.lit(program).alias("program"), F.col("fms_id").alias("id"), status.alias("status"), group.alias("phase_group"), F.round(finite(F.col("budget")), 2).alias("budget"))

    return adapt(table(spark, sf, "nyc_capital_rows"), "records", F.col("status")).unionByName(adapt(table(spark, sf, "project_history"), "history", F.lit("reported")))


@query("""select row_id, try_cast(nullif(trim(forecast_completion), '') as date) as day, case fms_id when 'x' then 'y' else upper(trim(fms_id)) end as id, case when budget is null then null else cast(cast(budget as decimal(18, 2)) as double) end as amount from project_history where regexp_full_match(trim(forecast_completion), '\\d{4}-\\d{2}-\\d{2}') or forecast_completion is null""", days=("day",))
def h03_casts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H03: casts with empty as null, ids put right by a map, money of two decimals."""
    t = F.trim("forecast_completion")
    fixes = F.create_map(F.lit("x"), F.lit("y"))
    rows = table(spark, sf, "project_history").where(t.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("forecast_completion").isNull())
    return rows.select("row_id", F.nullif(t, F.lit("")).try_cast("date").alias("day"), F.coalesce(F.try_element_at(fixes, F.col("fms_id")), F.upper(F.trim("fms_id"))).alias("id"), F.col("budget").cast("decimal(18,2)").cast("double").alias("amount"))


@query("""select boro_cd, borough || ' ' || district as name, 'CD ' || right(cast(boro_cd as varchar), 2) as short from ref_community_districts where boro_cd % 100 <= 18""")
def h04_district_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ref_community_districts").where("boro_cd % 100 <= 18").select("boro_cd", F.concat_ws(" ", "borough", F.col("district").cast("string")).alias("name"), F.concat(F.lit("CD "), F.right(F.col("boro_cd").cast("string"), F.lit(2))).alias("short"))


@query(f"""with {LINES}, m as (select mega_project as line, position, (ax + bx) / 2 as lon, (ay + b_y) / 2 as lat from line where bx is not null) select line, position, 'middle' as kind, round(lon, 6) as lon, round(lat, 6) as lat from m
union all select mega_project, position, 'corner', round(ax, 6), round(ay, 6) from line""")
def h09_placed_along(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H09, G11: places along lines: the middle of every piece between two corners, and the corners themselves."""
    pieces = line_edges(spark, sf)
    path = F.array(F.array("ax", "ay"), F.array("bx", "by"))
    middle = pieces.select(F.col("ref_id").alias("line"), "position", geometry.along(path, 0.5).alias("p"))
    w = Window.partitionBy("mega_project").orderBy("station_no")  # a fixed table
    corners = table(spark, sf, "station_reach").select(F.col("mega_project").alias("line"), F.row_number().over(w).alias("position"), F.struct("lon", "lat").alias("p"))
    tag = lambda df, kind: df.select("line", F.col("position").cast("bigint").alias("position"), F.lit(kind).alias("kind"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))
    return tag(middle, "middle").unionByName(tag(corners, "corner"))


@query(f"""with {EDGES}, b as (select borough, boro_cd from ref_community_districts) select borough, count(*) as edges, round(min(least(ax, bx)), 6) as west, round(max(greatest(ay, by_)), 6) as north from edges join b using (boro_cd) group by 1""")
def h12_union_of_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H12: the edges of all polygons of a group as one shape, with its extent; g08 has the centroid."""
    names = table(spark, sf, "ref_community_districts").select(F.col("boro_cd").alias("ref_id"), "borough")
    every = district_edges(spark, sf).join(F.broadcast(names), "ref_id")  # a fixed table
    return every.groupBy("borough").agg(F.count(F.lit(1)).alias("edges"), F.round(F.min(F.least("ax", "bx")), 6).alias("west"), F.round(F.max(F.greatest("ay", "by")), 6).alias("north"))


@query(f"""with {IN_TOWN}, {EDGES}, h as (select point_id, min(boro_cd) as cd from (select point_id, boro_cd from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1) group by 1),
x as (select t.fms_id, d.borough, d.boro_cd, count(*) as n from town t join h using (point_id) join ref_community_districts d on d.boro_cd = h.cd where fms_id is not null group by all) select fms_id, boro_cd, borough, n / sum(n) over (partition by fms_id) as weight from x""")
def h17_district_weights(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H17, H19: the districts of a project's points with weights that add up to 1."""
    held = spatial.inside(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf)).groupBy("point_id").agg(F.min("ref_id").alias("boro_cd"))
    d = table(spark, sf, "ref_community_districts").select("boro_cd", "borough")
    n = town(spark, sf).where("fms_id is not null").join(held, "point_id").groupBy("fms_id", "boro_cd").agg(F.count(F.lit(1)).alias("n"))
    return areas.normalised(n, ["fms_id"], "n").join(F.broadcast(d), "boro_cd").select("fms_id", "boro_cd", "borough", F.col("share").alias("weight"))


@query("""with s as (select mega_project, station_no, station, lon as ax, lat as ay, lead(lon) over w as bx, lead(lat) over w as b_y, lead(station_no) over w as nxt from station_reach window w as (partition by mega_project order by station_no)),
m as (select mega_project as line, station_no as from_no, nxt as to_no, sqrt(pow((bx - ax) * cos(radians((ay + b_y) / 2)), 2) + pow(b_y - ay, 2)) * 6371000.0 * pi() / 180 as m from s where nxt is not null)
select line, from_no, to_no, round(m, 1) as length_m, round(sum(m) over (partition by line order by from_no rows unbounded preceding), 1) as upto_m from m""")
def h18_route_rows(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H18: the pieces of each route with their lengths and how far along the route they end. Lines are a fixed table."""
    w = Window.partitionBy("mega_project").orderBy("station_no")
    ends = F.array(F.array("lon", "lat"), F.array(F.lead("lon").over(w), F.lead("lat").over(w)))
    s = table(spark, sf, "station_reach").select(F.col("mega_project").alias("line"), F.col("station_no").alias("from_no"), F.lead("station_no").over(w).alias("to_no"), ends.alias("p")).where("to_no is not null")
    m = s.withColumn("m", geometry.length_m(F.col("p")))
    sofar = Window.partitionBy("line").orderBy("from_no").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("line", "from_no", "to_no", F.round("m", 1).alias("length_m"), F.round(F.sum("m").over(sofar), 1).alias("upto_m"))


@query("""with s as (select o_custkey, o_orderpriority, sum(o_totalprice) as v from orders group by all) select o_custkey, o_orderpriority, v / sum(v) over (partition by o_custkey) as share from s""")
def h19_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H19: a distribution as shares of each key's sum."""
    s = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    return areas.normalised(s, ["o_custkey"], "v").select("o_custkey", "o_orderpriority", "share")


@query(f"""with {_FIN}, d as (select fms_id, p, arg_max(pid, (f, pid)) as pid, max(f) as f from k group by all) select fms_id, p as period, pid, f as finish from d""", days=("finish",))
def h23_latest_dated_member(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H23: the schedule of a project that finishes last in a report."""
    m = linked_finishes(spark, sf).groupBy("fms_id", F.col("p").alias("period")).agg(F.max(F.struct("f", "pid")).alias("m"))
    return m.select("fms_id", "period", "m.pid", F.col("m.f").alias("finish"))


@query(f"""with {_UNITS} select fms_id, count(distinct unit || class) filter (class = 'local') as local, count(distinct unit || class) filter (class = 'regional') as regional, count(distinct unit || class) filter (class = 'citywide') as citywide from un where fms_id is not null group by 1""")
def h24_class_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H24: distinct units of each class, counted once, side by side."""
    u = serving_units(spark, sf).where("fms_id is not null").withColumn("u", F.coalesce("unit", F.when(F.lit(False), "")))
    one = lambda c: F.count_distinct(F.when(F.col("class") == c, F.col("u"))).alias(c)
    return u.groupBy("fms_id").agg(one("local"), one("regional"), one("citywide"))


@query(f"""with {IN_TOWN}, {EDGES}, h as (select distinct point_id from (select point_id, boro_cd from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1)) select fms_id, count(*) as points, round(1.0 - 1.0 * count(h.point_id) / count(*), 6) as outside_share from town left join h using (point_id) where fms_id is not null group by 1""")
def h25_share_outside(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H25: the share of a project's points outside every region."""
    held = spatial.inside(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf)).select("point_id").distinct().withColumn("held", F.lit(1))
    return town(spark, sf).where("fms_id is not null").join(held, "point_id", "left").groupBy("fms_id").agg(F.count(F.lit(1)).alias("points"), F.round(1.0 - F.count("held") / F.count(F.lit(1)), 6).alias("outside_share"))


@query("""with l as (select fms_id, arg_max(feed, (as_of, row_id)) as feed, array_to_string(list_sort(list(distinct tier) filter (tier is not null)), ' ') as tiers from nyc_capital_rows where fms_id is not null group by 1) select fms_id, feed, coalesce(tiers, '') as tiers from l""")
def h26_latest_list_wins(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H26: the latest list that holds a code wins; attributes over all lists as a set."""
    order = [F.col("as_of"), F.col("row_id")]
    return table(spark, sf, "nyc_capital_rows").where("fms_id is not null").groupBy("fms_id").agg(latest.last_value(F.col("feed"), order).alias("feed"), F.array_join(F.array_sort(F.collect_set("tier")), " ").alias("tiers"))


@query("""with shapes as (select boro_cd, cast(json_extract(geojson, '$.coordinates') as double[][][][]) as c from ref_community_districts), p as (select boro_cd, unnest(c) as polygon, unnest(range(1, len(c) + 1)) as part from shapes) select boro_cd, part, len(polygon) as rings, len(polygon[1]) as corners from p""")
def h29_footprint_parts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H29: one site for each part of a footprint."""
    d = table(spark, sf, "ref_community_districts").select("boro_cd", F.posexplode(geometry.multipolygon(F.col("geojson"))).alias("i", "polygon"))
    return d.select("boro_cd", (F.col("i") + 1).cast("bigint").alias("part"), F.size("polygon").cast("bigint").alias("rings"), F.size(F.col("polygon")[0]).cast("bigint").alias("corners"))


@query("""with d as (select fms_id, min(row_id) as row_id from nyc_capital_rows where title is null or lower(trim(title)) in ('', '-', '--', 'n/a', 'null', 'tbd', 'none', 'unknown') group by 1) select fms_id, row_id from d where fms_id is not null and not exists (select 1 from project_schedules s where list_contains(list_transform(s.fms_ids, lambda x: upper(trim(x))), upper(trim(d.fms_id))))""")
def h30_screening(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H30: rows that need review, but for those that a reviewed table holds."""
    name = F.lower(F.trim("title"))
    need = table(spark, sf, "nyc_capital_rows").where(F.col("title").isNull() | name.isin("", "-", "--", "n/a", "null", "tbd", "none", "unknown")).where("fms_id is not null").groupBy("fms_id").agg(F.min("row_id").alias("row_id"))
    held = table(spark, sf, "project_schedules").select(F.explode("fms_ids").alias("x")).select(F.upper(F.trim("x")).alias("k")).where("k is not null").distinct()
    return need.withColumn("k", F.upper(F.trim("fms_id"))).join(held, "k", "left_anti").select("fms_id", "row_id")


@query("""select feed, count(*) as n, 100.0 * count(*) filter (spend <= budget) / count(*) as within_pct from nyc_capital_rows where isfinite(spend) and isfinite(budget) group by 1""")
def h31_precision_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nyc_capital_rows").where(finite(F.col("spend")).isNotNull() & finite(F.col("budget")).isNotNull())
    return rows.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), areas.ratio(F.count_if(F.col("spend") <= F.col("budget")), F.count(F.lit(1))).alias("within_pct"))


@query("""select row_id, make_date(year(loaded_at), (quarter(loaded_at) - 1) * 3 + 1, 1) as began from project_budget_schedule where loaded_at is not null""", days=("began",))
def h32_quarter_texts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H32: quarters written as text, read as their first days."""
    q = F.concat(F.year("loaded_at"), F.lit("-Q"), F.quarter("loaded_at"))
    return table(spark, sf, "project_budget_schedule").where("loaded_at is not null").select("row_id", periods.quarter_start(q).alias("began"))


@query("""select row_id from nyc_capital_rows where borough in ('Queens') and tier in ('A', 'B')""")
def h33_selection_edits(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H33: choices after a few taps, applied as a filter."""
    state = facets.toggled(facets.toggled(facets.toggled({"borough": ["Bronx"]}, "borough", "Queens"), "borough", "Bronx"), "tier", "A")
    state = facets.toggled(state, "tier", "B")
    return table(spark, sf, "nyc_capital_rows").where(facets.matches({k: F.array(F.col(k)) for k in ("borough", "tier")}, state)).select("row_id")


@query("""select r.row_id as id, lower(coalesce(r.fms_id, '') || ' ' || coalesce(r.title, '') || ' ' || coalesce(array_to_string(list_filter(r.managing_agencies, lambda x: x is not null), ' '), '')) as document from nyc_capital_rows r""")
def h34_search_document(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H34: the text under which a record is searched."""
    none = F.lit("")
    words = F.concat_ws(" ", F.coalesce("fms_id", none), F.coalesce("title", none), F.coalesce(F.array_join("managing_agencies", " "), none))
    return table(spark, sf, "nyc_capital_rows").select(F.col("row_id").alias("id"), F.lower(words).alias("document"))


@query(f"""with m as (select fms_id, arg_min(budget, (period, row_id)) filter (budget is not null) as a, arg_max(budget, (period, row_id)) filter (budget is not null) as z from project_history where fms_id like 'B%' group by 1) select left(fms_id, 3) as cohort, count(*) as n, round(sum(a), 2) as original, round(sum(z), 2) as current, count(*) filter (z > a) as grown from m where a is not null group by 1""")
def h35_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H35: cohorts by the start of their ids: original against current money."""
    order = [F.col("period"), F.col("row_id")]
    m = table(spark, sf, "project_history").where(F.startswith("fms_id", F.lit("B"))).groupBy("fms_id").agg(latest.first_value(F.col("budget"), order).alias("a"), latest.last_value(F.col("budget"), order).alias("z")).where("a is not null")
    return m.groupBy(F.left("fms_id", F.lit(3)).alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 2).alias("original"), F.round(F.sum("z"), 2).alias("current"), F.count_if(F.col("z") > F.col("a")).alias("grown"))


@query(f"""select year(as_of) || 'Q' || quarter(as_of) as quarter, round(sum({_fin('budget')}), 2) as total, count(*) as n from nyc_capital_rows where as_of is not null group by 1""")
def h37_quarter_sums(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H37: a measure summed by quarter, with the quarter's label."""
    rows = table(spark, sf, "nyc_capital_rows").where("as_of is not null")
    return rows.groupBy(F.concat(F.year("as_of"), F.lit("Q"), F.quarter("as_of")).alias("quarter")).agg(F.round(F.sum(finite(F.col("budget"))), 2).alias("total"), F.count(F.lit(1)).alias("n"))


QUERIES, SQL = BOOK.queries, BOOK.sql
