"""Change over time: windows, as-of joins, carry-forward, runs, schedules and dates (OP-W, OP-J09..J11, J21, OP-D, OP-M04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import periods
from plinth.functions.values import day_of_text, finite, squeezed
from plinth.operators import asof, change, latest
from plinth.plans.book import Book
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query


def project_months(spark: SparkSession, sf: str) -> DataFrame:
    """(fms_id, period, budget): one budget per reported period."""
    rows = table(spark, sf, "project_history").where("fms_id is not null and period is not null")
    return rows.groupBy("fms_id", "period").agg(F.max("budget").alias("budget"))


MONTHS = "months as (select fms_id, period, max(budget) as budget from project_history where fms_id is not null and period is not null group by all)"


@query(f"with {MONTHS} select fms_id, period, budget, round(budget - lag(budget) over (partition by fms_id order by period), 2) as change from months")
def w02_lag_change(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W02, W08: change against the period reported before."""
    return change.signed_change(project_months(spark, sf), ["fms_id"], ["period"], "budget")


@query(f"with {MONTHS} select fms_id, period, case when lag(period) over w is not null then budget is distinct from lag(budget) over w end as changed from months window w as (partition by fms_id order by period)")
def w03_changed_flag(spark: SparkSession, sf: str) -> DataFrame:
    return change.changed_flag(project_months(spark, sf), ["fms_id"], ["period"], "budget").select("fms_id", "period", "changed")


@query(r"""with l as (select fms_id, period, nullif(lower(regexp_replace(phase, '\s+', '', 'g')), '') as p from project_history where fms_id is not null qualify row_number() over (partition by fms_id, period order by loaded_at desc, row_id desc) = 1)
select fms_id, period, last_value(p ignore nulls) over (partition by fms_id order by period rows between unbounded preceding and current row) as phase from l""")
def w06_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W06: over one row per period, so that a hot project has as many rows as there are periods."""
    rows = latest.latest(table(spark, sf, "project_history").where("fms_id is not null"), ["fms_id", "period"], [F.col("loaded_at"), F.col("row_id")], ["phase"])
    rows = rows.withColumn("phase", F.nullif(squeezed(F.col("phase")), F.lit("")))
    return change.forward_fill(rows, ["fms_id"], ["period"], "phase").select("fms_id", "period", "phase")


@query("""with o as (select fms_id, min(total_budget) as original from project_budget_schedule where isfinite(total_budget) and reporting_period = 202305 group by 1), m as (select fms_id, period, max(budget) as budget from project_history where fms_id is not null group by all)
select m.fms_id, period, budget, round(budget - coalesce(lag(budget) over w, original), 2) as change, row_number() over w as i from m left join o using (fms_id) window w as (partition by m.fms_id order by period)""")
def w07_signed_change(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W07: change against the row before, the first one against the original budget."""
    original = table(spark, sf, "project_budget_schedule").where("reporting_period = 202305").groupBy("fms_id").agg(F.min(finite(F.col("total_budget"))).alias("original"))
    rows = project_months(spark, sf).join(original, "fms_id", "left")
    rows = change.signed_change(rows, ["fms_id"], ["period"], "budget", seed=F.col("original"))
    return rows.select("fms_id", "period", "budget", "change", F.row_number().over(change.along(["fms_id"], ["period"])).cast("bigint").alias("i"))


@query(f"""with {MONTHS}, d as (select left(fms_id, 2) as plan, period, budget - coalesce(lag(budget) over (partition by fms_id order by period), 0) as d from months), s as (select plan, period, sum(d) as change from d group by all)
select plan, period, round(change, 2) as change, round(sum(change) over (partition by plan order by period), 2) as total from s""")
def w10_running_plan_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = project_months(spark, sf).withColumn("plan", F.left("fms_id", F.lit(2)))
    out = change.running_total(rows, ["fms_id"], ["plan"], "period", "budget")
    return out.select("plan", "period", F.round("change", 2).alias("change"), F.round("total", 2).alias("total"))


@query("""select fms_id, arg_min(spend, (period, row_id)) filter (spend <> 0) as first_held, arg_max(spend, (period, row_id)) filter (spend <> 0) as last_held from project_history where fms_id is not null group by 1""")
def w12_first_latest_held(spark: SparkSession, sf: str) -> DataFrame:
    held, order = F.when((F.col("spend") != 0) & ~F.isnan("spend"), F.col("spend")), [F.col("period"), F.col("row_id")]
    rows = table(spark, sf, "project_history").where("fms_id is not null")
    return rows.groupBy("fms_id").agg(latest.first_value(held, order).alias("first_held"), latest.last_value(held, order).alias("last_held"))


@query(f"""with {MONTHS}, f as (select fms_id, max(period) filter (not coalesce(budget > 5000000, false)) as last_fail from months group by 1)
select m.fms_id, min(period) filter (last_fail is null or period > last_fail) as run_start from months m join f using (fms_id) group by 1""")
def w13_final_run_start(spark: SparkSession, sf: str) -> DataFrame:
    return change.final_run_start(project_months(spark, sf), ["fms_id"], "period", F.col("budget") > 5_000_000)


@query("""with s as (select pid, reporting_period as p, max(coalesce(completion_date_type = 'Actual', false)) as done from schedule_history where pid is not null and reporting_period is not null group by all),
f as (select pid, arg_max(done, p) as d, max(p) as l, min(p) filter (done) as first_done, max(p) filter (not done) as last_open from s group by 1)
select pid, case when d then 'finished' when l < 202605 then 'left_unfinished' else 'still_listed' end as outcome, case when d and not coalesce(first_done < last_open, false) then first_done end as finished_at, coalesce(first_done < last_open, false) as reopened from f""")
def w14_finish_outcome(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "schedule_history").where("pid is not null and reporting_period is not null").groupBy("pid", "reporting_period").agg(F.max(F.coalesce(F.col("completion_date_type") == "Actual", F.lit(False))).alias("done"))
    return change.outcome(rows, ["pid"], "reporting_period", F.col("done"), F.lit(202605))


SLIP = "fin as (select fms_id, pid, reporting_period as p, max(cast(forecast_completion as date)) as f from project_budget_schedule where pid > 0 and forecast_completion is not null group by all)"


@query(f"""with {SLIP}, pr as (select p, lag(p) over (order by p) as before from (select distinct p from fin))
select n.fms_id, n.p as period, datediff('day', max(o.f), max(n.f)) as slip_days, count(*) as n_pids from fin n join pr on pr.p = n.p join fin o on o.fms_id = n.fms_id and o.pid = n.pid and o.p = pr.before group by all""")
def w15_common_set_slip(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W15: the latest finish against the report before, over the schedules in both reports only."""
    fin = table(spark, sf, "project_budget_schedule").where("pid > 0 and forecast_completion is not null").groupBy("fms_id", "pid", F.col("reporting_period").alias("p")).agg(F.max(F.to_date("forecast_completion")).alias("f"))
    reports = fin.select("p").distinct()
    before = reports.select("p", F.lag("p").over(Window.orderBy("p")).alias("before"))  # as many rows as reports
    w = change.along(["fms_id", "pid"], ["p"])
    both = fin.withColumns({"of": F.lag("f").over(w), "op": F.lag("p").over(w)}).join(F.broadcast(before), "p").where("op = before")
    return both.groupBy("fms_id", F.col("p").alias("period")).agg(F.datediff(F.max("f"), F.max("of")).cast("bigint").alias("slip_days"), F.count(F.lit(1)).alias("n_pids"))


@query("""with c as (select pid, reporting_period as period, cast(completion_date as date) as finish, 1 as rank, 'schedule' as source from schedule_history where pid > 0 and completion_date is not null and reporting_period is not null
union all select pid, reporting_period, cast(forecast_completion as date), 2, 'budget' from project_budget_schedule where pid > 0 and forecast_completion is not null)
select pid, period, finish, source from (select * from c qualify row_number() over (partition by pid, period order by rank, finish desc) = 1)""", days=("finish",))
def w16_best_finish(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W16: the most trusted source, then the latest date."""
    a = table(spark, sf, "schedule_history").where("pid > 0 and reporting_period is not null").select("pid", F.col("reporting_period").alias("period"), F.to_date("completion_date").alias("finish"), F.lit(1).alias("rank"), F.lit("schedule").alias("source"))
    b = table(spark, sf, "project_budget_schedule").where("pid > 0").select("pid", F.col("reporting_period").alias("period"), F.to_date("forecast_completion").alias("finish"), F.lit(2).alias("rank"), F.lit("budget").alias("source"))
    best = a.unionByName(b).where("finish is not null").groupBy("pid", "period").agg(F.max(F.struct(-F.col("rank"), F.col("finish"), F.col("source"))).alias("m"))
    return best.select("pid", "period", "m.finish", "m.source")


@query("""select fms_id, max(cast(forecast_completion as date)) as finish from project_budget_schedule p where reporting_period = 202605 and not exists (
select 1 from project_budget_schedule o where o.fms_id = p.fms_id and o.reporting_period = 202605 and o.forecast_completion is null) group by 1""", days=("finish",))
def w17_finish_unless_open(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W17: a project with any open undated part has no finish."""
    now = table(spark, sf, "project_budget_schedule").where("reporting_period = 202605")
    return now.groupBy("fms_id").agg(latest.max_if_all(F.to_date("forecast_completion")).alias("finish")).where("finish is not null")


_STAGES = {"design": ("actual_design_start", "actual_design_end"), "procurement": ("actual_construction_procurement_start", "actual_construction_procurement_end"), "construction": ("actual_construction_start", "actual_construction_end")}


@query("select * from (" + " union all ".join(f"select row_id, '{k}' as stage, {a} as began, {b} as ended from project_budget_schedule" for k, (a, b) in _STAGES.items()) + ") where began is not null or ended is not null")
def w21_milestones(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W21: milestone columns as rows, in one pass."""
    cells = F.array(*(F.struct(F.lit(k).alias("stage"), F.col(a).alias("began"), F.col(b).alias("ended")) for k, (a, b) in _STAGES.items()))
    return table(spark, sf, "project_budget_schedule").select("row_id", F.explode(cells).alias("c")).select("row_id", "c.*").where("began is not null or ended is not null")


@query("""with t as (select borough, count(*) as n, sum(case when isfinite(budget) then budget end) as money from nyc_capital_rows group by 1), r as (select *, row_number() over (order by n desc, borough nulls last) as by_n, row_number() over (order by money desc nulls last, borough nulls last) as by_money from t)
select borough, n, round(money, 2) as money, by_n, by_money from r where by_n <= 3 or by_money <= 3""")
def w23_two_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """OP-W23: a report of the top three by either measure; ranks are of groups, which are few."""
    t = table(spark, sf, "nyc_capital_rows").groupBy("borough").agg(F.count(F.lit(1)).alias("n"), F.sum(finite(F.col("budget"))).alias("money"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc_nulls_last(), F.col("borough").asc_nulls_last())).cast("bigint")
    return t.withColumns({"by_n": rank("n"), "by_money": rank("money")}).where("by_n <= 3 or by_money <= 3").withColumn("money", F.round("money", 2))


INDEX = "idx as (select cast(date_trunc('day', ts) as date) as day, round(avg(value), 6) as level from events group by 1)"


@query(f"""with {INDEX}, o as (select o_orderkey, cast(o_orderdate as date) as d, date '2024-01-01' + cast(o_orderkey % 45 as integer) as day from orders)
select o_orderkey, o.day, idx.level from o asof left join idx on o.day >= idx.day""", days=("day",))
def j09_asof_index(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J09: the latest index level at or before a day. The level is looked up once for each distinct day, then joined by day, so rows
    of a day are neither sorted nor gathered."""
    left = table(spark, sf, "orders").select("o_orderkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 45).cast("int")).alias("day"))
    index = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("level"))
    return asof.as_of_by_time(left, index, "day", ["level"]).select("o_orderkey", "day", "level")


@query("""with s as (select pid, reporting_period as period, max(cast(completion_date as date)) as finish from schedule_history where pid > 0 and completion_date is not null and reporting_period is not null group by all), p as (select distinct pid, reporting_period as period from project_budget_schedule where pid > 0),
a as (select p.pid, p.period, s.finish, s.period as found from p asof left join s on p.pid = s.pid and p.period >= s.period), f as (select pid, min(period) as first_period, arg_min(finish, period) as first_finish from s group by 1)
select a.pid, a.period, coalesce(a.finish, f.first_finish) as finish, case when a.finish is not null then 'at or before' when f.first_finish is not null then 'first' end as basis from a left join f using (pid)""", days=("finish",))
def j10_asof_or_first(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J10: the latest snapshot at or before a period, else the first one."""
    s = table(spark, sf, "schedule_history").where("pid > 0 and completion_date is not null and reporting_period is not null").groupBy("pid", F.col("reporting_period").alias("period")).agg(F.max(F.to_date("completion_date")).alias("finish"))
    p = table(spark, sf, "project_budget_schedule").where("pid > 0").select("pid", F.col("reporting_period").alias("period")).distinct()
    found = asof.as_of(p, s, ["pid"], "period", ["finish"])
    first = s.groupBy("pid").agg(F.min(F.struct("period", "finish")).alias("m")).select("pid", F.col("m.finish").alias("first_finish"))
    basis = F.when(F.col("finish").isNotNull(), "at or before").when(F.col("first_finish").isNotNull(), "first")
    return found.join(first, "pid", "left").select("pid", "period", F.coalesce("finish", "first_finish").alias("finish"), basis.alias("basis"))


@query("""with e as (select distinct pid, reporting_period as edition from schedule_history where pid > 0 and reporting_period is not null), p as (select distinct pid, reporting_period as period from project_budget_schedule where pid > 0)
select p.pid, p.period, min(edition) as next_edition from p left join e on e.pid = p.pid and e.edition >= p.period group by all""")
def j11_next_edition(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "schedule_history").where("pid > 0").select("pid", F.col("reporting_period").alias("period"), F.col("reporting_period").alias("next_edition")).distinct()
    p = table(spark, sf, "project_budget_schedule").where("pid > 0").select("pid", F.col("reporting_period").alias("period")).distinct()
    return asof.as_of(p, e, ["pid"], "period", ["next_edition"], forward=True).select("pid", "period", "next_edition")


@query(f"""with {MONTHS}, loads as (select distinct period from months), members as (select distinct fms_id from months)
select g.fms_id, g.period, m.budget, m.period < g.period as carried from (select * from members cross join loads) g asof join (select * from months where budget is not null) m on g.fms_id = m.fms_id and g.period >= m.period""")
def j21_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J21, W11: every project's last budget at every report."""
    months = project_months(spark, sf)
    return asof.carried(months, months, months, ["fms_id"], "period", "budget")


@query(r"""with t as (select row_id, regexp_extract(forecast_completion, '^\d{4}-\d{2}-\d{2}$') as d from project_history), x as (select row_id, case when d = '' or d is null then null when row_id % 3 = 0 then left(d, 4) when row_id % 3 = 1 then left(d, 7) else d end as t from t)
select row_id, case length(t) when 4 then cast(t || '-12-31' as date) when 7 then last_day(cast(t || '-01' as date)) when 10 then cast(t as date) end as day, case length(t) when 4 then 'year' when 7 then 'month' when 10 then 'day' end as precision from x""", days=("day",))
def d02_partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    """OP-D02: dates of three precisions."""
    d = F.nullif(F.regexp_extract("forecast_completion", r"^\d{4}-\d{2}-\d{2}$", 0), F.lit(""))
    t = F.when(F.col("row_id") % 3 == 0, F.left(d, F.lit(4))).when(F.col("row_id") % 3 == 1, F.left(d, F.lit(7))).otherwise(d)
    p = periods.partial_date(t)
    return table(spark, sf, "project_history").select("row_id", p["date"].alias("day"), p["precision"].alias("precision"))


@query("""select row_id, make_date(reporting_period // 100, reporting_period % 100, 1) as month_start, last_day(make_date(reporting_period // 100, reporting_period % 100, 1)) as month_end, datediff('month', make_date(reporting_period // 100, reporting_period % 100, 1), cast(forecast_completion as date)) as months_left from project_budget_schedule""", days=("month_start", "month_end"))
def d01_period_months(spark: SparkSession, sf: str) -> DataFrame:
    """OP-D01, D09: periods as months and month boundaries crossed."""
    start = periods.month_start(F.col("reporting_period"))
    return table(spark, sf, "project_budget_schedule").select("row_id", start.alias("month_start"), periods.month_end(F.col("reporting_period")).alias("month_end"), periods.months_between_starts(start, F.to_date("forecast_completion")).cast("bigint").alias("months_left"))


@query(r"""with x as (select row_id, trim(forecast_completion) as t from project_history)
select row_id, cast(coalesce(try_strptime(regexp_replace(t, '[T ]\d{1,2}:\d{2}.*$', ''), '%Y-%m-%d'), try_strptime(t, '%Y%m%d'), try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%d-%b-%Y'), try_strptime(t, '%b %d, %Y')) as date) as day from x""", days=("day",))
def d06_mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """OP-D06, D07: dates in several text formats."""
    return table(spark, sf, "project_history").select("row_id", day_of_text(F.col("forecast_completion")).alias("day"))


@query("""select row_id, least(actual_design_start, actual_construction_procurement_start, actual_construction_start, forecast_completion) as earliest, greatest(actual_design_end, actual_construction_end) as latest from project_budget_schedule""")
def d08_least_of_dates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").select("row_id", F.least("actual_design_start", "actual_construction_procurement_start", "actual_construction_start", "forecast_completion").alias("earliest"), F.greatest("actual_design_end", "actual_construction_end").alias("latest"))


@query(f"""with {MONTHS}, i as (select reporting_period as period, avg(case when isfinite(spend) and spend between 0 and 5e9 then spend end) as level from budget_spend_by_fy where reporting_period is not null group by 1),
s as (select fms_id, min(period) as p0, max(period) as p1, arg_min(budget, period) as b0, arg_max(budget, period) as b1 from months group by 1)
select fms_id, round((b1 - b0 * (i1.level / i0.level)) / 1000, 0) as real_change_k from s join i i0 on i0.period = p0 join i i1 on i1.period = p1""")
def m04_constant_money_change(spark: SparkSession, sf: str) -> DataFrame:
    """OP-M04: the change of a budget against its first one at the price level of the last period; the index is one row per period."""
    s = finite(F.col("spend"))
    index = table(spark, sf, "budget_spend_by_fy").where("reporting_period is not null").groupBy(F.col("reporting_period").alias("period")).agg(F.avg(F.when(s.between(0, 5e9), s)).alias("level"))
    ends = project_months(spark, sf).groupBy("fms_id").agg(F.min(F.struct("period", "budget")).alias("a"), F.max(F.struct("period", "budget")).alias("z"))
    level = lambda n: F.broadcast(index.select(F.col("period").alias(f"p{n}"), F.col("level").alias(f"l{n}")))
    both = ends.join(level(0), F.col("a.period") == F.col("p0")).join(level(1), F.col("z.period") == F.col("p1"))
    return both.select("fms_id", F.round((F.col("z.budget") - F.col("a.budget") * (F.col("l1") / F.col("l0"))) / 1000, 0).alias("real_change_k"))


@query("""with a as (select fms_id, period, budget, 'history' as source from project_history where fms_id is not null), f as (select fms_id, min(period) as began from a group by 1)
select fms_id, period, max(budget) as budget, 'history' as source from a group by 1, 2 union all
select p.fms_id, p.reporting_period, max(case when isfinite(total_budget) then total_budget end), 'schedule' from project_budget_schedule p left join f using (fms_id) where f.began is null or p.reporting_period < f.began group by 1, 2""")
def c21_spliced_series(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C21: an older source up to where the newer one begins."""
    new = project_months(spark, sf).withColumn("source", F.lit("history"))
    began = new.groupBy("fms_id").agg(F.min("period").alias("began"))
    old = table(spark, sf, "project_budget_schedule").groupBy("fms_id", F.col("reporting_period").alias("period")).agg(F.max(finite(F.col("total_budget"))).alias("budget"))
    old = old.join(began, "fms_id", "left").where("began is null or period < began").select("fms_id", "period", "budget", F.lit("schedule").alias("source"))
    return new.unionByName(old)


@query("""select fms_id, max(case when period = 202305 then budget end) as b_202305, max(case when period = 202605 then budget end) as b_202605, coalesce(max(case when period = 202605 then budget end), 0) - coalesce(max(case when period = 202305 then budget end), 0) as moved from project_history where fms_id is not null group by 1""")
def c14_pivoted_levels(spark: SparkSession, sf: str) -> DataFrame:
    """OP-C14: levels at aligned snapshots, side by side; missing counts as zero in the difference."""
    wide = table(spark, sf, "project_history").where("fms_id is not null").groupBy("fms_id").pivot("period", [202305, 202605]).agg(F.max("budget"))
    return wide.select("fms_id", F.col("202305").alias("b_202305"), F.col("202605").alias("b_202605"), (F.coalesce("202605", F.lit(0.0)) - F.coalesce("202305", F.lit(0.0))).alias("moved"))


QUERIES, SQL = BOOK.queries, BOOK.sql
