"""DuckDB SQL with the results of the queries of plinth.plans.training."""

from __future__ import annotations

from plinth.functions.values import MISSING

_MISSING = ", ".join(f"'{x}'" for x in MISSING)
_BLANK = r"[\s\p{Z}\x{FEFF}\x{200B}]"

_ITEM = r"""(?:"(?:[^"\\]|""|\\.)*"|“[^”]*”|[^{0}"“])+"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = "case when length(i) > 1 and left(i, 1) = '\"' and right(i, 1) = '\"' then replace(replace(i[2:-2], '\\\"', '\"'), '\"\"', '\"') when length(i) > 1 and left(i, 1) = '“' and right(i, 1) = '”' then i[2:-2] else i end"

P1 = rf"""
with src as (select 'mta_lines' as table_name, line_id as row_key, {_TRIM.format("labels")} as t from mta_lines where labels is not null
  union all select 'project_budget_schedule', cast(row_id as varchar), regexp_replace({_TRIM.format("community_board")}, '\sand\s', ';', 'g') from project_budget_schedule where community_board is not null),
bare as (select table_name, row_key, regexp_replace(t, '^[\[{{](.*)[\]}}]$', '\1', 's') as t from src),
raw as (select table_name, row_key, case table_name when 'mta_lines' then regexp_extract_all(t, '{_ITEM.format(";,|" + chr(92) + "t" + chr(92) + "n" + chr(92) + "r")}') else regexp_extract_all(t, '{_ITEM.format(";,|&+/" + chr(92) + "t" + chr(92) + "n" + chr(92) + "r")}') end as x from bare),
items as (select table_name, row_key, list_filter(list_transform(list_transform(x, lambda i: {_TRIM.format("i")}), lambda i: {_CLEAN}), lambda i: trim(i) <> '') as x from raw)
select table_name, row_key, cast(pos as integer) as pos, x[pos] as item from (select table_name, row_key, x, unnest(range(1, len(x) + 1)) as pos from items where len(x) > 1)
"""

P2 = rf"""
with periods as (select p, lead(p) over (order by p) as q, row_number() over (order by p) as i from (select distinct reporting_period as p from project_budget_schedule where reporting_period is not null)),
last as (
  select fms_id, coalesce(pid, -1) as pid, reporting_period as p,
    case when abs(total_budget) < 9e15 then cast(cast(round(total_budget * 100) as bigint) as varchar) else cast(total_budget as varchar) end as b,
    lower(regexp_replace(current_phase, '{_BLANK}+', '', 'g')) as ph, cast(forecast_completion as date) as f
  from project_budget_schedule
  qualify row_number() over (partition by fms_id, coalesce(pid, -1), reporting_period order by loaded_at desc, row_id desc) = 1
),
pairs as (
  select n.fms_id, n.pid, n.p, 'added' as change_kind from last n join periods on periods.q = n.p
    where not exists (select 1 from last o where o.fms_id = n.fms_id and o.pid = n.pid and o.p = periods.p)
  union all
  select o.fms_id, o.pid, periods.q, 'removed' from last o join periods on periods.p = o.p
    where periods.q is not null and not exists (select 1 from last n where n.fms_id = o.fms_id and n.pid = o.pid and n.p = periods.q)
  union all
  select n.fms_id, n.pid, n.p, 'changed' from last n join periods on periods.q = n.p join last o on o.fms_id = n.fms_id and o.pid = n.pid and o.p = periods.p
    where n.b is distinct from o.b or n.ph is distinct from o.ph or n.f is distinct from o.f
)
select fms_id, pid, p as reporting_period, change_kind from pairs
"""

P4 = """
with shapes as (select boro_cd, unnest(cast(json_extract(geojson, '$.coordinates') as double[][][][])) as polygon from ref_community_districts),
rings as (select boro_cd, unnest(polygon) as ring from shapes),
sides as (select boro_cd, ring[i] as a, ring[case when i = len(ring) then 1 else i + 1 end] as b from (select boro_cd, ring, unnest(range(1, len(ring) + 1)) as i from rings)),
edges as (select boro_cd, a[1] as ax, a[2] as ay, b[1] as bx, b[2] as by_ from sides where a[2] <> b[2]),
pts as (select distinct point_id, lon, lat from loc_cpdb_points where isfinite(lon) and isfinite(lat))
select distinct 'district' as kind, cast(boro_cd as bigint) as ref_id, point_id from (
  select boro_cd, point_id, lon, lat from pts join edges
    on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay)
  group by all having count(*) % 2 = 1)
union all
select distinct 'reach', cast(s.station_no as bigint), p.point_id from pts p join station_reach s
  on 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.lon) / 2), 2)))) <= s.radius_m
"""



P4_EDGES = """
with shapes as (select boro_cd, unnest(cast(json_extract(geojson, '$.coordinates') as double[][][][])) as polygon from ref_community_districts),
rings as (select boro_cd, unnest(polygon) as ring from shapes),
sides as (select boro_cd, ring[i] as a, ring[case when i = len(ring) then 1 else i + 1 end] as b from (select boro_cd, ring, unnest(range(1, len(ring) + 1)) as i from rings)),
edges as (select boro_cd, a[1] as ax, a[2] as ay, b[1] as bx, b[2] as by_ from sides),
pts as (select lon, lat from loc_cpdb_points where isfinite(lon) and isfinite(lat) union select ax, ay from edges),
met as (select boro_cd, lon, lat, (ay > lat) <> (by_ > lat) as straddles, case when (ay > lat) <> (by_ > lat) then ax + (lat - ay) * (bx - ax) / (by_ - ay) end as cx, ay = lat and by_ = lat and lon between least(ax, bx) and greatest(ax, bx) as level, ax = lon and ay = lat as corner
  from pts join edges on lat between least(ay, by_) and greatest(ay, by_))
select boro_cd, lon, lat, count(*) filter (straddles and lon < cx) % 2 = 1 as held from met group by all having bool_or(level or corner or coalesce(lon = cx, false))
"""


def _text(c: str) -> str:
    bare = f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    return f"case when lower({bare}) not in ({_MISSING}) then {bare} end"


P5 = rf"""
with last as (
  select fms_id, period, case when abs(budget) < 9e15 then cast(cast(round(budget * 100) as bigint) as varchar) else cast(budget as varchar) end as b,
    lower(regexp_replace({_text("phase")}, '{_BLANK}+', '', 'g')) as ph,
    regexp_replace({_text("forecast_completion")}, '[T ]\d{{1,2}}:\d{{2}}.*$', '') as t
  from project_history where fms_id is not null and period is not null
  qualify row_number() over (partition by fms_id, period order by loaded_at desc, row_id desc) = 1
),
dated as (select *, cast(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y%m%d'), try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%d-%b-%Y'), try_strptime(t, '%b %d, %Y')) as date) as f from last),
filled as (select fms_id, period, b, last_value(ph ignore nulls) over w as ph, last_value(f ignore nulls) over w as f from dated window w as (partition by fms_id order by period rows between unbounded preceding and current row)),
starts as (
  select fms_id, period from filled
  window w as (partition by fms_id order by period)
  qualify row_number() over w = 1 or b is distinct from lag(b) over w or ph is distinct from lag(ph) over w or f is distinct from lag(f) over w
)
select fms_id, period as valid_from, coalesce(lead(period) over (partition by fms_id order by period), 999999) as valid_to from starts
"""

P7 = r"""
with cells as (
  select 'project_budget_schedule' as table_name, 'community_board' as column_name, row_id, reporting_period as p, community_board as v, cast(null as double) as x from project_budget_schedule
  union all select 'project_budget_schedule', 'borough', row_id, reporting_period, borough, null from project_budget_schedule
  union all select 'budget_spend_by_fy', 'spend', row_id, reporting_period, cast(spend as varchar), spend from budget_spend_by_fy
  union all select 'schedule_history', 'completion_date', row_id, reporting_period, cast(completion_date as varchar), null from schedule_history
),
names as (select distinct borough as v from ref_community_districts union select 'Citywide'),
known as (select v from names union select borough || ' ' || lpad(cast(district as varchar), 2, '0') from ref_community_districts),
items as (select row_id, trim(unnest(string_split_regex(regexp_replace(v, '["“”\[\]{}]', '', 'g'), '[;,|\t\n\r&+/]|\sand\s'))) as item from cells where column_name = 'community_board' and v is not null),
sums as (select table_name, column_name, p, count(*) as n, sum(case when v is null then 1 else 0 end) / count(*) as rate, median(case when isfinite(x) then x end) as m from cells where p is not null group by all),
loads as (select *, row_number() over (partition by column_name order by p) as i from sums),
steps as (select b.*, a.p as before, a.n as n0, a.rate as rate0, a.m as m0 from loads b join loads a on a.column_name = b.column_name and a.i = b.i - 1),
shares as (select p, v, count(*) as k from cells where column_name = 'borough' and v is not null group by all)
select distinct 'project_budget_schedule' as table_name, 'community_board' as column_name, 'bad_value' as kind, row_id as ref_id from items where item <> '' and item not in (select v from known)
union all select table_name, column_name, 'bad_value', row_id from cells where column_name = 'borough' and v is not null and v not in (select v from names)
union all select table_name, column_name, 'bad_value', row_id from cells where column_name = 'spend' and v is not null and (not isfinite(x) or x < 0 or x > 5000000000)
union all select 'schedule_history', 'completion_date', 'bad_value', row_id from schedule_history where cast(completion_date as date) < date '1990-01-01' or cast(completion_date as date) > date '2060-12-31'
union all select table_name, column_name, 'null_rate', p from steps where abs(rate - rate0) > 0.15
union all select table_name, column_name, 'median', p from steps where column_name = 'spend' and (m > 5 * m0 or m0 > 5 * m)
union all select 'project_budget_schedule', 'borough', 'value_share', p from steps where column_name = 'borough' and exists (
  select 1 from (select v, sum(case when s.p = steps.p then cast(k as double) / n else -cast(k as double) / n0 end) as d from shares s where s.p in (steps.p, steps.before) group by v) where abs(d) > 0.15)
"""

P7_PROFILE = """
with cells as (
  select 'community_board' as column_name, reporting_period as p, community_board as v, cast(null as double) as x from project_budget_schedule
  union all select 'borough', reporting_period, borough, null from project_budget_schedule
  union all select 'spend', reporting_period, cast(spend as varchar), spend from budget_spend_by_fy
  union all select 'completion_date', reporting_period, cast(completion_date as varchar), cast(datediff('day', date '1970-01-01', cast(completion_date as date)) as double) from schedule_history
),
counts as (select column_name, cast(p as bigint) as load, v, x, count(*) as n from cells where p is not null group by all)
select column_name, load, cast(sum(n) as bigint) as n_rows, cast(sum(case when v is null then n else 0 end) as bigint) as n_null, round(sum(case when v is null then n else 0 end) / sum(n), 6) as null_rate,
  count(v) as n_distinct, min(case when isfinite(x) then x end) as low, max(case when isfinite(x) then x end) as high,
  case when min(case when isfinite(x) then x end) is null then min(v) end as least, case when min(case when isfinite(x) then x end) is null then max(v) end as most,
  round(case when count(v) > 0 then greatest(0.0, log2(sum(n) filter (v is not null)) - sum(n * log2(n)) filter (v is not null) / sum(n) filter (v is not null)) end, 4) as entropy
from counts group by all
"""

SQL = {"p1_found": P1, "p2_found": P2, "p4_found": P4, "p4_edges": P4_EDGES, "p5_found": P5, "p7_found": P7, "p7_profile": P7_PROFILE}
