"""Text operators, rules, precedence and quality (OP-T, OP-J16..J18, OP-Q, OP-M01, C04, C23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import periods, text
from plinth.functions.values import finite
from plinth.operators import quality, rules
from plinth.plans.book import Book
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query
COMMON = ("STREET", "AVENUE", "ROAD", "PLACE", "LANE", "COURT", "ROW")
_LIST = "[" + ", ".join(f"'{c}'" for c in COMMON) + "]"
_TOK = "list_filter(string_split_regex(regexp_replace(upper({0}), '[^A-Z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 1)"


@query(f"select row_id, array_to_string({_TOK.format('agency_project_name')}, ' ') as words from project_budget_schedule")
def t01_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").select("row_id", F.array_join(text.tokens(F.col("agency_project_name")), " ").alias("words"))


@query(f"""with n as (select row_id, list_sort(list_distinct(list_filter({_TOK.format('title')}, lambda x: not list_contains({_LIST}, x)))) as w from nyc_capital_rows) select row_id, array_to_string(w, ' ') as words from n""")
def t02_distinctive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nyc_capital_rows").select("row_id", F.array_join(F.array_sort(text.distinctive(F.col("title"), COMMON)), " ").alias("words"))


@query("select regexp_replace(lower(current_phase), '[^a-z]', '', 'g') as phase_key, count(*) as n from project_budget_schedule group by 1")
def t05_phase_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").groupBy(text.letters_key(F.col("current_phase")).alias("phase_key")).agg(F.count(F.lit(1)).alias("n"))


@query("select fms_id, regexp_replace(regexp_replace(fms_id, '^[A-Z]+-?', ''), '[A-Z]$', '') as stem from project_budget_schedule group by all")
def t06_affixes(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_replace("fms_id", "^[A-Z]+-?", ""), "[A-Z]$", "")
    return table(spark, sf, "project_budget_schedule").select("fms_id", stem.alias("stem")).distinct()


@query(r"""with f as (select row_id, unnest(regexp_extract_all(community_board, '(Manhattan|Bronx|Brooklyn|Queens|Staten Island) (\d\d)')) as m from project_budget_schedule)
select distinct f.row_id, d.boro_cd from f join ref_community_districts d on f.m = d.borough || ' ' || lpad(cast(d.district as varchar), 2, '0')""")
def t08_district_codes(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T08: district codes in a text, known ones only; the districts are a fixed table."""
    known = table(spark, sf, "ref_community_districts").select(F.format_string("%s %02d", "borough", "district").alias("m"), "boro_cd")
    found = table(spark, sf, "project_budget_schedule").select("row_id", F.explode(text.extract_all(F.col("community_board"), r"(Manhattan|Bronx|Brooklyn|Queens|Staten Island) (\d\d)")).alias("m"))
    return found.join(F.broadcast(known), "m").select("row_id", "boro_cd").distinct()


@query("""with p as (select row_id, list_sort(list_distinct(list_filter(list_transform(string_split(budget_line, '-'), lambda x: trim(x)), lambda x: x <> '' and upper(x) <> 'NULL'))) as x from project_budget_schedule) select row_id, array_to_string(x, ',') as parts from p""")
def t11_sorted_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "project_budget_schedule").select("row_id", F.array_join(text.sorted_ids(F.col("budget_line"), "-"), ",").alias("parts"))


@query(r"""select point_id, regexp_extract(description, '(\d+)', 1) as first_number, coalesce(nullif(regexp_extract(description, '^([A-Za-z]+)', 1), ''), '?') as head from loc_cpdb_points""")
def t21_code_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "loc_cpdb_points").select("point_id", F.regexp_extract("description", r"(\d+)", 1).alias("first_number"), F.coalesce(F.nullif(F.regexp_extract("description", "^([A-Za-z]+)", 1), F.lit("")), F.lit("?")).alias("head"))


def title_score(word: str, near: int) -> str:
    return f"coalesce(list_max(list_transform({_TOK.format('title')}, lambda x: case when x = '{word}' then 1.0 when starts_with(x, '{word}') then 0.75 when levenshtein(x, '{word}') <= {near} then 0.5 else 0.0 end)), 0.0)"


@query(f"""with s as (select row_id, cast({title_score('GANTRY', 1)} as double) * 2 as a, cast({title_score('ROOF', 1)} as double) * 2 as b from nyc_capital_rows) select row_id, a + b as score from s where a > 0 and b > 0""")
def t25_search(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T25: prefix and fuzzy search of all words, with field boosts."""
    return text.search(table(spark, sf, "nyc_capital_rows"), "row_id", {"title": (F.col("title"), 2.0)}, "gantry roof")


@query("""select station_no, station from station_reach where list_bool_or(list_transform(string_split(lower(station), ' '), lambda x: starts_with(x, 'ga'))) order by station, station_no limit 3""")
def t26_place_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T26: the first three places with a word of the prefix (a top-k report)."""
    hit = F.exists(F.split(F.lower("station"), " "), lambda x: F.startswith(x, F.lit("ga")))
    return table(spark, sf, "station_reach").where(hit).select("station_no", "station").orderBy("station", "station_no").limit(3)


@query(f"""with t as (select distinct title, list_filter({_TOK.format('title')}, lambda x: not list_contains({_LIST}, x)) as w from nyc_capital_rows where title is not null),
s as (select station_no, list_distinct(list_filter({_TOK.format("regexp_replace(station, '[0-9]+', '', 'g')")}, lambda x: not list_contains({_LIST} || ['SQUARE', 'YARD', 'JUNCTION'], x))) as p from station_reach)
select title, station_no, len(p) as n from t join s on len(p) > 0 and list_has_all(w, p)""")
def j16_token_containment(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J16: stations all of whose distinctive words stand in a title."""
    titles = table(spark, sf, "nyc_capital_rows").where("title is not null").select("title").distinct()
    stations = table(spark, sf, "station_reach").select("station_no", F.regexp_replace("station", "[0-9]+", "").alias("station"))
    found = text.contained(titles, "title", "title", stations, "station_no", "station", [*COMMON, "SQUARE", "YARD", "JUNCTION"])
    return found.select("title", "station_no", F.col("n").cast("bigint").alias("n"))


@query(r"""with a as (select doc_id, regexp_extract(text, '\$([0-9][0-9,]*)', 1) as m from documents) select doc_id, cast(replace(m, ',', '') as double) as amount from a where m <> ''""")
def m01_money_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """OP-M01: the first amount written in each text, as the SQL says; m01_every_amount has all."""
    m = F.regexp_extract("text", r"\$([0-9][0-9,]*)", 1)
    return table(spark, sf, "documents").select("doc_id", m.alias("m")).where("m != ''").select("doc_id", periods.money(F.col("m")).alias("amount"))


@query(r"""with a as (select doc_id, regexp_extract_all(text, '\$([0-9][0-9,]*)', 1) as m from documents), n as (select doc_id, unnest(m) as m, unnest(range(1, len(m) + 1)) as pos from a)
select doc_id, cast(pos as integer) as pos, cast(replace(m, ',', '') as double) as amount from n""")
def m01_every_amount(spark: SparkSession, sf: str) -> DataFrame:
    """OP-M01: every amount written in a text, with its position among them."""
    m = F.regexp_extract_all("text", F.lit(r"\$([0-9][0-9,]*)"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(m).alias("pos", "m")).select("doc_id", (F.col("pos") + 1).alias("pos"), periods.money(F.col("m")).alias("amount"))


_RULES = [(1, "(?i)roof|facade|elevator", "building"), (2, "(?i)sewer|water|culvert|drainage", "water"), (3, "(?i)street|bridge|wall", "street"), (4, "(?i)playground|ball field|comfort", "parks")]


@query("""select row_id, case when regexp_matches(title, '(?i)roof|facade|elevator') then 1 when regexp_matches(title, '(?i)sewer|water|culvert|drainage') then 2 when regexp_matches(title, '(?i)street|bridge|wall') then 3 when regexp_matches(title, '(?i)playground|ball field|comfort') then 4 end as rule_no,
case when regexp_matches(title, '(?i)roof|facade|elevator') then 'building' when regexp_matches(title, '(?i)sewer|water|culvert|drainage') then 'water' when regexp_matches(title, '(?i)street|bridge|wall') then 'street' when regexp_matches(title, '(?i)playground|ball field|comfort') then 'parks' end as label from nyc_capital_rows""")
def j17_first_match_rule(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J17, C04: the first matching rule with its number as evidence."""
    listed = spark.createDataFrame(_RULES, "rule_no int, pattern string, label string")
    return rules.first_match(table(spark, sf, "nyc_capital_rows").select("row_id", "title"), ["row_id"], "title", listed).select("row_id", "rule_no", "label")


@query("""select row_id, case when not isfinite(spend) then 'not finite' when spend < 0 then 'negative' when spend = 0 then 'zero' when spend > 5e9 then 'implausible' when spend is not null then 'plain' end as kind from budget_spend_by_fy""")
def t24_cascade(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("spend")
    kinds = [("not finite", s.isNotNull() & finite(s).isNull()), ("negative", s < 0), ("zero", s == 0), ("implausible", s > 5e9), ("plain", s.isNotNull())]
    return table(spark, sf, "budget_spend_by_fy").select("row_id", rules.cascade(kinds).alias("kind"))


@query("""with c as (select fms_id, 1 as prio, point_id as t, 'points' as source, lon, lat from loc_cpdb_points where lon between -75 and -73 and lat between 40 and 42
union all select p.fms_id, 2, p.row_id, 'district', d.lon, d.lat from project_budget_schedule p join ref_community_districts d on p.community_board = d.borough || ' ' || lpad(cast(d.district as varchar), 2, '0')
union all select p.fms_id, 3, p.row_id, 'borough', b.lon, b.lat from project_budget_schedule p join (select borough, avg(lon) as lon, avg(lat) as lat from ref_community_districts group by 1) b on p.borough = b.borough)
select fms_id, source, round(lon, 6) as lon, round(lat, 6) as lat from c qualify row_number() over (partition by fms_id order by prio, t) = 1""")
def j18_precedence_placement(spark: SparkSession, sf: str) -> DataFrame:
    """OP-J18, C01: the place of a project from the first source that has one: its points, its board, its borough."""
    rows, d = table(spark, sf, "project_budget_schedule"), table(spark, sf, "ref_community_districts")
    points = table(spark, sf, "loc_cpdb_points").where(F.col("lon").between(-75, -73) & F.col("lat").between(40, 42)).select("fms_id", F.col("point_id").alias("t"), "lon", "lat")
    board = rows.join(F.broadcast(d.select(F.format_string("%s %02d", "borough", "district").alias("community_board"), "lon", "lat")), "community_board").select("fms_id", F.col("row_id").alias("t"), "lon", "lat")
    borough = rows.join(F.broadcast(d.groupBy("borough").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))), "borough").select("fms_id", F.col("row_id").alias("t"), "lon", "lat")
    out = rules.precedence([("points", points), ("district", board), ("borough", borough)], "fms_id", ["lon", "lat"], "t")
    return out.select("fms_id", "source", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""with r as (select fms_id, min(borough) as b from nyc_capital_rows where feed = 'ledger' and borough is not null group by 1)
select p.row_id, coalesce(r.b, p.borough) as borough, r.fms_id is not null as reviewed from project_budget_schedule p left join r using (fms_id)""")
def q04_override(spark: SparkSession, sf: str) -> DataFrame:
    reviewed = table(spark, sf, "nyc_capital_rows").where("feed = 'ledger' and borough is not null").groupBy("fms_id").agg(F.min("borough").alias("borough"))
    return rules.override(table(spark, sf, "project_budget_schedule").select("row_id", "fms_id", "borough"), reviewed, "fms_id", "borough").select("row_id", "borough", "reviewed")


@query("""select reporting_period, avg(case when regexp_matches(coalesce(community_board, ''), '^[A-Z][a-z]+') then 1.0 else 0.0 end) as coded, avg(case when regexp_matches(coalesce(community_board, ''), '^[A-Z][a-z]+') then 1.0 else 0.0 end) >= 0.9 as usable from project_budget_schedule group by 1""")
def q01_usable_versions(spark: SparkSession, sf: str) -> DataFrame:
    return quality.usable_versions(table(spark, sf, "project_budget_schedule"), "reporting_period", F.coalesce("community_board", F.lit("")).rlike("^[A-Z][a-z]+"), 0.9)


@query("""with d as (select fms_id, period, md5(string_agg(coalesce(cast(round(budget) as bigint), -1) || '|' || coalesce(phase, ''), ',' order by coalesce(cast(round(budget) as bigint), -1) || '|' || coalesce(phase, ''))) as h from project_history group by all)
select fms_id, min(period) as first_period, count(*) as versions from d group by fms_id, h""")
def q02_content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """OP-Q02: versions of equal content, whatever their row order, with the earliest date of each."""
    rows = table(spark, sf, "project_history").select("fms_id", "period", "budget", "phase")
    found = quality.content_versions(rows, ["fms_id"], "period", [F.round("budget").cast("bigint"), F.coalesce("phase", F.lit(""))])
    return found.select("fms_id", F.col("first_period"), "versions")


@query("""select fms_id, as_of, row_id, borough from nyc_capital_rows r where not exists (select 1 from project_budget_schedule p where p.fms_id = r.fms_id and p.reporting_period = 202605)
qualify row_number() over (partition by fms_id order by as_of desc, row_id desc) = 1""")
def q03_latest_archived(spark: SparkSession, sf: str) -> DataFrame:
    """OP-Q03: the latest archived record of the projects that the current release lacks."""
    current = table(spark, sf, "project_budget_schedule").where("reporting_period = 202605").select("fms_id")
    return quality.latest_archived(table(spark, sf, "nyc_capital_rows"), current, "fms_id", [F.col("as_of"), F.col("row_id")], ["as_of", "row_id", "borough"])


@query("""select 'negative budget' as problem, 'project_budget_schedule' as source, cast(row_id as varchar) as id from project_budget_schedule where isfinite(total_budget) and total_budget < 0
union all select 'no project', 'project_schedules', cast(pid as varchar) from project_schedules where coalesce(len(fms_ids), 0) = 0 union all select 'no coordinates', 'loc_cpdb_points', cast(point_id as varchar) from loc_cpdb_points where lon is null or lat is null""")
def q06_issues(spark: SparkSession, sf: str) -> DataFrame:
    """OP-Q06: one tall table of what several recorders found."""
    return quality.issues([
        ("negative budget", "project_budget_schedule", table(spark, sf, "project_budget_schedule").where(finite(F.col("total_budget")) < 0), F.col("row_id")),
        ("no project", "project_schedules", table(spark, sf, "project_schedules").where(F.coalesce(F.size("fms_ids"), F.lit(0)) <= 0), F.col("pid")),
        ("no coordinates", "loc_cpdb_points", table(spark, sf, "loc_cpdb_points").where("lon is null or lat is null"), F.col("point_id")),
    ])


@query("""select source, count(*) as n, count(*) filter (n_chars = length(text)) as agreed, 100.0 * count(*) filter (n_chars = length(text)) / cast(count(*) as double) as precision_pct from documents where text is not null group by rollup (source)""")
def a27_precision(spark: SparkSession, sf: str) -> DataFrame:
    """OP-A27, H31: how often a stated value agrees with a measured one, by group and in all."""
    return quality.precision(table(spark, sf, "documents").where("text is not null"), ["source"], F.col("n_chars") == F.length("text"))


QUERIES, SQL = BOOK.queries, BOOK.sql
