"""Queries of the problems tagged llm (3, 6, 8, 9 and 10), and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.values import MISSING, finite, present, trimmed
from plinth.llm import bpe, components, langid, mixture, survivor
from plinth.session import cut
from plinth.sources.tables import table


def _money(c: str):
    return F.coalesce(finite(F.col(c)) > 0, F.lit(False))


def _ranked(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """df with trust_rank of its feed: a fixed table of five rows."""
    df = df.drop("trust_rank", "written")
    trust = table(spark, sf, "feed_trust").where("feed is not null").groupBy("feed").agg(F.min("trust_rank").alias("trust_rank"))
    return df.join(F.broadcast(trust), "feed", "left")


def _project_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving rows of delivered records, by one search over all bundles: agency and budget by themselves, both agencies as one,
    and borough and board, which have to agree on the borough. Contexts are the boroughs of the fixed table."""
    projects = _ranked(table(spark, sf, "project_budget_schedule"), spark, sf)
    names = sorted(r.borough for r in table(spark, sf, "ref_community_districts").select("borough").distinct().collect())
    borough = F.when(F.col("borough").isin(*names), F.col("borough"))
    board = F.regexp_extract(F.col("community_board"), rf"^({'|'.join(names)})(?: \d\d)?$", 1)
    board = F.when(board != "", board)
    agency = present(F.col("managing_agency")).isNotNull()
    bundles = [
        survivor.Bundle("managing_agency", agency),
        survivor.Bundle("total_budget", _money("total_budget")),
        survivor.Bundle("agencies", agency & present(F.col("sponsor_agency")).isNotNull()),
        survivor.Bundle("borough", borough.isNotNull(), borough, tuple(names)),
        survivor.Bundle("community_board", board.isNotNull(), board, tuple(names)),
    ]
    return survivor.survivors(projects, {c: F.col(c) for c in ("fms_id", "reporting_period", "pid")}, bundles, F.col("trust_rank"), F.col("loaded_at"), F.col("row_id"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    a = _project_survivors(spark, sf).where(F.col("bundle").isin("managing_agency", "total_budget"))
    written = table(spark, sf, "project_budget_schedule").select("fms_id").where("fms_id is not null").distinct().withColumn("written", F.lit(True))
    rows = _ranked(table(spark, sf, "nyc_capital_rows"), spark, sf).join(written, "fms_id", "left")
    number = F.regexp_replace(trimmed(F.col("fms_id")), r"^\d{3}\s+", "")
    project = F.upper(F.regexp_replace(number, r"[\s\p{Z}_-]+", ""))
    rows = rows.where(project != "")  # a row without an fms_id is of no known project
    b = survivor.survivors(
        rows, {"project": project},
        [survivor.Bundle("fms_id", F.coalesce("written", F.lit(False))), survivor.Bundle("title", present(F.col("title")).isNotNull()), survivor.Bundle("budget", _money("budget"))],
        F.col("trust_rank"), F.col("as_of"), F.col("row_id"),
    )
    pick = lambda df, name: df.select(F.lit(name).alias("table_name"), "row_id", F.col("bundle").alias("field_name"))
    return pick(a, "project_budget_schedule").unionByName(pick(b, "nyc_capital_rows"))


def p3_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Whole bundles of a delivered record: agencies, and borough and board, which have to agree on the borough."""
    return _project_survivors(spark, sf).where(F.col("bundle").isin("agencies", "borough", "community_board"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "project_budget_schedule").select("pid", F.col("fms_id").alias("member"))
    listed = table(spark, sf, "project_schedules").select("pid", F.explode("fms_ids").alias("f")).select("pid", F.upper(trimmed(F.col("f"))).alias("member"))
    links = rows.unionByName(listed).where("pid > 0 and member is not null and member != ''").select(F.col("pid").cast("string").alias("hub"), "member")
    return components.groups(links).select("group_id", F.col("member").alias("fms_id"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return bpe.encode(docs, F.col("doc_id"), F.col("text"), bpe.vocabulary_path(spark)).withColumnRenamed("key", "doc_id")


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    counted = bpe.encode(docs, F.col("doc_id"), F.col("text"), bpe.vocabulary_path(spark), only_counts=True, extra={"source": F.col("source")})
    sized = cut(counted.withColumnRenamed("key", "doc_id"))
    wanted = table(spark, sf, "mix_targets").where("source is not null")
    targets = [mixture.Target(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in wanted.collect()]  # a fixed table
    return sized, wanted, mixture.mix(sized, targets)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[2]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.shares(*_mixture(spark, sf))


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every document with words, with its confidence."""
    docs = table(spark, sf, "documents")
    model = langid.fit(langid.sample(docs, F.col("text"), F.col("lang")))
    return langid.segments(docs, F.col("doc_id"), F.col("text"), F.col("lang"), model).withColumnRenamed("key", "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.wrong_or_missing(p10_segments(spark, sf)).select("doc_id", "seg_no", "lang_code")


QUERIES = {f.__name__: f for f in (p3_found, p3_bundles, p6_found, p8_ids, p9_mix, p9_shares, p10_found, p10_segments)}

_BLANK = r"[\s\p{Z}\x{FEFF}\x{200B}]"
_MISSING = ", ".join(f"'{x}'" for x in MISSING)


def _says(c: str) -> str:
    return f"(lower(regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')) not in ({_MISSING}))"


def _best(rows: str, name: str, keys: str, field: str, usable: str, when: str) -> str:
    return f"""
select '{name}' as table_name, row_id, '{field}' as field_name from (
  select *, row_number() over (partition by {keys} order by trust_rank nulls last, {when} desc nulls last, row_id) as i
  from {rows} where ({usable}) and n > 1) where i = 1"""


_P3 = rf"""
with a as (select p.*, t.trust_rank, count(*) over (partition by fms_id, reporting_period, pid) as n from project_budget_schedule p left join feed_trust t using (feed)),
b0 as (select r.*, t.trust_rank, upper(regexp_replace(regexp_replace(trim(r.fms_id), '^\d{{3}}\s+', ''), '[\s_-]+', '', 'g')) as project,
  r.fms_id in (select fms_id from project_budget_schedule where fms_id is not null) as written from nyc_capital_rows r left join feed_trust t using (feed)),
b as (select *, count(*) over (partition by project) as n from b0 where project <> '')
""" + " union all ".join([
    _best("a", "project_budget_schedule", "fms_id, reporting_period, pid", "managing_agency", _says("managing_agency"), "loaded_at"),
    _best("a", "project_budget_schedule", "fms_id, reporting_period, pid", "total_budget", "isfinite(total_budget) and total_budget > 0", "loaded_at"),
    _best("b", "nyc_capital_rows", "project", "fms_id", "written", "as_of"),
    _best("b", "nyc_capital_rows", "project", "title", _says("title"), "as_of"),
    _best("b", "nyc_capital_rows", "project", "budget", "isfinite(budget) and budget > 0", "as_of"),
])

_OUT = "{'r': 1000001, 'l': 4611686018427387904, 'i': 4611686018427387904}"
_P3_BUNDLES = rf"""
with names as (select distinct borough as b from ref_community_districts),
a as (
  select fms_id, reporting_period, pid, row_id, {{'r': coalesce(t.trust_rank, 1000000), 'l': coalesce(-epoch_us(loaded_at), 4611686018427387904), 'i': row_id}} as s,
    coalesce({_says("managing_agency")} and {_says("sponsor_agency")}, false) as both_agencies, case when borough in (select b from names) then borough end as c1,
    case when regexp_full_match(community_board, '(' || (select string_agg(b, '|') from names) || ')( [0-9][0-9])?') then regexp_replace(community_board, ' [0-9][0-9]$', '') end as c2
  from project_budget_schedule p left join feed_trust t using (feed)),
g as (select fms_id, reporting_period, pid, min(case when both_agencies then s end) as s0, count(c1) as n1, count(c2) as n2 from a group by all having count(*) > 1),
c as (select distinct fms_id, reporting_period, pid, c from (select *, c1 as c from a union all select *, c2 from a) where c is not null),
k as (
  select c.fms_id, c.reporting_period, c.pid, min(case when a.c1 = c.c then a.s end) as s1, min(case when a.c2 = c.c then a.s end) as s2 from c
  join a on a.fms_id is not distinct from c.fms_id and a.reporting_period is not distinct from c.reporting_period and a.pid is not distinct from c.pid group by c.fms_id, c.reporting_period, c.pid, c.c),
w as (
  select g.fms_id, g.reporting_period, g.pid, min({{'cost': case when n1 > 0 then coalesce(s1.r, 1000001) else 0 end + case when n2 > 0 then coalesce(s2.r, 1000001) else 0 end,
    'x': case when n1 > 0 then coalesce(s1, {_OUT}) else {_OUT} end, 'y': case when n2 > 0 then coalesce(s2, {_OUT}) else {_OUT} end}}) as w
  from g join k on g.fms_id is not distinct from k.fms_id and g.reporting_period is not distinct from k.reporting_period and g.pid is not distinct from k.pid group by all)
select fms_id, reporting_period, pid, 'agencies' as bundle, s0.i as row_id from g where s0 is not null
union all select fms_id, reporting_period, pid, 'borough', w.x.i from w where w.x.i <> 4611686018427387904
union all select fms_id, reporting_period, pid, 'community_board', w.y.i from w where w.y.i <> 4611686018427387904
"""

_P6 = """
with recursive named as (
  select pid, fms_id as f from project_budget_schedule where pid > 0 and fms_id is not null
  union select pid, upper(trim(x)) from (select pid, unnest(fms_ids) as x from project_schedules) where pid > 0 and trim(x) <> ''
),
firsts as (select pid, min(f) as r from named group by pid),
edges as (select distinct r as a, f as b from named join firsts using (pid) where r <> f),
pairs as (select a, b from edges union select b, a from edges),
reach(f, g) as (select a, a from pairs union select b, g from reach join pairs on a = f where g < b),
labels as (select f, min(g) as g from reach group by f),
again as (select f, g from labels)
select g as group_id, f as fms_id from again
"""

SQL = {"p3_found": _P3, "p3_bundles": _P3_BUNDLES, "p6_found": _P6}
