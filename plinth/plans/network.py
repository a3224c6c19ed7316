"""Networks, lineages, text parsers, exports and event windows (OP-N, OP-T07..T19, OP-S20, SURVEY 2.10)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import textparse
from plinth.operators import graph
from plinth.plans.book import Book
from plinth.session import shared_dir
from plinth.sources import files
from plinth.sources.tables import table
from plinth.streaming import reports

BOOK = Book()
query = BOOK.query


@query("""with ends as (select distinct o_orderstatus as network, o_orderpriority as street, unnest([o_custkey % 500, o_custkey % 500 + 1]) as node from orders)
select a.network, a.node, a.street as street_a, b.street as street_b from ends a join ends b on a.network = b.network and a.node = b.node and a.street < b.street""")
def n01_crossings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("network"), F.col("o_orderpriority").alias("street"), (F.col("o_custkey") % 500).alias("u"))
    return graph.crossings(o.withColumn("v", F.col("u") + 1), "network", "street")


@query("""with recursive e0 as (select cast(l_suppkey as varchar) as network, lpad(cast(l_partkey % 40 as varchar), 2, '0') as u, lpad(cast(l_orderkey % 40 as varchar), 2, '0') as v, min(l_quantity) as length from lineitem group by all), e1 as (select * from e0 where u <> v),
e as (select network, u, v, min(length) as length from (select * from e1 union all select network, v, u, length from e1) group by all),
d(network, node, dist) using key (network, node) as (select distinct network, '00', cast(0 as double) from e1 union select e.network, e.v, min(d.dist + e.length) from d join e on e.network = d.network and e.u = d.node left join recurring.d r on r.network = e.network and r.node = e.v where r.dist is null or d.dist + e.length < r.dist group by e.network, e.v)
select network, dist as length, true as joined from d where node = '39' and dist <= 8000""")
def n02_routes(spark: SparkSession, sf: str) -> DataFrame:
    """OP-N02: within each supplier's network of parts, the length of the way between two nodes, no longer than 8,000, and whether its
    nodes lead from the one to the other. A supplier's network has at most 1,560 links, however many lines it comes from."""
    node = lambda c, n: F.format_string("%02d", (F.col(c) % n).cast("int"))
    edges = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("network"), node("l_partkey", 40).alias("u"), node("l_orderkey", 40).alias("v")).agg(F.min("l_quantity").alias("length")).where("u != v")
    wanted = edges.select("network").distinct().select("network", F.lit("a").alias("route"), F.lit("00").alias("source"), F.lit("39").alias("target"))
    found = graph.routes(edges, wanted, "network", 8000.0)
    return found.select("network", "length", ((F.col("nodes")[0] == "00") & (F.element_at("nodes", -1) == "39")).alias("joined"))


@query("""with recursive arcs as (select p_partkey as u, (p_partkey * 7 + 3) % 1999 + 1 as v from part), walk(step, node, seen) as (
select 0, cast(1 as bigint), [cast(1 as bigint)] union all select step + 1, a.v, list_append(seen, a.v) from walk join arcs a on a.u = node where not list_contains(seen, a.v))
select step, node from walk""")
def n04_followed(spark: SparkSession, sf: str) -> DataFrame:
    arcs = table(spark, sf, "part").select(F.col("p_partkey").alias("u"), ((F.col("p_partkey") * 7 + 3) % 1999 + 1).alias("v"))
    return graph.followed(arcs, 1)


@query("""with recursive links as (select 'p' || pid as a, upper(trim(f)) as b from (select pid, unnest(fms_ids) as f from project_schedules) where trim(f) <> ''),
pairs as (select a, b from links union select b, a from links), reach(n, l) as (select a, a from pairs union select b, l from reach join pairs on a = n where l < b)
select n as node, min(l) as lineage from reach group by 1""")
def n05_lineages(spark: SparkSession, sf: str) -> DataFrame:
    """OP-N05: schedules and projects that share an id, directly or indirectly."""
    f = table(spark, sf, "project_schedules").select("pid", F.explode("fms_ids").alias("f")).where("trim(f) != ''")
    return graph.lineages(f.select(F.concat(F.lit("p"), "pid").alias("a"), F.upper(F.trim("f")).alias("b")))


@query("""with t as (select fms_id, min(borough) as t from project_budget_schedule where borough is not null group by 1 having count(distinct borough) = 1)
select p.row_id, t.t as borough from project_budget_schedule p join t using (fms_id) where p.borough is null""")
def n06_sole_tag(spark: SparkSession, sf: str) -> DataFrame:
    """OP-N06: rows without a borough whose project has exactly one elsewhere."""
    return graph.sole_tag(table(spark, sf, "project_budget_schedule").select("fms_id", "row_id", "borough"), "fms_id", "borough", "row_id")


_KIND = textparse._KIND
_HOUSE = rf"\b(\d{{1,5}}(?:-\d{{1,3}})?)[\s\x1c-\x1f\x85\x{{a0}}\p{{Z}}]+((?:[A-Z0-9][\p{{L}}\p{{N}}_'.-]*[\s\x1c-\x1f\x85\x{{a0}}\p{{Z}}]+){{1,3}}?{_KIND})\b"
_PROSE_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(textparse._PROSE)) + "]"
_LONG_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in textparse._LONG.items()) + "}"


@query(f"""with m as (select doc_id, regexp_extract_all(text, $x${_HOUSE}$x$, 1, 'i') as n, regexp_extract_all(text, $x${_HOUSE}$x$, 2, 'i') as s from documents where text is not null),
w as (select doc_id, n, list_transform(s, lambda x: list_filter(string_split_regex(replace(upper(x), '.', ''), '[\\s\\p{{Z}}]+'), lambda y: y <> '')) as s from m),
a as (select doc_id, list_filter(list_transform(range(1, len(n) + 1), lambda i: case when not list_has_any(s[i], {_PROSE_SQL}) then n[i] || ' ' || array_to_string(list_concat(s[i][:-2], [coalesce(({_LONG_SQL})[s[i][-1]], s[i][-1])]), ' ') end), lambda x: x is not null) as a from w),
u as (select doc_id, list_filter(range(1, len(a) + 1), lambda i: list_position(a, a[i]) = i) as i, a from a) select doc_id, cast(unnest(range(0, least(len(i), 3))) as integer) as pos, unnest(list_transform(i[:3], lambda k: a[k])) as address from u""")
def t07_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T07: up to three addresses of a text (the feature of the report); only texts with a digit reach Python."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"(?U)\d")).select("doc_id", textparse.addresses("text").alias("a"))
    return d.select("doc_id", F.posexplode("a").alias("pos", "address"))


@query()
def t10_units(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T10: numbered items named in minutes."""
    kinds = {"ITEM": "ITEM", "PID": "PID"}
    run = textparse.units(kinds)
    d = table(spark, sf, "documents").where(textparse.may_name_units(F.col("text"), kinds)).select("doc_id", F.explode(run("text")).alias("u"))
    return d.select("doc_id", "u.kind", "u.number")


@query(r"""with n as (select station_no, trim(regexp_replace(upper(regexp_replace(station, '[0-9]+', '', 'g')), '[^A-Z0-9]+', ' ', 'g')) as name from station_reach), t as (select row_id, ' ' || trim(regexp_replace(upper(title), '[^A-Z0-9]+', ' ', 'g')) || ' ' as w from nyc_capital_rows),
f as (select station_no, split_part(name, ' ', 1) as name from n) select t.row_id, f.station_no from t join f on f.name <> '' and contains(t.w, ' ' || f.name || ' ')""")
def t17_named_parts(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T17 over the first words of station names, as the SQL says: which of them stand in a title as whole words."""
    stations = table(spark, sf, "station_reach").select("station_no", F.split(F.regexp_replace("station", "[0-9]+", ""), " ")[0].alias("name"))
    return textparse.named_parts(table(spark, sf, "nyc_capital_rows").where("title is not null"), "row_id", F.col("title"), stations, "station_no", F.col("name"))


@query("""select point_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || cast(round(lon, 6) as varchar) || ',' || cast(round(lat, 6) as varchar) || ']},"properties":{"point_id":' || point_id || ',"fms_id":"' || fms_id || '"}}' as feature
from loc_cpdb_points where lon between -75 and -73 and lat between 40 and 42 and fms_id is not null""")
def s20_features(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S20: points as GeoJSON features."""
    p = table(spark, sf, "loc_cpdb_points").where(F.col("lon").between(-75, -73) & F.col("lat").between(40, 42) & F.col("fms_id").isNotNull())
    return files.features(p, "lon", "lat", ["point_id", "fms_id"], digits=6).select(F.get_json_object("value", "$.properties.point_id").cast("bigint").alias("point_id"), F.col("value").alias("feature"))


@query("""select time_bucket(interval '1 hour', ts) as began, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def st_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour")
    return out.select(F.col("began").cast("timestamp_ntz").alias("began"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w >= interval '30 minutes' or lag(ts) over w is null then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
i as (select user_id, ts, sum(s) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
select min(ts) as began, max(ts) + interval '30 minutes' as ended, user_id, count(*) as n from i group by user_id, k""")
def st_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes")
    return out.select(F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "user_id", "n")


@query("""select event_type, count(*) as n, round(sum(value), 3) as total from events group by 1""")
def st_streamed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the events, window by window with a watermark, to its end; the closed and open windows add up to the table."""
    stream = reports.replay(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    name = f"windows_{uuid.uuid4().hex[:8]}"
    at = f"{shared_dir(spark)}/{name}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/state")

    windows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{at}/state")
    return done.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


QUERIES, SQL = BOOK.queries, BOOK.sql
