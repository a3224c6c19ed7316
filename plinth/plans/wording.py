"""Names in texts, shapes and lines: street forms, tests of matches, parsers, distances and meetings (OP-T, G, N, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import geometry, text, textparse
from plinth.operators import graph, places, spatial
from plinth.plans.book import Book
from plinth.plans.further import LINES, line_edges
from plinth.plans.spatialplans import EDGES, HAV, IN_TOWN, district_edges, town
from plinth.sources.tables import table

BOOK = Book()
query = BOOK.query
COMMON = ("STREET", "AVENUE", "ROAD", "PLACE", "LANE", "COURT", "ROW", "SQUARE", "YARD", "JUNCTION", "LANDING")
_COMMON_SQL = "[" + ", ".join(f"'{c}'" for c in COMMON) + "]"
_TOK = "list_filter(string_split_regex(regexp_replace(upper({0}), '[^A-Z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 1)"
_SHORT = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in (text.STREET_WORDS | text.DIRECTIONS).items()) + "}"


def _street_sql(c: str) -> str:
    words = f"list_filter(string_split(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    number = r"case when regexp_full_match(w, '\d+(ND|TH)') then left(w, -2) when regexp_full_match(w, '(\d*[02-9])?1ST') or regexp_full_match(w, '(\d*[02-9])?3RD') then left(w, -2) when regexp_full_match(w, '\d+(ST|RD)') then left(w, -2) || ' ' || right(w, 2) else w end"
    return f"array_to_string(list_transform({words}, lambda w: coalesce(({_SHORT})[w], {number})), ' ')"


#: A street beside a number with an ending, from the titles at hand: 'Gantry Street' and row 43 -> 'Gantry Street 43rd'.
_NUMBERED = "split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) || ' ' || cast(row_id % 130 as varchar) || (['st', 'nd', 'rd', 'th'])[cast(row_id % 4 as integer) + 1]"


def _numbered():
    parts = F.split("title", " ")
    word = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return F.concat(word(0), F.lit(" "), word(1), F.lit(" "), (F.col("row_id") % 130).cast("string"), F.element_at(F.array(*map(F.lit, ("st", "nd", "rd", "th"))), (F.col("row_id") % 4 + 1).cast("int")))


@query(f"""with n as (select row_id, {_NUMBERED} as t from nyc_capital_rows where title is not null), s as (select row_id, {_street_sql('t')} as street from n)
select row_id, street, regexp_replace(street, '(\\S) (?:{'|'.join(text.ENDINGS)})$', '\\1') as base from s""")
def t03_street_form(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T03: one form of street names, and the name without its last word."""
    s = table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", text.street(_numbered()).alias("street"))
    return s.select("row_id", "street", text.street_base(F.col("street")).alias("base"))


@query(rf"""with a as (select row_id, cast(row_id % 900 as varchar) || case row_id % 3 when 0 then ' ' when 1 then ' Old ' else ' and then along the ' end || title as t, {_TOK.format('title')} as w from nyc_capital_rows where title is not null)
select row_id, list_bool_or(list_transform(w, lambda x: regexp_matches(upper(t), '\b\d+[A-Z]?\s+(?:[A-Z]+\s+){{0,2}}' || x || '\b'))) as is_address from a where len(w) > 0""")
def t12_address_test(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T12: is one of a name's words a street there, after a house number?"""
    joint = F.when(F.col("row_id") % 3 == 0, " ").when(F.col("row_id") % 3 == 1, " Old ").otherwise(" and then along the ")
    rows = table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", F.concat((F.col("row_id") % 900).cast("string"), joint, F.col("title")).alias("t"), text.tokens(F.col("title")).alias("w"))
    return rows.where(F.size("w") > 0).select("row_id", text.after_house_number(F.col("t"), F.col("w")).alias("is_address"))


@query(rf"""with t as (select row_id, case when row_id % 2 = 0 then managing_agencies[1] || ' - ' || title else title end as t from nyc_capital_rows where title is not null), w as (select row_id, list_filter({_TOK.format(r"regexp_replace(upper(t), '^\s*([A-Z]{2,6})\s*[-:]\s', '')")}, lambda x: not list_contains({_COMMON_SQL}, x)) as w from t where t is not null)
select row_id, w[1] as lead from w""")
def t13_lead_word(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T13: the first distinctive word of a title, an agency prefix aside."""
    t = F.when(F.col("row_id") % 2 == 0, F.concat(F.get("managing_agencies", F.lit(0)), F.lit(" - "), F.col("title"))).otherwise(F.col("title"))
    rows = table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", t.alias("t")).where("t is not null")
    return rows.select("row_id", text.lead_word(F.col("t"), COMMON).alias("lead"))


_CAND = f"""tt as (select distinct title, {_TOK.format('title')} as w from nyc_capital_rows where title is not null),
ss as (select station_no, lon, lat, list_distinct(list_filter({_TOK.format("regexp_replace(station, '[0-9]+', '', 'g')")}, lambda x: not list_contains({_COMMON_SQL}, x))) as p from station_reach),
cand as (select title, station_no, lon, lat, len(p) as n, length(array_to_string(p, '')) as letters from tt join ss on len(p) > 0 and list_has_all(w, p))"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(title, station_no, lon, lat, n, letters): stations all of whose distinctive words stand in a title, with what is scored."""
    stations = table(spark, sf, "station_reach").select("station_no", "lon", "lat", F.regexp_replace("station", "[0-9]+", "").alias("station"))
    titles = table(spark, sf, "nyc_capital_rows").where("title is not null").select("title").distinct()
    found = text.contained(titles, "title", "title", stations, "station_no", "station", COMMON)
    words = stations.select("station_no", "lon", "lat", F.length(F.array_join(text.distinctive(F.col("station"), COMMON), "")).alias("letters"))
    return found.join(words, "station_no").select("title", "station_no", "lon", "lat", "n", "letters")


@query(f"""with {_CAND}, best as (select title, max({{'a': n, 'b': letters, 'c': station_no}}) as b from cand group by 1), top as (select c.*, b.b.c as best from cand c join best b on b.title = c.title and c.n = b.b.a and c.letters = b.b.b),
far as (select t.title, t.best, max({HAV.format(a='s.lon', b='s.lat', c='t.lon', d='t.lat')}) as m from top t join station_reach s on s.station_no = t.best group by all) select title, best as station_no from far where m <= 40000""")
def t14_unambiguous_match(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T14: the best place of a title by words and letters; none where an equally good one lies more than 40 km from it."""
    far = spatial.haversine_m(F.col("best.lon"), F.col("best.lat"), F.col("lon"), F.col("lat"))
    found = text.unambiguous(candidates(spark, sf).select("title", "station_no", "lon", "lat", "n", "letters"), "title", [F.col("n"), F.col("letters")], far, 40_000.0)
    return found.select("title", "station_no")


_LINEAR, _SPREAD = r"\b(SEWER|WATER MAIN|STREET LIGHTING|TRUNK)\b", r"\b(?:\d+|TWO|SEVERAL|VARIOUS|MULTIPLE)\s+(?:[A-Z]+\s+){0,2}(?:SITES|LOCATIONS|BUILDINGS|STATIONS)\b|\bCITYWIDE\b"


@query(rf"""select row_id, case when regexp_matches(upper(title), '{_LINEAR}') then 'linear' when regexp_matches(upper(title), '{_SPREAD}') then 'spread' when lower(trim(title)) in ('', '-', '--', 'n/a', 'null', 'tbd', 'none', 'unknown') then 'no name' else 'one place' end as scope from nyc_capital_rows where title is not null""")
def t15_name_scope(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T15: may a title be matched with one named place? Lines, several sites and missing names may not."""
    t, up = F.lower(F.trim("title")), F.upper("title")
    scope = F.when(up.rlike(_LINEAR), "linear").when(up.rlike(_SPREAD), "spread").when(t.isin("", "-", "--", "n/a", "null", "tbd", "none", "unknown"), "no name").otherwise("one place")
    return table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", scope.alias("scope"))


@query(f"""with s as (select station_no, 'P.S. 0' || station_no || ' - ' || station as name from station_reach), p as (select station_no, regexp_replace(upper(name), '[^A-Z0-9 ]+', '', 'g') as f from s),
q as (select station_no, regexp_extract(f, '^\\s*([A-Z]{{1,6}})\\s*0*(\\d{{1,4}})\\b\\s*(.*)$', ['prefix', 'number', 'rest']) as r from p), w as (select station_no, r.prefix as prefix, cast(r.number as integer) as number, {_TOK.format('r.rest')} as w from q),
t as (select distinct title, {_TOK.format('title')} as tw from nyc_capital_rows where title is not null)
select w.station_no, prefix, number, count(t.title) as titles from w left join t on len(list_filter(w, lambda x: not regexp_full_match(x, '\\d+'))) > 0 and list_has_all(tw, list_filter(w, lambda x: not regexp_full_match(x, '\\d+') and not list_contains({_COMMON_SQL}, x))) and len(list_filter(w, lambda x: not regexp_full_match(x, '\\d+') and not list_contains({_COMMON_SQL}, x))) > 0 group by all""")
def t16_numbered_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T16: names with a letter prefix and a number, and how many titles hold all words that follow; titles are met by their words."""
    name = F.concat(F.lit("P.S. 0"), F.col("station_no"), F.lit(" - "), F.col("station"))
    parsed = table(spark, sf, "station_reach").select("station_no", text.named_number(name).alias("p")).select("station_no", "p.*")
    plain = parsed.select("station_no", F.array_join(F.filter("words", lambda w: ~w.rlike(r"^\d+$")), " ").alias("name"))
    titles = table(spark, sf, "nyc_capital_rows").where("title is not null").select("title").distinct()
    hits = text.contained(titles, "title", "title", plain, "station_no", "name", COMMON).groupBy("station_no").agg(F.count(F.lit(1)).alias("k"))
    return parsed.join(hits, "station_no", "left").select("station_no", "prefix", "number", F.coalesce("k", F.lit(0)).alias("titles"))


@query(f"""with {_CAND}, f as (select c.*, split_part(upper(s.station), ' ', 2) as kind from cand c join station_reach s using (station_no)), g as (select *, contains(upper(title), kind) as settled from f),
k as (select title, station_no, lon, lat from g qualify not settled and bool_or(settled) over (partition by title) = false or settled)
select title, min(station_no) as station_no, count(*) as n from k group by 1 having max(lon) - min(lon) < 0.4 and max(lat) - min(lat) < 0.4""")
def t18_settled_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T18: places that share the name carried are settled by a second feature in the title; those left have to lie together."""
    kind = table(spark, sf, "station_reach").select("station_no", F.get(F.split(F.upper("station"), " "), F.lit(1)).alias("kind"))
    c = candidates(spark, sf).join(kind, "station_no").withColumn("settled", F.contains(F.upper("title"), F.col("kind")))
    folded = c.groupBy("title").agg(F.max("settled").alias("any"), F.collect_list(F.struct("settled", "station_no", "lon", "lat")).alias("x"))  # a title has few candidates
    kept = F.filter("x", lambda p: p["settled"] == F.col("any"))
    spread = lambda n: F.array_max(kept[n]) - F.array_min(kept[n])
    return folded.where((spread("lon") < 0.4) & (spread("lat") < 0.4)).select("title", F.array_min(kept["station_no"]).alias("station_no"), F.size(kept).cast("bigint").alias("n"))


@query("""with t as (select row_id, upper(split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2)) as street from nyc_capital_rows where regexp_matches(title, '^[A-Za-z]+ (Street|Avenue|Road|Lane|Court|Place|STREET|AVENUE|ROAD|LANE|COURT|PLACE) ')) select row_id, street, 'ALDER STREET' as a, 'BIRCH AVENUE' as b from t""")
def t19_extents(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T19: stretches 'X from A to B' out of texts that are written from the streets of the titles."""
    street = F.concat_ws(" ", F.slice(F.split("title", " "), 1, 2))
    rows = table(spark, sf, "nyc_capital_rows").where(F.col("title").rlike(r"^[A-Za-z]+ (Street|Avenue|Road|Lane|Court|Place|STREET|AVENUE|ROAD|LANE|COURT|PLACE) "))
    told = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("Repair of "), street, F.lit(" from Alder Street to Birch Avenue."))).otherwise(F.concat(F.lit("Paving on "), street, F.lit(" between Alder Street and Birch Avenue, phase 2")))
    return rows.select("row_id", F.explode(textparse.extents(told)).alias("e")).select("row_id", "e.*")


@query("""with s as (select mega_project, station, station_no, row_number() over (partition by mega_project order by station_no) as i from station_reach), e as (select mega_project, station, i from s),
p as (select a.mega_project, a.i as lo, b.i as hi from s a join s b on a.mega_project = b.mega_project and b.i = a.i + 3) select p.mega_project as line, p.lo as first_place, s.station_no from p join s on s.mega_project = p.mega_project and s.i between p.lo and p.hi""")
def t20_station_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T20: 'A to B' of a line gives all stations between, in line order; here for every stretch of four. Lines are a fixed table."""
    w = Window.partitionBy("mega_project").orderBy("station_no")
    s = table(spark, sf, "station_reach").select("mega_project", "station", "station_no", F.row_number().over(w).alias("i"), F.lead("station", 3).over(w).alias("end"))
    lines = s.groupBy(F.col("mega_project").alias("line")).agg(F.array_sort(F.collect_list(F.struct("i", "station", "station_no"))).alias("x"))
    told = s.where("end is not null").select(F.col("mega_project").alias("line"), F.col("i").alias("first_place"), F.concat(F.lit("Signals, "), F.upper("station"), F.lit(" to "), F.col("end"), F.lit(" (phase 1)")).alias("t"))
    both = told.join(lines, "line").select("line", "first_place", F.explode(textparse.stretches(F.col("t"), F.col("x.station"))).alias("k"), "x")
    return both.select("line", F.col("first_place").cast("bigint").alias("first_place"), F.element_at("x", F.col("k") + 1)["station_no"].alias("station_no"))


@query("""select regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as proposal_key, count(*) as n from nyc_capital_rows where title is not null group by 1""")
def t22_proposal_key(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T22: a key apart from case and punctuation."""
    return table(spark, sf, "nyc_capital_rows").where("title is not null").groupBy(F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("proposal_key")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""with e as (select line_id, 'p' || regexp_extract(evidence, 'page (\d+)', 1) || ': ' || title || ' | p9: ' || status || ' | seen' as t from mta_lines where evidence is not null), x as (select line_id, unnest(string_split(t, '|')) as x from e)
select line_id, cast(nullif(regexp_extract(x, '^\s*p(\d+):', 1), '') as integer) as page, trim(regexp_replace(x, '^\s*p\d+:', '')) as quote from x where trim(regexp_replace(x, '^\s*p\d+:', '')) <> ''""")
def t23_quote_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """OP-T23: quotes with their pages out of one field."""
    t = F.concat(F.lit("p"), F.regexp_extract("evidence", r"page (\d+)", 1), F.lit(": "), F.col("title"), F.lit(" | p9: "), F.col("status"), F.lit(" | seen"))
    return table(spark, sf, "mta_lines").where("evidence is not null").select("line_id", F.explode(text.fragments(t)).alias("f")).select("line_id", "f.*")


@query(f"""with {IN_TOWN}, {EDGES}, x as (select point_id, boro_cd, count(*) as n from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all) select boro_cd, count(*) as points from x where n % 2 = 1 group by 1""")
def g02_even_odd(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G02: points inside each region by the parity of crossings, holes included."""
    return spatial.inside(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf)).groupBy(F.col("ref_id").alias("boro_cd")).agg(F.count(F.lit(1)).alias("points"))


@query(f"""with {IN_TOWN}, {EDGES}, v as (select point_id, boro_cd, (ax - lon) * cos(radians(lat)) as ax, ay - lat as ay, (bx - lon) * cos(radians(lat)) as bx, by_ - lat as b_y from town cross join edges),
t as (select *, case when (bx - ax) ** 2 + (b_y - ay) ** 2 > 0 then least(1.0, greatest(0.0, -(ax * (bx - ax) + ay * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) else 0.0 end as t from v),
m as (select point_id, boro_cd, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2)) * 6371000.0 * pi() / 180) as d from t group by all),
h as (select boro_cd, point_id from town join edges on (ay > lat) <> (by_ > lat) and lon < ax + (lat - ay) * (bx - ax) / (by_ - ay) group by all having count(*) % 2 = 1)
select point_id, boro_cd, round(case when h.point_id is not null then 0 else d end, 2) as distance_m from m left join h using (point_id, boro_cd) where d <= 400 or h.point_id is not null""")
def g07_polygon_distance(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G07: metres to every region within 400 m, 0 inside."""
    out = places.region_distances(town(spark, sf), F.col("point_id"), F.col("lon"), F.col("lat"), district_edges(spark, sf), 400.0)
    return out.select("point_id", F.col("ref_id").alias("boro_cd"), F.round("distance_m", 2).alias("distance_m"))


@query(f"""with {EDGES}, b as (select borough, boro_cd from ref_community_districts), s as (select borough, sum((ax + 74.0) * (by_ - 40.7) - (bx + 74.0) * (ay - 40.7)) / 2 as a, sum((ax + bx + 148.0) * ((ax + 74.0) * (by_ - 40.7) - (bx + 74.0) * (ay - 40.7))) as mx, sum((ay + by_ - 81.4) * ((ax + 74.0) * (by_ - 40.7) - (bx + 74.0) * (ay - 40.7))) as my from edges join b using (boro_cd) group by 1)
select borough, round(mx / (6 * a) - 74.0, 6) as lon, round(my / (6 * a) + 40.7, 6) as lat, round(abs(a) * pow(6371000.0 * pi() / 180, 2) * cos(radians(my / (6 * a) + 40.7)), 0) as area_m2 from s""")
def g08_borough_areas(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G08, H12: area and centroid of the union of a borough's regions, which do not overlap, from sums over all their edges."""
    names = table(spark, sf, "ref_community_districts").select(F.col("boro_cd").alias("ref_id"), "borough")
    m = geometry.moments(district_edges(spark, sf).join(F.broadcast(names), "ref_id"), "borough")  # a fixed table
    return m.select("borough", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("area_m2", 0).alias("area_m2"))


@query("""select mega_project as line, count(*) as stations from station_reach group by 1""")
def g09_simplified_lines(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G09: at tolerance 0 only points on their chord go: no station is, so each line keeps all of them."""
    lines = table(spark, sf, "station_reach").groupBy(F.col("mega_project").alias("line")).agg(F.array_sort(F.collect_list(F.struct("station_no", "lon", "lat"))).alias("s"))
    path = F.transform("s", lambda x: F.array(x["lon"], x["lat"]))
    return lines.select("line", F.size(geometry.simplify(path, 0.0)).cast("bigint").alias("stations"))


@query("""select point_id, cast(lon as double) as lon, cast(lat as double) as lat from loc_cpdb_points where isfinite(lon) and isfinite(lat)""")
def g10_wkt(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G10: points written as WKT, read as GeoJSON, come back as they were."""
    p = table(spark, sf, "loc_cpdb_points").where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and abs(lon) < double('Infinity') and abs(lat) < double('Infinity')")
    j = p.select("point_id", geometry.from_wkt(F.concat(F.lit("POINT ("), F.col("lon"), F.lit(" "), F.col("lat"), F.lit(")"))).alias("g"))
    at = lambda i: F.get_json_object("g", f"$.coordinates[{i}]").cast("double")
    return j.select("point_id", at(0).alias("lon"), at(1).alias("lat"))


@query(f"""with {LINES}, p as (select a.mega_project as line_a, b.mega_project as line_b, a.position as i, b.position as j, a.ax as ax, a.ay as ay, a.bx as bx, a.b_y as b_y, b.ax as cx, b.ay as cy, b.bx as dx, b.b_y as d_y from line a join line b on a.mega_project < b.mega_project where a.bx is not null and b.bx is not null),
k as (select *, (bx - ax) * (d_y - cy) - (b_y - ay) * (dx - cx) as turn from p), x as (select *, ((cx - ax) * (d_y - cy) - (cy - ay) * (dx - cx)) / turn as t, ((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) / turn as u from k where turn <> 0)
select line_a, line_b, count(*) as crossings, round(sum(ax + t * (bx - ax)), 5) as lon_sum from x where t between 0 and 1 and u between 0 and 1 group by all""")
def g12_line_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G12: where the pieces of two lines cross. Pieces meet in cells, so far pieces are never paired."""
    e = line_edges(spark, sf)
    cell = 0.02
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    binned = e.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    a = binned.select("cx", "cy", F.col("ref_id").alias("line_a"), F.col("position").alias("i"), *(F.col(c).alias(f"a_{c}") for c in ("ax", "ay", "bx", "by")))
    b = binned.select("cx", "cy", F.col("ref_id").alias("line_b"), F.col("position").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ("ax", "ay", "bx", "by")))
    pairs = a.join(b, ["cx", "cy"]).where("line_a < line_b").dropDuplicates(["line_a", "line_b", "i", "j"])
    met = pairs.withColumn("m", geometry.meeting(*(F.col(f"{s}_{c}") for s in "ab" for c in ("ax", "ay", "bx", "by"))))
    return met.where("m.gap = 0").groupBy("line_a", "line_b").agg(F.count(F.lit(1)).alias("crossings"), F.round(F.sum("m.lon"), 5).alias("lon_sum"))


@query(f"""with {EDGES}, box as (select min(least(ax, bx)) as x0, max(greatest(ax, bx)) as x1, min(least(ay, by_)) as y0, max(greatest(ay, by_)) as y1 from edges), p as (select point_id, lon, lat from loc_cpdb_points where isfinite(lon) and isfinite(lat)),
c as (select point_id, lon, lat, least(greatest(lon, x0), x1) as qx, least(greatest(lat, y0), y1) as qy, lon between x0 and x1 and lat between y0 and y1 as held from p cross join box)
select point_id, case when held then 'inside' when {HAV.format(a='lon', b='lat', c='qx', d='qy')} <= 30000 then 'near' else 'far' end as place from c""")
def g17_near_or_far(spark: SparkSession, sf: str) -> DataFrame:
    """OP-G17: inside the box around all regions, within 30 km of it, or farther."""
    e = district_edges(spark, sf)
    box = e.agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"))
    p = spatial._placed(table(spark, sf, "loc_cpdb_points"), F.col("point_id"), F.col("lon"), F.col("lat")).join(F.broadcast(box))  # one row
    held = F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    off = spatial.haversine_m(F.col("lon"), F.col("lat"), F.least(F.greatest("lon", "x0"), "x1"), F.least(F.greatest("lat", "y0"), "y1"))
    return p.select("point_id", F.when(held, "inside").when(off <= 30000, "near").otherwise("far").alias("place"))


@query("""select mega_project as line, count(*) as places, arg_min(station_no, station_no) as first_station from station_reach group by 1""")
def n03_chained_lines(spark: SparkSession, sf: str) -> DataFrame:
    """OP-N03, H18: the pieces between stations, given in no order and either way round and with ends a few metres off, as one chain a
    line. A line's own pieces are a small graph, so each is chained in one call."""
    s = table(spark, sf, "station_reach").select("mega_project", "station_no", "lon", "lat")
    w = Window.partitionBy("mega_project").orderBy("station_no")  # a fixed table
    off = lambda c: F.lead(c).over(w) + F.lit(1e-7)
    pieces = s.select("mega_project", "station_no", F.array(F.array("lon", "lat"), F.array(off("lon"), off("lat"))).alias("p")).where("p[1][0] is not null")
    pieces = pieces.select("mega_project", "station_no", F.when(F.col("station_no") % 2 == 0, F.reverse("p")).otherwise(F.col("p")).alias("p"))
    lines = pieces.groupBy("mega_project").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("station_no").alias("h"), "p"))).alias("x"))
    chain = graph.chain_sizes(F.transform("x", lambda r: r["p"]), 1e-6)
    first = s.groupBy("mega_project").agg(F.min("station_no").alias("first_station"))
    return lines.select("mega_project", chain.alias("places")).join(first, "mega_project").select(F.col("mega_project").alias("line"), "places", "first_station")


_SPELLED = "regexp_replace(split_part(title, ' ', 1) || case row_id % 3 when 0 then ' Third Street' when 1 then '7 Avenue' else ' Tenth Ave' end, '([A-Za-z])([0-9])', '\\1 \\2')"


@query(f"""with n as (select row_id, {_SPELLED} as t from nyc_capital_rows where title is not null), o as (select row_id, regexp_replace(regexp_replace(upper(t), '\\bTHIRD\\b', '3'), '\\bTENTH\\b', '10') as t from n) select row_id, {_street_sql('t')} as street from o""")
def h01_spelled_streets(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H01: glued words parted, ordinal words as numbers, then the street form."""
    t = F.concat(F.split("title", " ")[0], F.when(F.col("row_id") % 3 == 0, " Third Street").when(F.col("row_id") % 3 == 1, "7 Avenue").otherwise(" Tenth Ave"))
    return table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", text.spelled_street(t).alias("street"))


@query(rf"""with r as (select row_id, upper(trim(managing_agency)) as a, upper(trim(sponsor_agency)) as b, regexp_extract(upper(agency_project_name), '^\s*([A-Z]{{2,6}})\s*[-:]\s', 1) as c from project_budget_schedule)
select row_id, array_to_string(list_sort(list_distinct(list_filter([a, b, nullif(c, '')], lambda x: x is not null and x not in ('', '-', '--', 'N/A', 'NULL', 'NONE', 'TBD', 'UNKNOWN')))), ' ') as clients from r""")
def h10_client_agencies(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H10: the agencies that a record is for, from manager, sponsor and the prefix of its title."""
    prefix = F.regexp_extract(F.upper("agency_project_name"), text.AGENCY_PREFIX, 1)
    every = F.array(F.upper(F.trim("managing_agency")), F.upper(F.trim("sponsor_agency")), F.nullif(prefix, F.lit("")))
    kept = F.filter(every, lambda x: x.isNotNull() & ~x.isin("", "-", "--", "N/A", "NULL", "NONE", "TBD", "UNKNOWN"))
    return table(spark, sf, "project_budget_schedule").select("row_id", F.array_join(F.array_sort(F.array_distinct(kept)), " ").alias("clients"))


@query(f"""with w as (select line_id, list_distinct(list_filter({_TOK.format('title')}, lambda x: not list_contains({_COMMON_SQL}, x))) as w from mta_lines where title is not null) select line_id, len(w) > 0 and length(array_to_string(w, '')) >= 5 and not list_bool_and(list_transform(w, lambda x: regexp_full_match(x, '\\d+'))) as admitted from (select line_id, w from w) where true""")
def h11_index_admission(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H11: which names are distinctive enough to be looked up."""
    words = text.distinctive(F.col("title"), COMMON)
    return table(spark, sf, "mta_lines").where("title is not null").select("line_id", F.coalesce(text.admitted(words), F.lit(False)).alias("admitted"))


@query(f"""with s as (select mega_project, station_no, list_filter({_TOK.format("regexp_replace(station, '[0-9]+', '', 'g')")}, lambda x: not list_contains({_COMMON_SQL}, x) and not list_contains({_TOK.format('mega_project')}, x)) as p from station_reach), t as (select row_id, {_TOK.format('title')} as w from nyc_capital_rows where title is not null)
select row_id, mega_project as line, count(*) as stations from t join s on len(p) > 0 and list_has_all(w, p) group by all""")
def h13_stations_on_line(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H13: stations of a line named in a title, the line's own words not counting."""
    s = table(spark, sf, "station_reach").select("mega_project", "station_no", F.array_join(F.array_except(text.tokens(F.regexp_replace("station", "[0-9]+", "")), text.tokens(F.col("mega_project"))), " ").alias("name"))
    titles = table(spark, sf, "nyc_capital_rows").where("title is not null").select("row_id", "title")
    found = text.contained(titles, "row_id", "title", s, "station_no", "name", COMMON)
    return found.join(s.select("station_no", "mega_project"), "station_no").groupBy("row_id", F.col("mega_project").alias("line")).agg(F.count(F.lit(1)).alias("stations"))


@query("""select row_id, case when regexp_matches(title, '(?i)bridge') then 'bridges' when regexp_matches(title, '(?i)pier|depot') then 'terminals' when regexp_matches(title, '(?i)sewer|culvert') then 'drainage' end as named, case borough when 'Manhattan' then 1 when 'Bronx' then 2 when 'Brooklyn' then 3 when 'Queens' then 4 when 'Staten Island' then 5 end as borough_code from nyc_capital_rows""")
def h14_first_named(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H14: the first named thing by pattern, and boroughs by code."""
    t, codes = F.col("title"), F.create_map(*(F.lit(x) for i, b in enumerate(("Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island"), 1) for x in (b, i)))
    named = F.when(t.rlike("(?i)bridge"), "bridges").when(t.rlike("(?i)pier|depot"), "terminals").when(t.rlike("(?i)sewer|culvert"), "drainage")
    return table(spark, sf, "nyc_capital_rows").select("row_id", named.alias("named"), F.try_element_at(codes, F.col("borough")).alias("borough_code"))


@query(f"""with u as (select upper(split_part(station, ' ', 1)) as unit, station_no, lon, lat from station_reach), c as (select unit, min(station_no) as s, count(*) as n from u group by 1), d as (select u.unit, max({HAV.format(a='u.lon', b='u.lat', c='f.lon', d='f.lat')}) as m from u join c using (unit) join station_reach f on f.station_no = c.s group by 1)
select unit, c.s as station_no, n, m <= 6000 as unique_site from c join d using (unit)""")
def h15_unit_index(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H15: a unit's sites as one where none lies farther than a limit from the first."""
    u = table(spark, sf, "station_reach").select(F.upper(F.split("station", " ")[0]).alias("unit"), "station_no", "lon", "lat")
    first = u.groupBy("unit").agg(F.min(F.struct("station_no", "lon", "lat")).alias("f"), F.count(F.lit(1)).alias("n"))
    d = spatial.haversine_m(F.col("lon"), F.col("lat"), F.col("f.lon"), F.col("f.lat"))
    return u.join(first, "unit").groupBy("unit", "f.station_no", "n").agg((F.max(d) <= 6000).alias("unique_site"))


@query(r"""select mega_project, station_no, lpad(cast(radius_m as varchar), 5, '0') || '-' || upper(left(station, 3)) as code, '1' || lpad(cast(station_no as varchar), 3, '0') as key, regexp_extract(station, '(\d+)$', 1) as in_name, regexp_matches(station, '(?i)yard|annex') as annex from station_reach""")
def h22_codes_and_names(spark: SparkSession, sf: str) -> DataFrame:
    """OP-H22: codes built and read: padded numbers, letters of a name, the number in it, a word test."""
    return table(spark, sf, "station_reach").select(
        "mega_project", "station_no", F.concat(F.lpad(F.col("radius_m").cast("string"), 5, "0"), F.lit("-"), F.upper(F.left("station", F.lit(3)))).alias("code"),
        F.concat(F.lit("1"), F.lpad(F.col("station_no").cast("string"), 3, "0")).alias("key"), F.regexp_extract("station", r"(\d+)$", 1).alias("in_name"), F.col("station").rlike("(?i)yard|annex").alias("annex"),
    )


QUERIES, SQL = BOOK.queries, BOOK.sql
