"""Sources and sinks: what is written into the shared folder in each form is read back and compared with the table (OP-S)."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import textparse
from plinth.operators import rules, spatial
from plinth.plans.book import Book
from plinth.session import shared_dir
from plinth.sources import files, paged
from plinth.sources.tables import require_columns, table

BOOK = Book()
query = BOOK.query


def fresh(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/plinth-io/{uuid.uuid4().hex}"


def put(spark: SparkSession, name: str, content: bytes) -> str:
    """A small file in the shared folder, such as a reviewed rule table or an archive."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(content))
    out.close()
    return name


_POINTS = "select point_id, fms_id, lon, lat from loc_cpdb_points where isfinite(lon) and isfinite(lat)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "loc_cpdb_points")
    return spatial._placed(p, F.struct("point_id", "fms_id"), F.col("lon"), F.col("lat")).select("point_id.*", "lon", "lat")


@query(_POINTS)
def s01_csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S01: CSV with its types found by a scan."""
    at = fresh(spark)
    points(spark, sf).write.option("header", True).csv(at)
    return files.read_csv(spark, at)


@query(_POINTS.replace("point_id,", "point_id as id,").replace("lon, lat", "lon as x, lat as y"))
def s02_renamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S02: columns renamed after the scan of a declared form."""
    at = fresh(spark)
    points(spark, sf).write.option("header", True).csv(at)
    return files.read_csv(spark, at, "point_id bigint, fms_id string, lon double, lat double", renamed={"point_id": "id", "lon": "x", "lat": "y"})


@query("select station_no, mega_project, station, radius_m from station_reach")
def s03_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S03: one JSON array of objects; the table is fixed, so the array is one file."""
    at = fresh(spark)
    rows = table(spark, sf, "station_reach").select(F.to_json(F.struct("station_no", "mega_project", "station", "radius_m")).alias("j"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.text(at)
    return files.read_json(spark, at, "station_no int, mega_project string, station string, radius_m int")


@query("select fms_id, lon, lat, count(*) as n from loc_cpdb_points where lon between -75 and -73 and lat between 40 and 42 and fms_id is not null group by all")
def s04_multipoints(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S04: MultiPoint texts, a row for each position inside a box; a text holds about 500 places of a project at most."""
    p = points(spark, sf).where("fms_id is not null")
    sizes = p.groupBy("fms_id").agg(F.ceil(F.count(F.lit(1)) / 500).alias("parts"))
    shapes = p.join(sizes, "fms_id").groupBy("fms_id", F.pmod(F.xxhash64("point_id"), F.col("parts")).alias("part")).agg(F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.collect_list(F.array("lon", "lat")).alias("coordinates"))).alias("g"))
    return files.multipoints(shapes, F.col("g"), -75, 40, -73, 42).groupBy("fms_id", "lon", "lat").agg(F.count(F.lit(1)).alias("n"))


@query("select boro_cd, true as inside from ref_community_districts")
def s05_polygon_labels(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S05: polygons with a label point each, which lies inside its own polygon."""
    d = table(spark, sf, "ref_community_districts")
    labelled = files.polygons(d.select("boro_cd", "geojson"), "geojson")
    held = spatial.inside(labelled, F.col("boro_cd"), F.col("lon"), F.col("lat"), spatial.edges(d, F.col("boro_cd"), F.col("geojson"))).where("ref_id = point_id").select(F.col("point_id").alias("boro_cd"), F.lit(True).alias("inside"))
    return labelled.select("boro_cd").join(held, "boro_cd", "left").select("boro_cd", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("select point_id, lon, lat from loc_cpdb_points where isfinite(lon) and isfinite(lat) and point_id % 3 <> 0")
def s06_unparsed_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S06: rows whose coordinate texts do not parse are left out."""
    text = lambda c: F.when(F.col("point_id") % 3 == 0, F.lit("n/k")).otherwise(F.col(c).cast("string")).alias(c)
    return files.coordinates(points(spark, sf).select("point_id", text("lon"), text("lat")), "lon", "lat")


@query("select station_no, station, residents from station_reach")
def s07_zip_member(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S07: a member with pipes in a ZIP file; made from a fixed table."""
    rows = table(spark, sf, "station_reach").select("station_no", "station", "residents").collect()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("read.me", "x")
        z.writestr("names/all.txt", "﻿Station No|Station|Residents\n" + "\n".join("|".join(map(str, r)) for r in rows))
    at = put(spark, f"{fresh(spark)}/names.zip", held.getvalue())
    out = files.read_zip_member(spark, at, r"all\.txt$")
    return out.select(F.col("station_no").cast("int").alias("station_no"), "station", F.col("residents").cast("int").alias("residents"))


@query("select row_id, fms_id, period, budget, phase from project_history")
def s08_declared_lines(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S08: JSON lines read with declared columns."""
    at = fresh(spark)
    table(spark, sf, "project_history").select("row_id", "fms_id", "period", "budget", "phase").write.json(at)
    return files.read_json(spark, at, "row_id bigint, fms_id string, period int, budget double, phase string", array=False)


_RULES = [("roof|facade", "building"), ("sewer|culvert", "water"), ("street", "street")]


@query("select row_id, case when regexp_matches(title, '(?i)roof|facade') then 1 when regexp_matches(title, '(?i)sewer|culvert') then 2 when regexp_matches(title, '(?i)street') then 3 end as rule_no from nyc_capital_rows")
def s09_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S09: a rule table from CSV, its order kept, applied to records."""
    at = put(spark, f"{fresh(spark)}/rules.csv", ("pattern,label\n" + "\n".join(f'"(?i){p}",{n}' for p, n in _RULES)).encode())
    listed = files.read_rules(spark, at, "pattern string, label string")
    return rules.first_match(table(spark, sf, "nyc_capital_rows").select("row_id", "title"), ["row_id"], "title", listed).select("row_id", "rule_no")


@query("select form, station_no, station from station_reach cross join (values ('csv'), ('list'), ('export')) f(form)")
def s10_release_forms(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S10: one release as CSV, as a JSON list, and as an export with column metadata; a fixed table."""
    rows, at = table(spark, sf, "station_reach").select("station_no", "station").collect(), fresh(spark)
    alias = {"station_no": ["station_number"], "station": ["stop_name"]}
    made = {
        "csv": put(spark, f"{at}/a.csv", ("Station Number,Stop Name\n" + "\n".join(f"{r[0]},{r[1]}" for r in rows)).encode()),
        "list": put(spark, f"{at}/b.json", json.dumps([{"station_no": r[0], "stop_name": r[1]} for r in rows]).encode()),
        "export": put(spark, f"{at}/c.json", json.dumps({"meta": {"view": {"columns": [{"name": "x", "fieldName": "station_number"}, {"name": "Station"}]}}, "data": [[str(r[0]), r[1]] for r in rows]}).encode()),
    }
    parts = [files.read_release(spark, path, alias).select(F.lit(form).alias("form"), F.col("station_no").cast("int").alias("station_no"), "station") for form, path in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select row_id, fms_id as project, total_budget as budget, cast(null as varchar) as sponsor_code from project_budget_schedule")
def s11_column_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S11: columns by the first of their names that is there; a name that no era has is null."""
    return files.canonical(table(spark, sf, "project_budget_schedule"), {"row_id": [], "project": ["fmsid", "fms_id"], "budget": ["total_budget", "spend_to_date"], "sponsor_code": ["sponsor_no"]})


@query("select station_no, station, residents as residents_2 from station_reach")
def s12_clean_headers(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S12: headers in small letters without marks; equal ones are numbered."""
    rows = table(spark, sf, "station_reach").select("station_no", "station", "radius_m", "residents")
    return files.clean_names(rows.toDF("﻿Station No", " STATION ", "Residents", "residents")).select("station_no", "station", "residents_2")


def pages_of(spark: SparkSession, sf: str, pages: int) -> str:
    """The stations, a fixed table, as pages of JSON lines in the shared folder; the template of their addresses."""
    rows = [r.asDict() for r in table(spark, sf, "station_reach").select("station_no", "mega_project", "residents").collect()]
    at = fresh(spark)
    for i in range(pages):
        put(spark, f"{at}/{i}.json", "\n".join(json.dumps(r) for r in rows[i::pages]).encode())
    return (at if "://" in at or at.startswith("file:") else f"file://{at}") + "/{page}.json"


@query("select station_no, mega_project from station_reach where mega_project = 'Northern Spur'")
def s13_paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S13: pages of a source, one a task, asked for two columns and one value."""
    return paged.read_pages(spark, pages_of(spark, sf, 5), 5, "station_no int, mega_project string", ("mega_project", "Northern Spur"))


@query("select station_no, residents from station_reach")
def s17_retried_pages(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S17: pages that fail twice before they come."""
    return paged.read_pages(spark, pages_of(spark, sf, 3), 3, "station_no int, residents int", failsFirst=2)


@query("select l_suppkey, year(l_shipdate) * 100 + month(l_shipdate) as month, sum(l_linenumber) as n from lineitem group by all")
def s14_summed_at_source(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S14: a large source summed where it lies: only sums are shuffled."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("month")).agg(F.sum("l_linenumber").alias("n"))


@query("select * from (values ('same', true), ('other size', false), ('new column wanted', false), ('never read', false)) t(source, is_current)")
def s15_unchanged_source(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S15: is a source as its manifest says, so that it need not be read again?"""
    held = {"version": "v1", "bytes": 10, "columns": table(spark, sf, "region").columns}
    cases = {"same": (held, {"version": "v1", "bytes": 10}, ["r_name"]), "other size": (held, {"version": "v1", "bytes": 11}, []), "new column wanted": (held, {"version": "v1", "bytes": 10}, ["r_area"]), "never read": ({}, {"version": "v1", "bytes": 10}, [])}
    return spark.createDataFrame([(k, files.is_current(*v)) for k, v in cases.items()], "source string, is_current boolean")


@query("select * from (values ('region', ''), ('nation', 'missing columns: n_area; there are n_name, n_nationkey, n_regionkey')) t(source, problem)")
def s16_required_columns(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S16: a missing column stops a source before any work."""
    out = []
    for name, wanted in (("region", ["r_name"]), ("nation", ["n_name", "n_area"])):
        df = table(spark, sf, name)
        try:
            require_columns(df.select(*sorted(df.columns)), *wanted)
            out.append((name, ""))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "source string, problem string")


@query("select * from (values ('other order', true), ('a row less', false), ('a value changed', false)) t(version, same)")
def s18_version_digest(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S18: does a version hold the same content, whatever its row order?"""
    s = table(spark, sf, "station_reach")
    whole = files.digest(s)
    versions = {"other order": s.orderBy(F.desc("station_no")), "a row less": s.where("station_no > 1"), "a value changed": s.withColumn("residents", F.when(F.col("station_no") == 7, -1).otherwise(F.col("residents")))}
    return spark.createDataFrame([(k, files.digest(v) == whole) for k, v in versions.items()], "version string, same boolean")


@query("select mega_project as document, station as label, cast(residents as varchar) as first_line, 2 as lines from station_reach")
def s19_labelled_records(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S19: lines of documents under the label before them."""
    s = table(spark, sf, "station_reach")
    cells = F.array(F.concat(F.lit("## "), F.col("station")), F.col("residents").cast("string"), F.lit("end"))
    lines = s.select(F.col("mega_project").alias("document"), "station_no", F.posexplode(cells).alias("i", "text")).select("document", (F.col("station_no") * 10 + F.col("i")).alias("no"), "text")
    out = textparse.labelled_records(lines, "document", "no", "text", r"^## (.*)$")
    return out.select("document", "label", F.col("lines")[0].alias("first_line"), F.size("lines").alias("lines"))


@query("select '| ' || r_regionkey || ' | ' || r_name || ' |' as line from region union all select '| r_regionkey | r_name |' union all select '|---|---|'")
def s21_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S21: a report in Markdown, line by line."""
    text = files.markdown(table(spark, sf, "region").select("r_regionkey", "r_name"))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("select row_id, fms_id, title, budget from nyc_capital_rows where fms_id is not null")
def s22_sorted_csv(spark: SparkSession, sf: str) -> DataFrame:
    """OP-S22: rows for review as CSV in the order of their keys, read back."""
    at = fresh(spark)
    files.write_csv(table(spark, sf, "nyc_capital_rows").where("fms_id is not null").select("row_id", "fms_id", "title", "budget"), at, ["fms_id", "row_id"])
    return files.read_csv(spark, at, "row_id bigint, fms_id string, title string, budget double")


QUERIES, SQL = BOOK.queries, BOOK.sql
