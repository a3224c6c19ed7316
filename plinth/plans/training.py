"""Queries of the general training-data operators over this project's tables (problems 1, 2, 4, 5 and 7)."""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.values import cents, day_of_text, finite, present, squeezed
from plinth.plans import training_sql
from plinth.operators import history, packed, profile, snapshots, spatial
from plinth.operators.store import Files, OvertakenError, Store, files_of, kept_at, news
from plinth.session import small
from plinth.sources.tables import table


def boards(spark: SparkSession, sf: str) -> frozenset[str]:
    """Citywide, the boroughs, and the boroughs with the two-digit numbers of their districts: 59 rows of a fixed table."""
    found = table(spark, sf, "ref_community_districts").select("borough", "district").collect()
    return frozenset({"Citywide"} | {r.borough for r in found} | {f"{r.borough} {r.district:02d}" for r in found})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by the dictionary that their own quoted values make, boards by the fixed table of districts."""
    lines, projects = table(spark, sf, "mta_lines"), table(spark, sf, "project_budget_schedule")
    dictionary = packed.learned(lines, F.col("labels"), packed.LABELS)
    known = packed.with_known(packed.BOARDS, boards(spark, sf))
    a = packed.items(lines, F.col("line_id"), F.col("labels"), packed.LABELS, 2, dictionary).select(F.lit("mta_lines").alias("table_name"), "*")
    b = packed.items(projects, F.col("row_id"), F.col("community_board"), known, 2).select(F.lit("project_budget_schedule").alias("table_name"), "*")
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "project_budget_schedule")
    return snapshots.changes(
        df,
        {"fms_id": F.col("fms_id"), "pid": F.coalesce("pid", F.lit(-1).cast("bigint"))},
        F.col("reporting_period"),
        [cents(F.col("total_budget")), squeezed(F.col("current_phase")), F.to_date("forecast_completion")],
        [F.col("loaded_at"), F.col("row_id")],
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    points, stations, districts = (table(spark, sf, t) for t in ("loc_cpdb_points", "station_reach", "ref_community_districts"))
    at = F.col("point_id"), F.col("lon"), F.col("lat")
    reach = spatial.near(points, *at, stations, F.col("station_no"), F.col("lon"), F.col("lat"), F.col("radius_m"))
    within = spatial.inside(points, *at, spatial.edges(districts, F.col("boro_cd"), F.col("geojson")))
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("ref_id").cast("bigint").alias("ref_id"), "point_id")
    return pick(reach, "reach").unionByName(pick(within, "district"))


EXACT, KEPT = ("budget",), ("phase", "forecast_completion")


def _project_values() -> dict[str, Column]:
    return {"budget": cents(F.col("budget")), "phase": squeezed(present(F.col("phase"))), "forecast_completion": day_of_text(F.col("forecast_completion"))}


def project_rows(raw: DataFrame) -> DataFrame:
    """What counts of deliveries of project_history: the last row of each project and period."""
    return history.last_delivered(raw, F.col("fms_id"), F.col("period"), [F.col("loaded_at"), F.col("row_id")], _project_values())


def late_from(period: Column) -> Column:
    """The end of the month in which a period's report is due; what is delivered later is late or a correction."""
    month = F.make_date(F.floor(period / 100).cast("int"), (period % 100).cast("int"), F.lit(1))
    return F.add_months(month, 1).cast("timestamp_ntz")


def _refreshed(store: Store, tables: dict[str, DataFrame]) -> tuple[dict[str, list[str] | None], dict[str, Files]]:
    """What a store has not taken in of its source tables: per table the new files (None: all anew), and the files to note."""
    seen = store.manifest()["sources"]
    now = {name: files_of(df) for name, df in tables.items()}
    return {name: news(seen[name], f) if name in seen else None for name, f in now.items() if seen.get(name) != f}, {n: f for n, f in now.items() if seen.get(n) != f}


def _once_more(refresh):
    """A refresh that loses to another writer looks again: what it wanted to bring in is there then, or comes on top."""

    @wraps(refresh)
    def run(*args):
        for _ in range(3):
            try:
                return refresh(*args)
            except OvertakenError:
                continue
        return refresh(*args)

    return run


@_once_more
def history_store(spark: SparkSession, sf: str) -> history.HistoryStore:
    """The kept chains of project_history, brought up to date.

    At first the on-time deliveries make the chains, and the late ones, which are the corrections, go in as a delivery of their own.
    Later, new files are deliveries; a file that has gone or changed makes the store anew.
    """
    raw = table(spark, sf, "project_history")
    found = files_of(raw)
    buckets = max(16, sum(size for size, _ in found.values()) >> 26)  # by 64 MB of source files
    store = history.HistoryStore(spark, kept_at(spark, "history", sf, *_project_values().values()), EXACT, KEPT, buckets)
    wanted, sources = _refreshed(store, {"project_history": raw})
    if "project_history" not in wanted:
        return store
    if (new := wanted["project_history"]) is not None:
        store.deliver(project_rows(spark.read.schema(raw.schema).parquet(*new)), sources)
        return store
    late = F.coalesce(F.col("loaded_at") >= late_from(F.col("period")), F.lit(False))
    store.create(project_rows(raw.where(~late)))
    store.deliver(project_rows(raw.where(late)), sources)
    return store


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The chains as the store holds them."""
    chains = history_store(spark, sf).chains()
    if chains is None:
        return table(spark, sf, "project_history").limit(0).select("fms_id", F.col("period").alias("valid_from"), F.col("period").alias("valid_to"))
    return chains.select(F.col("entity").alias("fms_id"), "valid_from", "valid_to")


def p4_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The points that lie exactly on an edge or corner of a district, and whether the district holds them (see spatial.inside)."""
    points, districts = table(spark, sf, "loc_cpdb_points"), table(spark, sf, "ref_community_districts")
    sides = spatial.edges(districts, F.col("boro_cd"), F.col("geojson"))
    # Beside the stored points, the corners of the districts themselves, under ids below zero: all of them lie on edges.
    corners = sides.groupBy("ax", "ay").agg(F.min("ref_id").alias("r")).select((-F.pmod(F.xxhash64("ax", "ay"), F.lit(1 << 40)) - 1).alias("point_id"), F.col("ax").alias("lon"), F.col("ay").alias("lat"))
    every = points.select("point_id", "lon", "lat").unionByName(corners)
    met = spatial.inside(every, F.col("point_id"), F.col("lon"), F.col("lat"), sides, touching=True).where("on_edge")
    at = every.select("point_id", "lon", "lat").distinct()
    return met.join(at, "point_id").select(F.col("ref_id").alias("boro_cd"), "lon", "lat", "held").distinct()


#: What ill-formed means in numbers and dates.
SPEND_RANGE = (0.0, 5_000_000_000.0)
DATE_RANGE = ("1990-01-01", "2060-12-31")
SHIFT, FACTOR = 0.15, 5.0


#: The profiled columns: table -> column -> (value, number); dates have their day as number.
PROFILED = {
    "project_budget_schedule": {c: (F.col, None) for c in ("community_board", "borough")},
    "budget_spend_by_fy": {"spend": (F.col, F.col)},
    "schedule_history": {"completion_date": (F.col, lambda c: F.unix_date(F.to_date(c)))},
}
SOURCE = {c: t for t, cs in PROFILED.items() for c in cs}


def columns_of(columns: dict) -> list[Column]:
    return [f(c) for c, fs in columns.items() for f in fs if f]


def value_counts(df: DataFrame, name: str, sign: int = 1) -> DataFrame:
    """The signed value counts of rows of a profiled table."""
    columns = {c: (value(c), number(c) if number else None) for c, (value, number) in PROFILED[name].items()}
    return profile.counts_of(df, columns, F.col("reporting_period"), sign)


@_once_more
def count_store(spark: SparkSession, sf: str) -> profile.CountStore:
    """The kept value counts of the profiled columns, brought up to date in one commit: new files come in as plus; where a file has gone
    or changed, what is held of its table goes out as minus and the table comes in as plus."""
    made = [c for columns in PROFILED.values() for c in columns_of(columns)]
    store = profile.CountStore(spark, kept_at(spark, "counts", sf, *made))
    tables = {name: table(spark, sf, name) for name in PROFILED}
    wanted, sources = _refreshed(store, tables)
    deltas = []
    for name, new in wanted.items():
        if new is not None:
            deltas.append(value_counts(spark.read.schema(tables[name].schema).parquet(*new), name))
            continue
        if name in store.manifest()["sources"]:
            deltas.append(store.counts(*PROFILED[name]).withColumn("n", -F.col("n")))
        deltas.append(value_counts(tables[name], name))
    if deltas:
        store.apply(*deltas, sources=sources)
    return store


def p7_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of every load, from the kept counts: rates, distinct counts, ranges and entropy. Numbers and days have their range as
    numbers (days since 1970), texts as text."""
    found = profile.metrics(count_store(spark, sf).counts())
    text = F.col("low").isNull()
    return found.select(
        "column_name", "load", "n_rows", "n_null", F.round("null_rate", 6).alias("null_rate"), "n_distinct", "low", "high",
        F.when(text, F.col("least")).alias("least"), F.when(text, F.col("most")).alias("most"), F.round("entropy", 4).alias("entropy"),
    )


def ill_formed(counts: DataFrame, known: frozenset[str]) -> DataFrame:
    """Rows (column_name, value) of the values that are ill-formed: each is judged once, however many rows hold it."""
    boroughs = sorted(b for b in known if not b[-1].isdigit())
    name, number = F.col("column_name"), F.col("number")
    first, last = (F.unix_date(F.to_date(F.lit(x))) for x in DATE_RANGE)
    odd = (
        ((name == "borough") & ~F.col("value").isin(*boroughs))
        | ((name == "spend") & (finite(number).isNull() | ~number.between(*SPEND_RANGE)))
        | ((name == "completion_date") & ~number.between(first, last))
        | ((name == "community_board") & ~F.col("value").isin(*sorted(known)))
    )
    values = counts.where(F.col("value").isNotNull() & odd).select("column_name", "value").distinct()
    plain = values.where(name != "community_board")
    boards = packed.items(values.where(name == "community_board"), F.col("value"), F.col("value"), packed.with_known(packed.BOARDS, known))
    boards = boards.where(~F.col("item").isin(*sorted(known))).select(F.lit("community_board").alias("column_name"), F.col("row_key").alias("value")).distinct()
    return plain.unionByName(boards)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong in the loads. All is told from the kept counts; the tables are read only to look up the rows of ill-formed values."""
    counts = count_store(spark, sf).counts()
    named = F.create_map(*(F.lit(x) for kv in SOURCE.items() for x in kv))

    def shown(df: DataFrame, kind: str, ref: str = "load") -> DataFrame:
        name = F.col("column_name")
        return df.select(named[name].alias("table_name"), name.alias("column_name"), F.lit(kind).alias("kind"), F.col(ref).cast("bigint").alias("ref_id"))

    odd = small(ill_formed(counts, boards(spark, sf)))
    bad = []
    for name, columns in PROFILED.items():
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
        rows = table(spark, sf, name).select("row_id", F.explode(cells).alias("c")).select("row_id", "c.*").where("value is not null")
        bad.append(rows.join(odd, ["column_name", "value"], "left_semi"))
    ill = shown(reduce(DataFrame.unionByName, bad), "bad_value", "row_id")

    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    rates = profile.against_before(counts.groupBy("column_name", "load").agg((missing / F.sum("n")).alias("rate")), "rate")
    rates = rates.where(F.abs(F.col("rate") - F.col("before")) > SHIFT)
    shares = profile.share_shifts(counts.where("column_name = 'borough'"), SHIFT)
    middle = profile.against_before(profile.medians(counts.where("column_name = 'spend'")), "median")
    apart = (F.col("median") > FACTOR * F.col("before")) | (F.col("before") > FACTOR * F.col("median"))
    return reduce(DataFrame.unionByName, (ill, shown(rates, "null_rate"), shown(shares, "value_share"), shown(middle.where(apart), "median")))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p4_edges, p5_found, p7_found, p7_profile)}
SQL = training_sql.SQL
