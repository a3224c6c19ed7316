"""Readers and writers of files (OP-S01..S12, S15, S18, S20..S22, H03)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import geometry
from plinth.functions.values import fingerprint

#: What a null is while a CSV is read. Spark takes texts equal to it for null; its default, the empty text, would make "" null too.
_NULL = f"null {uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, separator: str = ",", renamed: Mapping[str, str] | None = None) -> DataFrame:
    """OP-S01, S02: CSV with a header. A schema in DDL form is the rule; without one, types are inferred (for exploration).
    A field without characters is null; "" is an empty text, and null in a column that is no text."""
    reader = spark.read.option("header", True).option("nullValue", _NULL).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    df = reader.schema(schema).option("enforceSchema", False).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumnsRenamed(dict(renamed or {}))


def read_json(spark: SparkSession, path: str | list[str], schema: str, array: bool = True) -> DataFrame:
    """OP-S03: a JSON array of objects in a file, or one object a line; fields that a row lacks are null."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def clean_name(name: str) -> str:
    """OP-S12: a header as a field name: no byte-order mark, lower case, runs of other characters as one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.replace("\ufeff", "").strip().lower()).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    """OP-S12. Names that come out equal are numbered in their order."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = clean_name(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def canonical(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """OP-S11: one logical column from the first of its historical names that is there (the first present, not the first non-null)."""
    found = {name: next((a for a in [name, *alts] if a in df.columns), None) for name, alts in aliases.items()}
    return df.select(*(F.col(f"`{a}`").alias(n) if a else F.lit(None).cast("string").alias(n) for n, a in found.items()))


def read_release(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """OP-S10: a release as CSV, as a JSON list, or as an export object with column metadata and row arrays."""
    if path.lower().endswith(".csv"):
        return canonical(clean_names(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)), aliases)
    raw = spark.read.text(path, wholetext=True)
    head = raw.select(F.get_json_object("value", "$.meta.view.columns").alias("m")).first()
    if head is not None and head.m:
        names = [c.get("fieldName") or c["name"] for c in json.loads(head.m)]
        rows = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.data"), "array<array<string>>")).alias("r"))
        df = rows.select(*(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)))
    else:
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return canonical(clean_names(df), aliases)


def read_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """OP-S09: a reviewed rule table with its order as rule_no; a file written by hand, read as one part so that order holds."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path).coalesce(1)
    return df.withColumn("rule_no", (F.monotonically_increasing_id() + 1).cast("int"))


def read_zip_member(spark: SparkSession, path: str, member: str, separator: str = "|") -> DataFrame:
    """OP-S07: a delimited member of ZIP files, each file unpacked in the task that reads it; all columns are text."""
    import io
    import zipfile

    def lines(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    text = z.read(next(n for n in z.namelist() if re.search(member, n))).decode("utf-8-sig")
                rows = text.splitlines()
                yield pd.DataFrame({"header": rows[0] if rows else "", "line": rows[1:]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "header string, line string")
    head = raw.select("header").first()
    names = [clean_name(c) for c in head.header.split(separator)] if head else []
    parts = F.split("line", re.escape(separator), -1)
    return raw.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def multipoints(df: DataFrame, geojson: Column, west: float, south: float, east: float, north: float) -> DataFrame:
    """OP-S04, S06: one row per position of Point and MultiPoint texts inside a box; other rows are left out."""
    at = F.get_json_object(geojson, "$.coordinates")
    one = F.get_json_object(geojson, "$.type") == "Point"
    positions = F.when(one, F.array(F.from_json(at, "array<double>"))).otherwise(F.from_json(at, "array<array<double>>"))
    spread = df.select("*", F.explode(positions).alias("_p")).withColumns({"lon": F.get("_p", F.lit(0)), "lat": F.get("_p", F.lit(1))}).drop("_p")
    return spread.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def polygons(df: DataFrame, geojson: str) -> DataFrame:
    """OP-S05: polygon rows with a label point (lon, lat) beside the geometry text; rows without a shape are left out."""
    placed = df.withColumn("_p", geometry.label_point(geojson))
    return placed.select(*df.columns, F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat")).where("lon is not null")


def coordinates(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """OP-S06: rows whose coordinate texts parse, as doubles."""
    return df.withColumns({lon: F.col(lon).try_cast("double"), lat: F.col(lat).try_cast("double")}).where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def is_current(manifest: Mapping, source: Mapping, required: Sequence[str] = ()) -> bool:
    """OP-S15: has a source its recorded version and size, and all the columns asked for? Then it need not be read again."""
    return all(manifest.get(k) == source.get(k) for k in ("version", "bytes")) and manifest.get("version") is not None and set(required) <= set(manifest.get("columns", ()))


def digest(df: DataFrame) -> str:
    """OP-S18: an order-independent digest of a table's content; one row comes to the driver."""
    h = fingerprint(*(F.col(f"`{c}`") for c in df.columns))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("second"), h).cast("decimal(38,0)")).alias("b")).first()
    return f"{r.n}:{r.a}:{r.b}"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """The native format. Partition columns are hashed to tasks first, so that a partition is not spread over as many files as tasks;
    rows are split within it by a further hash, for hot partitions."""
    if partition_by:
        spread = F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))
        df = df.repartition(*map(F.col, partition_by), spread)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def features(df: DataFrame, lon: str, lat: str, properties: Sequence[str], digits: int = 5) -> DataFrame:
    """OP-S20: one GeoJSON feature text per row; null properties are left out."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, digits), F.round(lat, digits)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_features(df: DataFrame, path: str) -> None:
    """OP-S20: features, one a line (newline-delimited GeoJSON), written by all tasks."""
    df.write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, manifest: str | None = None) -> dict:
    """OP-S20: compact JSON lines, and a manifest of fields and rows."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)
    entry = {"fields": df.columns, "rows": df.sparkSession.read.text(path).count()}
    if manifest:
        df.sparkSession.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return entry


def write_csv(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """OP-S22: CSV sorted by key, for review; range-sorted parts, in the order of their names. An empty text is "", null is nothing."""
    df.orderBy(*key).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """OP-S21: a report table in Markdown; a report is read by people, so more rows than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda v: "" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])
