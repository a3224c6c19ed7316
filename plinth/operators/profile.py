"""Column-level data quality from maintained value-count tables.

`counts_of` gives the value-count table of a column: one row per load and distinct value with its signed number of rows.
`apply_deltas` adds the deltas of further loads (or, with sign -1, takes a withdrawn load back) to a maintained table and drops
what has come to nothing. Everything else is derived from counts alone: null rates, distinct counts, ranges, entropy, exact
medians, ill-formed values, and what differs from the load before. `CountStore` keeps such a table in the shared folder.

A value-count table has the columns (column_name, load, value, number, n): value is the value as text, number its number where
it has one. Exact order statistics are those of plinth.operators.ranks over the counts, so no load is ever gathered in one task.

Defined results: nulls are a value of their own; rows without a load belong to none; a load of nulls only has rate 1, no range
and no median; NaN and infinities count as values and never as finite numbers; an empty table has no loads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.values import finite
from plinth.operators import ranks
from plinth.operators.store import Files, Store


def counts_of(df: DataFrame, columns: dict[str, tuple[Column, Column | None]], load: Column, sign: int = 1) -> DataFrame:
    """Value-count rows of several columns in one pass and one shuffle. columns: name -> (value, number or None)."""
    cells = F.array(*(
        F.struct(F.lit(name).alias("column_name"), value.cast("string").alias("value"), (number if number is not None else F.lit(None)).cast("double").alias("number"))
        for name, (value, number) in columns.items()
    ))
    rows = df.select(load.cast("bigint").alias("load"), F.explode(cells).alias("c")).where("load is not null")
    return rows.groupBy("c.column_name", "load", "c.value", "c.number").agg((F.count(F.lit(1)) * sign).alias("n"))


def apply_deltas(*tables: DataFrame, alone: bool = False) -> DataFrame:
    """A maintained value-count table and the signed deltas of loads, added up; values that come to nothing leave. alone: a single
    table may hold several deltas, so it is added up too."""
    if len(tables) == 1 and not alone:
        return tables[0]
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy("column_name", "load", "value", "number").agg(F.sum("n").alias("n")).where("n != 0")


class CountStore(Store):
    """A maintained value-count table in the shared folder, a bucket for each column and load. Deltas read and write the buckets of
    their own columns and loads only; a bucket that comes to nothing leaves."""

    SHAPE = "column_name string, load bigint, value string, number double, n bigint"

    def counts(self, *columns: str) -> DataFrame:
        """The counts of some columns, or of all."""
        m = self.manifest()
        held = m["tables"].get("counts", {"buckets": {}})["buckets"]
        some = [b for b in held if not columns or b.rpartition("-")[0] in columns]
        found = self.read("counts", some, m) if some else None
        return self.spark.createDataFrame([], self.SHAPE) if found is None else found

    def apply(self, *deltas: DataFrame, sources: dict[str, Files] | None = None) -> None:
        """Add signed deltas in one commit. They are written first, so that each is computed once and names its buckets."""
        before = self.manifest()
        held = before["tables"].get("counts", {"buckets": {}})["buckets"]
        bucket = F.concat_ws("-", "column_name", F.col("load").cast("string"))
        shaped = [d.select(F.col("column_name"), F.col("load").cast("bigint"), "value", F.col("number").cast("double"), F.col("n").cast("bigint")) for d in deltas]
        new = self.write(reduce(DataFrame.unionByName, shaped).withColumn("bucket", bucket)) if shaped else {}
        hit = sorted(new)
        if len(deltas) > 1 or any(b in held for b in hit):
            parts = [self.written(self.SHAPE, new), self.read("counts", hit, before)] if hit else []
            new = self.write(apply_deltas(*(p for p in parts if p is not None), alone=True).withColumn("bucket", bucket)) if hit else {}
        self.commit(before, {"counts": (self.SHAPE, new, hit)}, sources)


def metrics(counts: DataFrame) -> DataFrame:
    """Rows (column_name, load, n_rows, n_null, null_rate, n_distinct, least, most, low, high, entropy): the profile of each load.

    least and most are the ends of the values as text, low and high those of the finite numbers; entropy is in bits, over all
    non-null values.
    """
    known = F.col("value").isNotNull()
    number = finite(F.col("number"))
    n = F.col("n").cast("double")
    folded = counts.groupBy("column_name", "load").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"), F.count(F.when(known, 1)).alias("n_distinct"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.sum(F.when(known, n)).alias("_s"), F.sum(F.when(known, n * F.log2(n))).alias("_nlogn"),
    )
    entropy = F.when(F.col("_s") > 0, F.greatest(F.lit(0.0), F.log2("_s") - F.col("_nlogn") / F.col("_s")))
    return folded.withColumns({"null_rate": F.col("n_null") / F.col("n_rows"), "entropy": entropy}).drop("_s", "_nlogn")


def medians(counts: DataFrame) -> DataFrame:
    """Rows (column_name, load, median): the exact median of each load; an even number of rows has the mean of its two middle ones."""
    middle = ranks.at(counts, ["column_name", "load"], F.col("number"), ranks.middle, F.col("n"))
    return middle.groupBy("column_name", "load").agg((F.sum(F.col("x") * F.col("hits")) / F.sum("hits")).alias("median"))


def against_before(per_load: DataFrame, value: str) -> DataFrame:
    """per_load (column_name, load, ...) with `before`, the value of the column's load before; the first loads drop out."""
    w = Window.partitionBy("column_name").orderBy("load")
    both = per_load.withColumns({"before": F.lag(value).over(w), "_i": F.row_number().over(w)})
    return both.where("_i > 1").drop("_i")


def share_shifts(counts: DataFrame, shift: float) -> DataFrame:
    """Rows (column_name, load) of loads in which some non-null value's share of all rows differs by more than `shift`.

    The counts of a load are laid beside those of the load before in one aggregation by value; absent values have share 0.
    """
    totals = counts.groupBy("column_name", "load").agg(F.sum("n").alias("rows"))
    w = Window.partitionBy("column_name").orderBy("load")
    loads = totals.withColumns({"next_load": F.lead("load").over(w), "is_first": F.row_number().over(w) == 1})
    share = F.col("n") / F.col("rows")
    sides = counts.where("value is not null").join(F.broadcast(loads), ["column_name", "load"]).select(
        "column_name", "value", share.alias("share"),
        F.explode(F.array(
            F.when(~F.col("is_first"), F.struct(F.col("load").alias("at"), F.lit(1).alias("sign"))),
            F.when(F.col("next_load").isNotNull(), F.struct(F.col("next_load").alias("at"), F.lit(-1).alias("sign"))),
        )).alias("s"),
    ).where("s is not null")
    moved = sides.groupBy("column_name", F.col("s.at").alias("load"), "value").agg(F.sum(F.col("share") * F.col("s.sign")).alias("d"))
    return moved.where(F.abs("d") > shift).select("column_name", "load").distinct()
