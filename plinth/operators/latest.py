"""Latest records, latest values and deduplicated totals (OP-A03..A05, A09, A13, A30, A31, A34, P06..P08, W01, W05, W12, W16, W22).

Latest rows are taken by a maximum over a struct, which is combined before the shuffle and needs no sort; the structs end in a
tie-break, so that every result is the same in every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """OP-P08, W05, O03: the row of each key with the greatest order, nulls least. order has to end in a unique column."""
    columns = [c for c in (columns or df.columns) if c not in keys]
    picked = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *(F.col(c) for c in columns))
    return df.groupBy(*keys).agg(F.max(picked).alias("_m")).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in columns))


def last_value(value: Column, order: Sequence[Column]) -> Column:
    """OP-A04: the value of the greatest order among the rows that have one (aggregate)."""
    return F.max(F.when(value.isNotNull(), F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), value.alias("_v"))))["_v"]


def first_value(value: Column, order: Sequence[Column]) -> Column:
    """OP-A13, W12: the value of the least order among the rows that have one (aggregate)."""
    return F.min(F.when(value.isNotNull(), F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), value.alias("_v"))))["_v"]


def in_last_snapshot(df: DataFrame, period: str) -> DataFrame:
    """OP-P07: rows of the one latest snapshot of the whole table; the maximum is a scalar and is joined as one row."""
    top = df.agg(F.max(period).alias("_top"))
    return df.join(F.broadcast(top), F.col(period) == F.col("_top")).drop("_top")


def deduplicated_totals(df: DataFrame, entity: str, part: str, period: str, value: Column) -> DataFrame:
    """OP-A03: rows (entity, period, n_parts, total) at each entity's last period.

    A value repeats over the rows of one (entity, part, period), so the greatest of them is taken once; the parts of the last
    period of the entity are added up. Rows are brought down to one a part and period, combined before their shuffle, and then shuffled
    once more by entity, which serves both steps that follow.
    """
    record = df.groupBy(entity, part, period).agg(F.max(value).alias("_v")).repartition(entity)
    per_period = record.groupBy(entity, period).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("_v").alias("total"))
    top = F.coalesce(period, F.lit(-(1 << 31)).cast(df.schema[period].dataType))  # a null period comes first
    last = [F.max_by(F.struct(period, "n_parts", "total"), top).alias("_m")]
    return per_period.groupBy(entity).agg(*last).select(entity, f"_m.{period}", "_m.n_parts", "_m.total")


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """OP-A34: the most frequent non-null value of each key, the least one of equals: rows (keys..., value, n)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("_n"), F.col(value).alias("_v"))).alias("_m")).select(*keys, F.col("_m._v").alias(value), (-F.col("_m._n")).alias("n"))


def max_if_all(value: Column) -> Column:
    """OP-A09: the greatest value, but only when every row has one (aggregate)."""
    return F.when(F.bool_and(value.isNotNull()), F.max(value))
