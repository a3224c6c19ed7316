"""Rule cascades, precedence and overrides, each with the rule that decided (OP-J17, J18, T24, Q04, U05, C04, C21, C23, H28)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rules: Sequence[tuple[str, Column]]) -> Column:
    """OP-T24, C04: the name of the first rule whose condition is true, null if none; one CASE in rule order, inside codegen."""
    c = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        c = F.when(condition, F.lit(name)).otherwise(c)
    return c


def first_match(df: DataFrame, key: Sequence[str], text: str, rules: DataFrame) -> DataFrame:
    """OP-J17: df with rule_no and label of the first rule (rule_no, pattern, label) whose regular expression the text matches.

    rules is a reviewed list, written by hand and small by nature; it becomes one CASE per rule, so rows are neither paired with
    rules nor shuffled.
    """
    listed = sorted(rules.collect(), key=lambda r: r.rule_no)
    hit = reduce(lambda rest, r: F.when(F.col(text).rlike(r.pattern), F.struct(F.lit(r.rule_no).alias("rule_no"), F.lit(r.label).alias("label"))).otherwise(rest), reversed(listed), F.lit(None).cast("struct<rule_no: int, label: string>"))
    return df.withColumn("_hit", hit).select(*df.columns, F.col("_hit.rule_no").alias("rule_no"), F.col("_hit.label").alias("label"))


def precedence(sources: Sequence[tuple[str, DataFrame]], key: str, columns: Sequence[str], tie: str) -> DataFrame:
    """OP-J18: rows (key, source, columns...) from the first source that holds the key; within it, the row of the least tie."""
    ranked = [df.select(F.col(key), F.lit(i).alias("_p"), F.col(tie).alias("_t"), F.lit(name).alias("source"), *columns) for i, (name, df) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, ranked)
    best = every.groupBy(key).agg(F.min(F.struct("_p", "_t", "source", *columns)).alias("_m"))
    return best.select(key, "_m.source", *(f"_m.{c}" for c in columns))


def gap_fill(main: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """OP-U05, C21: all rows of main, and those of other whose keys main lacks; `filled` tells them apart."""
    return main.withColumn("filled", F.lit(False)).unionByName(other.join(main.select(*keys).distinct(), list(keys), "left_anti").withColumn("filled", F.lit(True)))


def override(df: DataFrame, reviewed: DataFrame, key: str, column: str) -> DataFrame:
    """OP-Q04, C23: column from the reviewed rows (key, column) where there is one; `reviewed` tells. One review per key."""
    side = reviewed.select(F.col(key), F.col(column).alias("_r"), F.lit(True).alias("reviewed"))
    joined = df.join(side, key, "left")
    return joined.select(*(F.coalesce("_r", column).alias(column) if c == column else F.col(c) for c in df.columns), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
