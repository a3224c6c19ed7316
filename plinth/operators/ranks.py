"""Exact order statistics of groups of any size, without sorting a group (OP-A10, OP-A35, OP-C22).

Numbers are counted by their leading digits in a scale that keeps their order: the power of two and the first binary places of the
mantissa. The sums of a group tell in which of these classes a wanted rank falls; the numbers of that class are counted by further
places, and those of the class found then by themselves. Each step is one aggregation that is combined before its shuffle, and each
window holds the classes of one group, of which there are at most a few million whatever the size of the group.

Defined results: nulls, NaN and infinities are no numbers; a group without numbers has no rows; equal numbers take as many ranks as
they are frequent; null keys are a group of their own; ranks beyond a group's size name nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.values import finite

#: Binary places of the mantissa that the first and the second step tell apart.
PLACES = (10, 31)


def middle(total: Column) -> Column:
    """The ranks of the median: one, or two middle ones."""
    return F.array(F.floor((total + 1) / 2), F.floor((total + 2) / 2))


def scale(x: Column) -> Column:
    """A number that never falls as x grows and rises by 1 from one power of two to the next; 0 for 0."""
    size = F.abs(x)
    power = F.least(F.floor(F.log2(size)), F.lit(1023)).cast("double")
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (power + size / F.pow(F.lit(2.0), power) + 1100.0))


def at(df: DataFrame, by: Sequence[str], x: Column, wanted: Callable[[Column], Column], n: Column | None = None, keep: bool = False) -> DataFrame:
    """Rows (by..., hits, x): the numbers that stand at the wanted ranks of each group; hits says how many of them a number takes.

    wanted(total) is the array of ranks, from 1. n: how often a row counts, once by default. keep: also the ranks (ranks) and the
    size of the group (total).
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), finite(x.cast("double")).alias("_x"), (F.lit(1) if n is None else n).cast("bigint").alias("_n")).where("_x is not null")
    rows = rows.select(*keys, "_x", "_n", *(F.floor(scale(F.col("_x")) * float(1 << p)).alias(f"_d{i}") for i, p in enumerate(PLACES)))
    first = rows.groupBy(*keys, "_d0").agg(F.sum("_n").alias("_m"))
    total = F.sum("_m").over(Window.partitionBy(*keys))
    ranked = first.withColumn("_t", total).withColumn("_r", F.transform(wanted(F.col("_t")), lambda r: F.struct(r.cast("bigint").alias("at"), r.cast("bigint").alias("of"), F.col("_t").alias("t"))))
    held = _held(ranked, keys, "_d0", F.col("_r"))
    second = _inside(rows, held, keys, "_d0").groupBy(*keys, "_d0", "_d1", "_r").agg(F.sum("_n").alias("_m"))
    held = _held(second, [*keys, "_d0"], "_d1", F.col("_r"))
    last = _inside(rows, held, [*keys, "_d0"], "_d1").groupBy(*keys, "_d0", "_d1", "_r", "_x").agg(F.sum("_n").alias("_m"))
    hit = _placed(last, [*keys, "_d0", "_d1"], "_x", F.col("_r")).where(F.size("_r") > 0)
    return hit.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.size("_r").alias("hits"), F.col("_x").alias("x"), *([F.col("_r.of").alias("ranks"), F.col("_r")[0]["t"].alias("total")] if keep else []))


def quantiles(df: DataFrame, by: Sequence[str], x: Column, wanted: dict[str, float], n: Column | None = None) -> DataFrame:
    """Rows (by..., names...): continuous quantiles, that is between the two numbers around (size - 1) * q, in proportion.

    The ranks that a quantile needs come with the group's size, so one search answers all of them.
    """
    spots = [(name, q) for name, q in wanted.items()]
    low = lambda total, q: F.floor(F.lit(q) * (total - 1)) + 1
    rank = lambda total: F.array(*(r for _, q in spots for r in (low(total, q), F.least(low(total, q) + 1, total))))
    numbered = at(df, by, x, rank, n, keep=True)
    flat = numbered.select(*by, "x", "total", F.explode("ranks").alias("r"))
    cells = []
    for name, q in spots:
        place, under = F.lit(q) * (F.col("total") - 1) + 1, low(F.col("total"), q)
        part = F.when(F.col("r") == under, F.col("x") * (1 - (place - under))).otherwise(F.lit(0.0))
        more = F.when(F.col("r") == F.least(under + 1, F.col("total")), F.col("x") * (place - under)).otherwise(F.lit(0.0))
        cells.append(F.sum(part + more).alias(name))
    return flat.dropDuplicates([*by, "r"]).groupBy(*by).agg(*cells)


def _placed(counted: DataFrame, keys: list[str], digit: str, ranks: Column) -> DataFrame:
    """counted with the ranks that fall into each digit, as ranks within it."""
    below = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = F.filter(ranks, lambda r: (r["at"] > F.col("_below")) & (r["at"] <= F.col("_below") + F.col("_m")))
    return counted.withColumn("_below", below).withColumn("_r", F.transform(some, lambda r: F.struct((r["at"] - F.col("_below")).alias("at"), r["of"].alias("of"), r["t"].alias("t"))))


def _held(counted: DataFrame, keys: list[str], digit: str, ranks: Column) -> DataFrame:
    return _placed(counted, keys, digit, ranks).where(F.size("_r") > 0).select(*keys, digit, "_r")


def _inside(rows: DataFrame, held: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """The rows of the digits held, with their ranks: at most one digit for each rank of a group. Null keys meet each other."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{digit}") == F.col(f"b.{digit}")]
    return rows.alias("a").join(held.alias("b"), on).select("a.*", "b._r")
