"""Change along ordered snapshots (OP-W02, W03, W06..W10, W13, W14, D03)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def signed_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, seed: Column | None = None, digits: int = 2) -> DataFrame:
    """OP-W02, W07: `change` of value against the row before, the first one against seed (no change without one)."""
    w = along(keys, order)
    before = F.lag(value).over(w)
    if seed is not None:
        before = F.when(F.row_number().over(w) == 1, seed).otherwise(before)
    return df.withColumn("change", F.round(F.col(value) - before, digits))


def changed_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """OP-W03: `changed`: is the value distinct from the one of the row before? Null on the first row of a key."""
    w = along(keys, order)
    return df.withColumn("changed", F.when(F.row_number().over(w) > 1, ~F.col(value).eqNullSafe(F.lag(value).over(w))))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """OP-W06: value of the row, or the last one that was reported before it."""
    w = along(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def running_total(df: DataFrame, member: Sequence[str], plan: Sequence[str], order: str, value: str) -> DataFrame:
    """OP-W09, W10: rows (plan..., order, change, total): the sum of each member's latest value at every date of a plan.

    A member's change against its value before is added up by date, so a plan is a running sum over dates instead of a join of
    members and dates.
    """
    w = Window.partitionBy(*plan, *member).orderBy(order)
    deltas = df.withColumn("_d", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
    by_date = deltas.groupBy(*plan, order).agg(F.sum("_d").alias("change"))
    return by_date.withColumn("total", F.sum("change").over(Window.partitionBy(*plan).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def final_run_start(df: DataFrame, keys: Sequence[str], order: str, holds: Column) -> DataFrame:
    """OP-W13: rows (keys..., run_start): where the final run of rows begins for which `holds` is true; null if the last row fails.

    The start is the least order after the last failing row: one aggregation finds that row, a second the start.
    """
    failed = F.max(F.when(~F.coalesce(holds, F.lit(False)), F.col(order)))
    gathered = df.groupBy(*keys).agg(failed.alias("_f"), F.array_sort(F.collect_set(order)).alias("_all"))
    after = F.filter("_all", lambda x: F.col("_f").isNull() | (x > F.col("_f")))
    return gathered.select(*keys, F.when(F.size(after) > 0, F.get(after, F.lit(0))).alias("run_start"))


def outcome(df: DataFrame, keys: Sequence[str], order: str, done: Column, last_report: Column) -> DataFrame:
    """OP-W14: rows (keys..., outcome, finished_at, reopened) of each history.

    finished: the last row is done; reopened: a done row is followed by one that is not; left_unfinished: not done and not in the
    last report any more; still_listed: not done and in the last report.
    """
    is_done = F.coalesce(done, F.lit(False))
    folded = df.groupBy(*keys).agg(
        F.max(F.struct(F.col(order).alias("o"), is_done.alias("d"))).alias("_l"), F.min(F.when(is_done, F.col(order))).alias("_first"), F.max(F.when(~is_done, F.col(order))).alias("_open")
    )
    reopened = F.coalesce(F.col("_first") < F.col("_open"), F.lit(False))
    kind = F.when(F.col("_l.d"), "finished").when(F.col("_l.o") < last_report, "left_unfinished").otherwise("still_listed")
    return folded.select(*keys, kind.alias("outcome"), F.when(F.col("_l.d") & ~reopened, F.col("_first")).alias("finished_at"), reopened.alias("reopened"))
