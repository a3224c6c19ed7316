"""As-of and carry-forward joins (OP-J09, J10, J11, J21, W11, M04).

Both sides go into one union ordered by time within a key, and a window carries the last (or next) observation along. That is one
shuffle and one sort by (key, time), with no range join and no pairs. Hot keys are cut into time buckets when `bucket` is given:
observations are carried within a bucket, and the last one of every earlier bucket comes from a small aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], forward: bool = False, bucket: Column | None = None) -> DataFrame:
    """OP-J09, J11: left with the values of the right row of the same keys at or before its time (at or after, if forward).

    The right side has one row per (keys, time). A left row without one has nulls. Null keys match null keys; rows of left
    with a null time match nothing. bucket: an expression of time that does not fall as time grows, to split hot keys.
    """
    payload = F.struct(F.col(time).alias("_t"), *values)
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(payload.alias("p")).schema[0].dataType), "_row": F.struct(*left.columns)}).select(*keys, time, "_side", "_v", "_row")  # noqa: E741
    r = right.where(F.col(time).isNotNull()).select(*keys, time, F.lit(-1 if forward else 0).alias("_side"), payload.alias("_v"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    if forward:
        l = l.withColumn("_side", F.lit(-2))  # noqa: E741
    both = l.unionByName(r)
    order = [F.col(time).desc_nulls_last() if forward else F.col(time).asc_nulls_first(), F.col("_side").desc() if forward else F.col("_side").asc()]
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_b", bucket)
        w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        within = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
        best = F.min("_v") if forward else F.max("_v")
        ends = both.groupBy(*keys, "_b").agg(best.alias("_e"))
        side = Window.partitionBy(*keys).orderBy(F.col("_b").desc_nulls_last() if forward else F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_e", F.last("_e", ignorenulls=True).over(side))
        on = [within[k].eqNullSafe(ends[k]) for k in [*keys, "_b"]]
        seen = within.join(ends, on).select(*(within[k] for k in keys), within[time], "_row", F.coalesce("_in", "_e").alias("_v"))
    hit = F.when(F.col(f"_row.{time}").isNotNull(), F.col("_v"))
    return seen.where("_row is not null").select("_row.*", *(hit[v].alias(v) for v in values), hit["_t"].alias("matched_time"))


def as_of_by_time(left: DataFrame, right: DataFrame, time: str, values: Sequence[str], forward: bool = False) -> DataFrame:
    """as_of without keys: the values are found for the distinct times of left, of which there are few beside its rows, and joined back."""
    times = left.select(time).where(F.col(time).isNotNull()).distinct().withColumn("_k", F.lit(1))
    found = as_of(times, right.withColumn("_k", F.lit(1)), ["_k"], time, values, forward).drop("_k")
    return left.join(found, time, "left")


def carried(members: DataFrame, dates: DataFrame, observed: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """OP-J21, W11: rows (keys..., time, value, carried): the last value of every member at every date.

    dates is the list of report dates, small by nature; members x dates is the size of the result. Dates before a member's first
    value have none and are left out.
    """
    grid = members.select(*keys).distinct().join(F.broadcast(dates.select(time).distinct()))
    seen = as_of(grid, observed.where(F.col(value).isNotNull()).select(*keys, time, value), keys, time, [value])
    return seen.where("matched_time is not null").select(*keys, time, value, (F.col("matched_time") < F.col(time)).alias("carried"))
