"""Joins of points and ranges (OP-J22).

Ranges are cut into bins of a given width, points fall into one bin each, and an equi join on bins leaves few pairs to test. Both
sides may be large; a hot bin is split by adaptive execution, as it is an ordinary key. Ranges longer than LONG bins are spread over
wider bins of their own level, so that a range makes few rows whatever its length.

Defined results: ranges are closed below and open above; a range without both ends, or with none between them, holds nothing; points
without a value are in no range; repeated rows of either side count as often as they are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bins that one range makes at most, give or take one; a level's bins are LONG times as wide as those below.
LONG, LEVELS = 16, 8


def range_join(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows of points beside the spans that hold them: low <= at < high. width: of the bins of the first level."""
    wide = lambda i: float(width) * LONG**i
    size = F.col(high) - F.col(low)
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(size <= wide(i) * LONG, F.lit(i)).otherwise(level)
    step = F.lit(float(width)) * F.pow(F.lit(float(LONG)), F.col("_level"))
    held = spans.where(F.col(low) < F.col(high)).withColumn("_level", level)
    held = held.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step))))
    levels = [r._level for r in held.select("_level").distinct().collect()]  # at most LEVELS
    spread = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    spread = spread.withColumn("_bin", F.floor(F.col(at) / step))
    return spread.join(held, ["_level", "_bin"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_bin")
