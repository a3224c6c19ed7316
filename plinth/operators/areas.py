"""Shares over sites and roll-ups by area (OP-C02, A18..A20, A23, A24, A36, C18, C24, H16, H19, H31)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def site_shares(sites: DataFrame, entity: str, weight: str) -> DataFrame:
    """OP-C02: sites with `share` and `basis`: in proportion to the weights where all are known, above zero and not all equal, else
    equal; a single site has it all. The shares of an entity add up to 1."""
    sums = sites.groupBy(F.col(entity).alias("_e")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(weight) > 0, 1)).alias("_k"), F.min(weight).alias("_lo"), F.max(weight).alias("_hi"), F.sum(weight).alias("_s")
    )
    by_weight = F.coalesce((F.col("_k") == F.col("_n")) & (F.col("_lo") != F.col("_hi")), F.lit(False))
    share = F.when(by_weight, F.col(weight) / F.col("_s")).otherwise(F.lit(1.0) / F.col("_n"))
    basis = F.when(F.col("_n") == 1, "single").when(by_weight, "proportional").otherwise("equal")
    # Joined, not windowed: a hot entity's sites stay spread, as adaptive execution splits them.
    return sites.join(sums, F.col(entity).eqNullSafe(F.col("_e"))).select(*sites.columns, share.alias("share"), basis.alias("basis"))


def area_totals(sites: DataFrame, area: Sequence[str], entity: str, money: Sequence[str], precise: Column | None = None) -> DataFrame:
    """OP-A19: rows (area..., n, money...) with the money of each site's share; rows that are not precise enough do not count."""
    rows = sites if precise is None else sites.where(precise)
    return rows.groupBy(*area).agg(F.count_distinct(entity).alias("n"), *(F.round(F.sum(F.col(m) * F.col("share")), 2).alias(m) for m in money))


def ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """OP-A20, M03, H31: scale * part / whole; null where the whole is zero or null."""
    return F.when(whole != 0, F.lit(scale) * part / whole)


def normalised(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """OP-H19: value as a share of its sum over keys; null where the sum is zero."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.when(total != 0, F.col(value) / total))
