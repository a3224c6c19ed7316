"""What changed between consecutive full snapshots.

Every delivered row is tagged as the later side of its own period and as the earlier side of the next one. A single
aggregation by (key, later period) keeps, per side, the hash of the last delivered row, and the pair of hashes says
whether the record was added, removed or changed. The aggregation is combined before its only shuffle.

Defined results: keys with nulls group together (callers map nulls first if they show them otherwise); repeated rows change
nothing; ties of delivery go to the larger tie-break; an empty table has no changes; a period that is missing from the
table altogether is no snapshot. Rows without a period belong to no snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.values import fingerprint


def consecutive(df: DataFrame, period: Column) -> DataFrame:
    """(period, next_period) of the snapshots present: one row per snapshot, so as many rows as there are deliveries."""
    seen = df.select(period.alias("period")).where("period is not null").distinct()
    return seen.groupBy().agg(F.array_sort(F.collect_set("period")).alias("all")).select(
        F.posexplode("all").alias("i", "period"), "all"
    ).select("period", F.get("all", F.col("i") + 1).alias("next_period"), (F.col("i") == 0).alias("is_first"))


def changes(df: DataFrame, keys: dict[str, Column], period: Column, state: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Rows (keys..., period, change_kind): each record added, removed or changed in a period against the one before.

    keys: output names and expressions of the record key. state: the comparable forms of the values whose change counts.
    order: the delivery order; the last row of a key and period is its state.
    """
    names = list(keys)
    rows = df.select(
        *(c.alias(f"k{i}") for i, c in enumerate(keys.values())), period.alias("period"),
        F.struct(*order, fingerprint(*state).alias("h")).alias("v"),
    )
    sided = rows.join(F.broadcast(consecutive(df, period)), "period").select(
        *(f"k{i}" for i in range(len(names))), "v",
        F.explode(F.array(
            F.when(~F.col("is_first"), F.struct(F.col("period").alias("p"), F.lit(True).alias("later"))),
            F.when(F.col("next_period").isNotNull(), F.struct(F.col("next_period").alias("p"), F.lit(False).alias("later"))),
        )).alias("side"),
    ).where("side is not null")
    both = sided.groupBy(*(f"k{i}" for i in range(len(names))), F.col("side.p").alias("p")).agg(
        F.max(F.when(F.col("side.later"), F.col("v"))).alias("now"),
        F.max(F.when(~F.col("side.later"), F.col("v"))).alias("before"),
    )
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now.h") != F.col("before.h"), "changed")
    return both.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)), F.col("p").alias("reporting_period"), kind.alias("change_kind")).where("change_kind is not null")
