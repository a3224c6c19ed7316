"""Quality of versions and rows: usability, content fingerprints, archived records, issues, precision, invariants (OP-A26, A27, Q01..Q06)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.values import fingerprint
from plinth.operators.latest import latest


def usable_versions(df: DataFrame, version: str, good: Column, least: float) -> DataFrame:
    """OP-Q01: rows (version, coded, usable): the share of good rows in every version."""
    shares = df.groupBy(version).agg(F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("coded"))
    return shares.withColumn("usable", F.col("coded") >= least)


def content_versions(df: DataFrame, keys: Sequence[str], version: str, content: Sequence[Column]) -> DataFrame:
    """OP-Q02: rows (keys..., fingerprint, first_<version>, versions) of versions with equal rows.

    The fingerprint does not depend on row order: two independent 64-bit hashes of every row are added up, beside the number of
    rows, so nothing is gathered or sorted.
    """
    h = fingerprint(*content)
    wide = lambda x: x.cast("decimal(38,0)")
    per = df.groupBy(*keys, version).agg(F.count(F.lit(1)).alias("_n"), F.sum(wide(h)).alias("_a"), F.sum(wide(F.xxhash64(F.lit("second"), h))).alias("_b"))
    per = per.withColumn("fingerprint", F.concat_ws(":", "_n", "_a", "_b"))
    return per.groupBy(*keys, "fingerprint").agg(F.min(version).alias(f"first_{version}"), F.count(F.lit(1)).alias("versions"))


def latest_archived(archive: DataFrame, current: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """OP-Q03: the latest archived row of the keys that the current release lacks."""
    return latest(archive.join(current.select(key), key, "left_anti"), [key], order, columns)


def issues(recorders: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """OP-Q06: rows (problem, source, id) of all recorders (problem, source, rows, id)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(p).alias("problem"), F.lit(s).alias("source"), i.cast("string").alias("id")) for p, s, df, i in recorders])


def precision(df: DataFrame, by: Sequence[str], agreed: Column) -> DataFrame:
    """OP-A27: rows (by..., n, agreed, precision_pct), with totals by rollup."""
    folded = df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(agreed).alias("agreed"))
    return folded.withColumn("precision_pct", F.lit(100.0) * F.col("agreed") / F.col("n"))


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; an invariant holds when there are none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_whole(df: DataFrame, entity: str, share: str, slack: float = 1e-9) -> DataFrame:
    """Entities whose shares do not add up to 1."""
    return df.groupBy(entity).agg(F.sum(share).alias("total")).where(F.abs(F.col("total") - 1) > slack)
