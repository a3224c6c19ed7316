"""Faceted filtering and counted-once totals (OP-P11..P18, A21, A22, A25, H33, H37)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Facets = Mapping[str, Column]
State = Mapping[str, Sequence[str]]


def matches(facets: Facets, state: State, skip: str | None = None, either: Sequence[Sequence[str]] = ()) -> Column:
    """OP-P11: AND across facets, OR within one, OR across the facets of a group in `either`. Facets are array-valued columns."""
    chosen = {k: F.coalesce(F.arrays_overlap(facets[k], F.array(*map(F.lit, v))), F.lit(False)) for k, v in state.items() if v and k != skip}
    grouped = [[k for k in g if k in chosen] for g in either]
    tests = [reduce(Column.__or__, (chosen[k] for k in g)) for g in grouped if g]
    tests += [c for k, c in chosen.items() if not any(k in g for g in grouped)]
    return reduce(Column.__and__, tests, F.lit(True))


def option_counts(df: DataFrame, facets: Facets, state: State, facet: str) -> DataFrame:
    """OP-P13: rows (option, n) of a facet under all other choices."""
    kept = df.where(matches(facets, state, skip=facet)).select(F.explode(F.array_distinct(facets[facet])).alias("option"))
    return kept.where("option is not null").groupBy("option").agg(F.count(F.lit(1)).alias("n"))


def all_option_counts(df: DataFrame, facets: Facets, state: State) -> DataFrame:
    """OP-P13 for every facet at once: rows (facet, option, n), with one scan and one shuffle."""
    cells = F.array(*(F.struct(F.lit(k).alias("facet"), F.when(matches(facets, state, skip=k), F.array_distinct(c)).alias("options")) for k, c in facets.items()))
    rows = df.select(F.explode(cells).alias("c")).select("c.facet", F.explode("c.options").alias("option"))
    return rows.where("option is not null").groupBy("facet", "option").agg(F.count(F.lit(1)).alias("n"))


def band(value: Column, limits: Sequence[tuple[float, str]], above: str) -> Column:
    """OP-P14: the label of the first limit that the value is below; null for null and NaN."""
    c = F.lit(above)
    for limit, label in reversed(limits):
        c = F.when(value < limit, label).otherwise(c)
    return F.when(value.isNotNull() & ~F.isnan(value), c)


def counted_once(df: DataFrame, key: str, counted_in: str) -> DataFrame:
    """OP-P17: rows but for those whose counted_in is the key of another row of the set."""
    return df.join(df.select(F.col(key).alias("_k")).distinct(), F.col(counted_in) == F.col("_k"), "left_anti")


def parse_state(query: str, defaults: State) -> dict[str, list[str]]:
    """OP-P18: choices from a query string; a facet that is not named has its default."""
    given = {k: [x for x in v.split(",") if x] for k, v in parse_qsl(query, keep_blank_values=True)}
    return {k: list(v) for k, v in defaults.items() if k not in given} | given


def serialize_state(state: State, defaults: State) -> str:
    """OP-P18: the query string of choices that differ from the defaults, in the order of their names."""
    return urlencode([(k, ",".join(v)) for k, v in sorted(state.items()) if list(v) != list(defaults.get(k, []))])


def toggled(state: State, facet: str, option: str) -> dict[str, list[str]]:
    """OP-H33: the choices after an option is tapped."""
    now = list(state.get(facet, []))
    return dict(state) | {facet: [x for x in now if x != option] if option in now else [*now, option]}
