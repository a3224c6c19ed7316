"""History of changing attributes: versions with their period of validity, kept by affected-chain rebuild.

The deliveries of an entity make its chain. `HistoryStore` keeps, in buckets of entities in the shared folder, what counts of them
(the last delivered row of every entity and period) beside the chains built from it. When deliveries come late or correct earlier
ones, only the entities that they touch are taken up again: their raw changes are retrieved from their buckets, the new deliveries
are added, their chains are rebuilt from nothing, and one commit puts them in the place of the old chains. Buckets without a touched
entity are neither read nor written. `versions` builds chains from rows, `rebuild_affected` is the update as one plan.

Defined results: rows without an entity or period belong to no chain; of a period the last delivered row counts; ties of
delivery go to the larger tie-break; repeated rows change nothing; an entity that only reports nulls has one version of nulls;
an empty table has no versions. Per entity and period one row is left before anything is ordered, so a hot entity holds at
most as many rows as there are periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.operators.store import Files, Store, bucket_of, schema_of

OPEN = 999999


def last_delivered(raw: DataFrame, entity: Column, period: Column, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Rows (entity, period, v): the last delivered row of every entity and period, as a struct of its order and values."""
    v = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *(c.alias(n) for n, c in values.items()))
    return merged(raw.select(entity.alias("entity"), period.alias("period"), v.alias("v")).where("entity is not null and period is not null"))


def merged(*rows: DataFrame) -> DataFrame:
    """One table of last delivered rows from several, or from rows of the same shape."""
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("entity", "period").agg(F.max("v").alias("v"))


def marked(last: DataFrame, exact: Sequence[str], kept: Sequence[str], by: Sequence[str] = ("entity",)) -> DataFrame:
    """Last delivered rows with `state` and `valid_to`: set on the rows that begin a version, null on the others.

    exact: values that count as reported, null included; kept: values of which a null keeps the one reported before.
    """
    chain = Window.partitionBy(*by).orderBy("period")
    sofar = chain.rowsBetween(Window.unboundedPreceding, 0)
    state = F.struct(*(F.col(f"v.{n}").alias(n) for n in exact), *(F.last(F.col(f"v.{n}"), ignorenulls=True).over(sofar).alias(n) for n in kept))
    rows = last.withColumn("_s", state).withColumn("_b", F.lag("_s").over(chain))
    begins = F.col("_b").isNull() | ~F.col("_s").eqNullSafe(F.col("_b"))
    rows = rows.withColumn("state", F.when(begins, F.col("_s"))).withColumn("_p", F.when(begins, F.col("period")))
    after = F.expr(f"lead(_p) ignore nulls over (partition by {', '.join(by)} order by period)")
    return rows.withColumn("valid_to", F.when(begins, F.coalesce(after, F.lit(OPEN)))).drop("_s", "_b", "_p")


def chains_in(rows: DataFrame) -> DataFrame:
    """Rows (entity, valid_from, valid_to, values...) of every version, from marked rows."""
    return rows.where("state is not null").select("entity", F.col("period").alias("valid_from"), "valid_to", "state.*")


def chains_of(last: DataFrame, exact: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Rows (entity, valid_from, valid_to, values...) of every version, from last delivered rows."""
    return chains_in(marked(last, exact, kept))


def versions(raw: DataFrame, entity: Column, period: Column, order: Sequence[Column], exact: dict[str, Column], kept: dict[str, Column]) -> DataFrame:
    """Rows (entity, valid_from, valid_to, values...) of every version, from deliveries at once."""
    return chains_of(last_delivered(raw, entity, period, order, {**exact, **kept}), list(exact), list(kept))


def rebuild_affected(chains: DataFrame, raw: DataFrame, touched: DataFrame, build) -> DataFrame:
    """chains with those of the touched entities rebuilt from all their raw rows. touched: (entity), distinct.

    build(raw rows) gives chains; raw has a column entity. Untouched chains pass by; a touched entity without any raw row left
    loses its chain.
    """
    redone = build(raw.join(touched, "entity", "left_semi"))
    return chains.join(touched, "entity", "left_anti").unionByName(redone)


class HistoryStore(Store):
    """Last delivered rows of entities, of which those that begin a version carry it. Rows lie in buckets of entities; a bucket is built
    by one task, as a bucket holds a bounded number of entities and an entity one row a period. The number of buckets is set when the
    store is created."""

    def __init__(self, spark: SparkSession, folder: str, exact: Sequence[str], kept: Sequence[str], buckets: int = 64):
        super().__init__(spark, folder)
        self.exact, self.kept, self.buckets = list(exact), list(kept), buckets

    def chains(self) -> DataFrame | None:
        """All chains, or None while there are none."""
        held = self.read("rows")
        return None if held is None else chains_in(held)

    def _put_rows(self, before: dict, rows: DataFrame, replaced: list[str] | None, buckets: int, sources: dict[str, Files] | None) -> None:
        self.commit(before, {"rows": (schema_of(rows), self.write(rows, spread=False), replaced)}, sources, {"buckets": buckets})

    def _built(self, last: DataFrame, buckets: int) -> DataFrame:
        """Rows by bucket, each bucket in one task, with the chains built there: one shuffle for the order and for the files."""
        placed = last.repartition(buckets, "bucket")
        return marked(placed, self.exact, self.kept, ("bucket", "entity"))

    def create(self, last: DataFrame, sources: dict[str, Files] | None = None) -> None:
        """The first commit, or a full replacement, from last delivered rows."""
        placed = last.withColumn("bucket", bucket_of(F.col("entity"), self.buckets))
        self._put_rows(self.manifest(), self._built(placed, self.buckets), None, self.buckets, sources)

    def deliver(self, new: DataFrame, sources: dict[str, Files] | None = None) -> None:
        """Affected-chain rebuild: last delivered rows of a new delivery go in, and the chains of the entities in it are rebuilt. The
        delivery is written first, so that it is computed once and names its buckets."""
        before = self.manifest()
        if not before["tables"].get("rows", {}).get("buckets"):
            return self.create(new, sources)
        n = before["more"]["buckets"]
        bucket = bucket_of(F.col("entity"), n)
        staged = self.write(new.withColumn("bucket", bucket))
        hit = sorted(staged)
        if not hit:
            return self.commit(before, {}, sources)
        coming = self.written(schema_of(new), staged)
        held = self.read("rows", hit, before)
        if held is None:
            return self._put_rows(before, self._built(coming.withColumn("bucket", bucket), n), hit, n, sources)
        touched = coming.select("entity").distinct()
        raw = held.join(touched, "entity", "left_semi").select("entity", "period", "v").unionByName(coming)
        placed = raw.withColumn("bucket", bucket).repartition(n, "bucket")
        # Two rows at most of an entity and period are left here, and they are in one task already.
        last = placed.groupBy("bucket", "entity", "period").agg(F.max("v").alias("v"))
        redone = marked(last, self.exact, self.kept, ("bucket", "entity"))
        others = held.join(touched, "entity", "left_anti").withColumn("bucket", bucket).repartition(n, "bucket")
        return self._put_rows(before, redone.unionByName(others), hit, n, sources)

    def withdraw(self, entities: DataFrame) -> None:
        """Take entities out with their rows and chains. entities: (entity), distinct."""
        before = self.manifest()
        n = before["more"].get("buckets", self.buckets)
        hit = sorted(r.b for r in entities.select(bucket_of(F.col("entity"), n).alias("b")).distinct().collect())  # at most as many as buckets
        if (held := self.read("rows", hit, before)) is not None:
            left = held.join(entities, "entity", "left_anti").withColumn("bucket", bucket_of(F.col("entity"), n)).repartition(n, "bucket")
            self._put_rows(before, left, hit, n, None)
