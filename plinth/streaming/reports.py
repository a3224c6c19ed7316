"""Streams of reports and events: windows with late data, content dedup, carry-forward state, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plinth.operators.latest import latest


def tumbling(events: DataFrame, time: str, by: str, length: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and key; with `late`, windows close when the watermark has passed them. Works on streams and tables."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, length, slide or length), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("began"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: runs of events less than a gap apart."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), by, "n")


def unseen(stream: DataFrame, time: str, content: list[str], late: str) -> DataFrame:
    """Rows whose content was not seen within the watermark: the streaming form of version dedup."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(content)


def carried_values(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each report with its value, or the last one of its key reported before (state: one value per key). Within a batch, reports of a
    key go in their order; batches have to come in order."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        filled = []
        for v in rows[value]:
            held = held if pd.isna(v) else v
            filled.append(held)
        state.update((held,))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: filled})

    rows = stream.select(key, order, value)
    return rows.groupBy(key).applyInPandasWithState(step, out, f"held {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep the latest row of each key in a versioned folder, batch by batch; a batch that is run again writes the same version again.

    Version n is made from version n - 1 and batch n, so corrections that come later win, and a repeated batch changes nothing.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/{n - 1:08d}").unionByName(batch)
        latest(rows, keys, [F.col(c) for c in order], batch.columns).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{n:08d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, with the schema of the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(f"{folder}/{name}.parque[t]")
